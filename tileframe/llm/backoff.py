"""Stupid-backoff scores of documents, against the counts of all other documents.

Counts cover every document; a document's own n-grams are taken off before it is
scored. Each task packs its documents into compressed blocks of about ``BLOCK_CHARS``
characters. A block counts its n-grams of every order by 64-bit keys and sends each shard
(a range of keys, so a hash partition of the n-grams) its keys and counts, sorted; the
shard adds up the blocks' counts, so it holds its part of the n-gram count tables, and
joins them back to the keys it was sent; the block joins the totals to its documents'
n-grams and adds up their scores per document. An n-gram crosses the network once a
block, however often it occurs, so frequent ones are no hot keys, and keys travel as
differences (5 to 6 bytes), not as rows. A block sends nothing to a shard it has no key
of, so there are never more messages than n-grams of blocks: they grow with the corpus,
not with blocks times shards.

Score of a word after its n-1 predecessors: count of the n-gram over that of its
first n-1 words, where the n-gram occurs in another document; else ``BACKOFF`` times
the score with one predecessor less; a single word's score is its count (one, where no
other document has it) over the number of words of the other documents. Orders that
reach before the text's first word are left out without a penalty.

Defined cases: a null or empty text has no words and the score 0, its mean is null; a
very long text is scored whole, in a block of its own; with no words outside the
document, that number counts as one; rows that repeat an id, or have none, are documents
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ngrams

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 12_000_000
SHARD_KEYS = 3_000_000


def _pack(keys, counts, zstd) -> bytes:
    """Sorted keys as differences, byte by byte, and counts; compressed."""
    import numpy as np

    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstd.compress(np.int64(len(keys)).tobytes() + planes.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes, zstd):
    import numpy as np

    raw = zstd.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _pack_counts(counts, zstd) -> bytes:
    import numpy as np

    return zstd.compress(np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_counts(data: bytes, zstd):
    import numpy as np

    raw = np.frombuffer(zstd.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _block_grams(texts, order: int):
    """(key of every n-gram, order by order; words a text; places; distinct keys with the
    position of each n-gram's key in them, and counts)."""
    import numpy as np

    hashes, sizes = ngrams.word_hashes(texts)
    place = ngrams.places(sizes)
    grams = [ngrams.gram_keys(hashes, k) for k in range(1, order + 1)]
    counted = np.concatenate([g[place >= k] for k, g in enumerate(grams)] + [np.empty(0, np.uint64)])
    keys, inverse, counts = np.unique(counted, return_inverse=True, return_counts=True)
    at, start = [], 0
    for k in range(order):
        own = np.full(len(hashes), -1, np.int64)
        n = int((place >= k).sum())
        own[place >= k] = inverse[start : start + n]
        start += n
        at.append(own)
    return sizes, place, at, keys, counts


def _own_counts(at, doc, n_keys: int):
    """How often the n-gram at each word occurs in the word's own document."""
    import numpy as np

    out = np.zeros(len(at), np.int64)
    real = at >= 0
    _, inverse, counts = np.unique(doc[real] * max(n_keys, 1) + at[real], return_inverse=True, return_counts=True)
    out[real] = counts[inverse]
    return out


def _document_scores(sizes, place, at, totals, n_words: int):
    import numpy as np

    doc = np.repeat(np.arange(len(sizes)), sizes)
    others = []
    for own in at:
        total = np.where(own >= 0, np.append(totals, 0)[own], 0)
        others.append(total - _own_counts(own, doc, len(totals)))
    outside = np.maximum(n_words - sizes, 1)[doc]
    scores = np.log(np.maximum(others[0], 1) / outside)
    for k in range(1, len(at)):
        before = np.concatenate([[0], others[k - 1][:-1]])  # the n-gram's first words
        seen = others[k] > 0
        longer = np.log(np.maximum(others[k], 1) / np.maximum(before, 1))
        scores = np.where(place >= k, np.where(seen, longer, math.log(BACKOFF) + scores), scores)
    return np.bincount(doc, scores, len(sizes))


def _packed_blocks(batches):
    """block, docs (bytes): the documents of a task, in its order, in blocks."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0

    def block():
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for part in held:
                to.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = 0
        for k, n in enumerate(lengths):
            if size and size + n > BLOCK_CHARS:
                held.append(batch.slice(start, k - start))
                yield block()
                held, size, start, made = [], 0, k, made + 1
            size += n
        held.append(batch.slice(start))
    if held:
        yield block()


def _documents(packed: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(packed).read_all()


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every row."""
    import numpy as np
    import pandas as pd
    import zstandard

    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.sum(common.n_words("text")).alias("words")).first()
    chars, n_words = size["chars"] or 0, size["words"] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, chars * order / 6 / SHARD_KEYS))))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packed_blocks, "block long, docs binary")

    def ask(key, frame: pd.DataFrame) -> pd.DataFrame:
        texts = _documents(frame["docs"].iloc[0]).column(1).to_pylist()
        sizes, _, _, keys, counts = _block_grams(texts, order)
        edges = keys.searchsorted(np.arange(shards, dtype=np.uint64) * np.uint64(2**64 // shards)) if shards > 1 else np.array([0])
        ends = np.append(edges[1:], len(keys))
        held = np.flatnonzero(ends > edges)
        zstd = zstandard.ZstdCompressor(level=1)
        return pd.DataFrame({"shard": held.astype(np.int32), "block": key[0], "grams": [_pack(keys[a:b], counts[a:b], zstd) for a, b in zip(edges[held], ends[held], strict=True)]})

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        zstd = zstandard.ZstdDecompressor()
        parts = [_unpack(g, zstd) for g in frame["grams"]]
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts)
        ends = np.cumsum([len(k) for k, _ in parts])
        zstd = zstandard.ZstdCompressor(level=1)
        answers = [_pack_counts(total[inverse[e - len(k) : e]], zstd) for e, (k, _) in zip(ends, parts, strict=True)]
        return pd.DataFrame({"block": frame["block"], "shard": key[0], "totals": answers})

    def give(key, packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _documents(packed["docs"].iloc[0])
        sizes, place, at, _, _ = _block_grams(own.column(1).to_pylist(), order)
        zstd = zstandard.ZstdDecompressor()
        totals = np.concatenate([np.empty(0, np.int64), *[_unpack_counts(t, zstd) for t in answers.sort_values("shard")["totals"]]])
        found = _document_scores(sizes, place, at, totals, n_words)
        return pd.DataFrame({"doc_id": own.column(0).to_pandas(integer_object_nulls=True), "n_words": sizes, "log_score": found})

    asked = dealt.groupBy("block").applyInPandas(ask, "shard int, block long, grams binary")
    added = asked.groupBy("shard").applyInPandas(add, "block long, shard int, totals binary")
    scored = dealt.groupBy("block").cogroup(added.groupBy("block")).applyInPandas(give, "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.col("log_score") / F.nullif("n_words", F.lit(0)))


def op2_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


OP2_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '{common.WORD_PATTERN}') AS w FROM documents),
tokens AS (
  SELECT d, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c
  FROM (SELECT d, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY d, a) AS c1,
    CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY d, a, b) END AS c2,
    CASE WHEN c IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY d, a, b, c) END AS c3,
    greatest(count(*) OVER () - count(*) OVER (PARTITION BY d), 1) AS outside FROM tokens),
one AS (SELECT *, ln(greatest(c1, 1) / outside) AS s1, lag(c1) OVER w AS before1, lag(c2) OVER w AS before2 FROM counted WINDOW w AS (PARTITION BY d ORDER BY i)),
two AS (SELECT *, CASE WHEN c2 > 0 THEN ln(c2 / before1) WHEN c2 = 0 THEN ln({BACKOFF}) + s1 ELSE s1 END AS s2 FROM one),
scored AS (SELECT d, CASE WHEN c3 > 0 THEN ln(c3 / before2) WHEN c3 = 0 THEN ln({BACKOFF}) + s2 ELSE s2 END AS s FROM two)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 5) AS log_score,
       round(sum(s) / nullif(len(w), 0), 5) AS mean_log_score
FROM docs LEFT JOIN scored USING (d) GROUP BY d, doc_id, w
"""
