"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

Trusted documents are labelled rows of quality 1. One in ``HELD_SHARE`` of them, by a
hash of the id, is held out in every language; the model is fitted on the whole texts of
all others. Its tables are made by Spark, sharded by n-gram hash: counts of the longest
n-grams, continuation counts of the shorter ones (distinct left neighbours), three
discounts an order from the counts of counts, and of every context the sum of counts and
the n-grams of counts 1, 2, and more. All n-grams of a text start after ``ORDER - 1``
border marks.

Every text is scored whole, and the tables, which grow with the trusted text, go nowhere
whole. Each task packs its documents into blocks; a block sends each shard (a range of
keys) the distinct keys of its n-grams of every order, sorted and as differences; the
shard looks them up in its part of the tables and sends back which it knows, with their
counts, of which the block makes probabilities. An n-gram is no row anywhere but a
difference of some 5 bytes. The tables are bucketed by shard and the blocks by their
number, so that neither are shuffled again.

A caller of ``classify`` may ask for a model of about ``train_docs`` documents a language
instead, chosen by another hash of the id and cut to ``MAX_GRAMS`` n-grams in all: its
tables are small, so they are broadcast, and scoring shuffles nothing. The query does not.

A document is kept if its perplexity is at most the ``QUANTILE`` of its language's
trusted documents outside the training texts (null is a language here); languages with fewer
than ``MIN_TRUSTED`` such documents use that of all of them; without any, all are kept.
``limit_from`` says which: language, pooled or none.

Defined cases: a null or empty text has no perplexity and is not kept; a document with
several labels is trusted if all say 1; null labels are ignored; without trusted text
every word gets the same probability and all documents with words are kept; repeated
ids are scored row by row; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import backoff, common, ngrams

ORDER = 3
HELD_SHARE = 5
MAX_GRAMS = 8_000_000
#: Rounds of scoring; each has its part of the documents. Tables of fewer characters than
#: this many times ``ROUND_CHARS`` take fewer rounds.
ROUNDS = 6
ROUND_CHARS = 20_000_000
QUANTILE = 0.995
QUANTILE_ACCURACY = 10_000
MIN_TRUSTED = 50
#: Probability that is shared by unknown words where there is no model.
NO_MODEL = 1e-6


def _padded(texts):
    """Hashes with ORDER - 1 border marks (0) before each text, which words are real, sizes."""
    hashes, sizes = ngrams.word_hashes(texts)
    return *_bordered(hashes, sizes), sizes


def _bordered(hashes, sizes):
    import numpy as np

    pad = ORDER - 1
    starts = np.cumsum(sizes) - sizes + pad * np.arange(len(sizes))
    real = np.ones(len(hashes) + pad * len(sizes), bool)
    for k in range(pad):
        real[starts + k] = False
    out = np.zeros(len(real), np.uint64)
    out[real] = hashes
    return out, real


def _keys(padded, real):
    """For each order 1..ORDER the keys of the n-grams that end at real words."""
    return [ngrams.gram_keys(padded, k)[real] for k in range(1, ORDER + 1)]


def _context_keys(padded, real):
    """For each order 2..ORDER the keys of the words before the last one."""
    import numpy as np

    at = np.flatnonzero(real) - 1
    return [ngrams.gram_keys(padded, k - 1)[at] for k in range(2, ORDER + 1)]


def trusted(labels: DataFrame) -> DataFrame:
    return labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")


def _held():
    return F.pmod(F.xxhash64("doc_id", F.lit("kn-held")), F.lit(HELD_SHARE)) == 0


def training_ids(docs: DataFrame, good: DataFrame, train_docs: int) -> DataFrame:
    """doc_id of at most about ``train_docs`` trusted documents a language, none of them
    of the share that is held out."""
    rows = docs.select("doc_id", "lang").join(good.filter(~_held()), "doc_id", "left_semi")
    rows = common.materialize(rows, "trusted")
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n"))
    chosen = rows.join(counts, F.col("lang").eqNullSafe(F.col("_lang"))).filter(_place() <= F.lit(2**32) * F.lit(train_docs) / F.col("n"))
    return chosen.select("doc_id").distinct()


def training_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, lang, text of the rows with these ids, cut to ``MAX_GRAMS`` n-grams."""
    rows = docs.join(ids, "doc_id", "left_semi").select("doc_id", "lang", "text", common.n_words(F.col("text")).alias("n"))
    rows = common.materialize(rows, "kn-texts")
    # A word ends ORDER n-grams. The budget is the largest power of two that fits.
    most = MAX_GRAMS // ORDER
    powers = range(most.bit_length())
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    sums = sizes.agg(F.sum("n").alias("all"), *[F.sum(F.least("n", F.lit(2**k))).alias(f"s{k}") for k in powers]).first()
    if (sums["all"] or 0) <= most:
        return rows.drop("n")
    budget = max([2**k for k in powers if sums[f"s{k}"] <= most], default=0)
    order = Window.partitionBy("lang").orderBy(_place(), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    left = rows.withColumn("left", F.lit(budget) - F.coalesce(F.sum("n").over(order), F.lit(0))).filter("left > 0")
    first = F.array_join(F.slice(common.words(F.col("text")), 1, F.col("left").cast("int")), " ")
    return left.select("doc_id", "lang", F.when(F.col("n") > F.col("left"), first).otherwise(F.col("text")).alias("text"))


def _place():
    return F.crc32(F.concat(F.lit("kn:"), F.col("doc_id").cast("string")))


def gram_rows(texts: DataFrame) -> DataFrame:
    """key, context, suffix of every longest n-gram, and the keys of all orders: one row a
    word."""
    names = [f"key{k}" for k in range(1, ORDER + 1)] + [f"context{k}" for k in range(2, ORDER + 1)]

    def run(batches):
        for batch in batches:
            padded, real, _ = _padded(batch.column(0).to_pylist())
            columns = [*_keys(padded, real), *_context_keys(padded, real)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view("int64"), pa.int64()) for c in columns], names)

    return texts.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def tables(texts: DataFrame):
    """Probability of an unknown word, and for each order two DataFrames, from one of trusted
    texts: key, p of its n-grams and context, mass of what they leave to shorter ones."""
    rows = gram_rows(texts)
    highest = rows.groupBy(*rows.columns).agg(F.count("*").alias("a"))
    counted: list[DataFrame] = []
    for k in range(ORDER, 0, -1):
        own = [f"key{j}" for j in range(1, k + 1)] + [f"context{j}" for j in range(2, k + 1)]
        # Continuation count: the distinct n-grams one longer that end in this one.
        counts = highest if k == ORDER else counted[-1].groupBy(*own).agg(F.count("*").alias("a"))
        counted.append(common.materialize(counts, f"kn-counts{k}"))
    counted.reverse()
    probabilities, found, unknown = None, [], NO_MODEL
    words = counted[0].count()
    for k, counts in enumerate(counted, 1):
        of = counts.agg(*[F.count(F.when(F.col("a") == j, 1)).alias(f"n{j}") for j in (1, 2, 3, 4)]).first()
        discount = _discounts(*of)
        context = F.lit(0).cast("long") if k == 1 else F.col(f"context{k}")
        less = F.when(F.col("a") == 1, discount[0]).when(F.col("a") == 2, discount[1]).otherwise(discount[2])
        sums = counts.groupBy(context.alias("context")).agg(F.sum("a").alias("total"), F.sum(less).alias("cut"))
        mass = common.materialize(sums.select("context", "total", (F.col("cut") / F.col("total")).alias("mass")), f"kn-mass{k}")
        own = counts.withColumn("context", context).join(F.broadcast(mass) if k == 1 else mass, "context")
        first = (F.col("a") - less) / F.col("total")
        if k == 1:
            shorter = own.withColumn("p", first + F.col("mass") / (words + 1))
            left = mass.first()
            unknown = left["mass"] / (words + 1) if left else NO_MODEL
        else:
            lower = probabilities.select(F.col("key").alias(f"key{k - 1}"), F.col("p").alias("lower"))
            shorter = own.join(lower, f"key{k - 1}").withColumn("p", first + F.col("mass") * F.col("lower"))
        probabilities = common.materialize(shorter.select(F.col(f"key{k}").alias("key"), "p"), f"kn-p{k}")
        found.append((probabilities, mass.select("context", "mass")))
    common.discard(*counted)
    return unknown, found


def fit(texts: DataFrame) -> dict:
    """The model's sorted arrays, from a DataFrame of trusted texts (a bounded sample)."""
    unknown, found = tables(texts)
    return {"unknown": unknown, "p": [_sorted(p.toArrow()) for p, _ in found], "mass": [_sorted(mass.toArrow()) for _, mass in found[1:]]}


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more."""
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return max(0.05, min(0.95, d1)), max(0.05, min(1.9, d2)), max(0.05, min(2.9, d3))


def _sorted(table):
    import numpy as np

    key = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], table.column(1).to_numpy()[order].astype(np.float32)


def _look_up(pair, wanted, missing: float):
    import numpy as np

    keys, values = pair
    if not len(keys):
        return np.full(len(wanted), missing), np.zeros(len(wanted), bool)
    at = np.minimum(keys.searchsorted(wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], missing), found


def log_probabilities(model: dict, texts):
    """(sum of the words' log-probabilities, number of words) of each text."""
    import numpy as np

    padded, real, sizes = _padded(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not model["p"]:
        return np.bincount(doc, np.full(len(doc), math.log(NO_MODEL)), len(sizes)), sizes
    keys, contexts = _keys(padded, real), _context_keys(padded, real)
    p, _ = _look_up(model["p"][0], keys[0], model["unknown"])
    for k in range(1, ORDER):
        seen, found = _look_up(model["p"][k], keys[k], 0.0)
        # Without the n-gram, what its context leaves goes to the shorter one.
        p = np.where(found, seen, _look_up(model["mass"][k - 1], contexts[k - 1], 1.0)[0] * p)
    return np.bincount(doc, np.log(p), len(sizes)), sizes


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                total, sizes = log_probabilities(sent.value, part.column(2).to_pylist())
                with np.errstate(over="ignore"):
                    perplexity = np.exp(-total / np.maximum(sizes, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(perplexity, mask=sizes == 0)], ["doc_id", "lang", "n_words", "perplexity"])

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, n_words long, perplexity double")


def _pack(arrays) -> bytes:
    """Arrays of whole numbers from 0 on, each byte by byte at the width that its largest one
    needs; compressed."""
    import numpy as np
    import zstandard

    head, planes = [len(arrays)], []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        head += [len(x), width]
        planes.append(x.astype(f"u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def _unpack(data: bytes):
    """The arrays, as unsigned numbers of their widths."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    start, out = 8 + 16 * count, []
    for n, width in np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, start).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").ravel())
        start += n * width
    return out


def _steps(keys):
    import numpy as np

    return np.diff(keys, prepend=np.uint64(0))


def _from_steps(steps):
    import numpy as np

    return np.cumsum(steps, dtype=np.uint64)


def _edges(keys, bits: int):
    """Start of each shard's (a range of keys) part of sorted keys, and the end."""
    import numpy as np

    starts = keys.searchsorted(np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
    return np.append(starts, len(keys))


def _to_shards(block: int, keys, columns, bits: int):
    """A message (keys, counts) to each shard that a block has keys of."""
    import numpy as np

    edges = _edges(keys, bits)
    held = np.flatnonzero(edges[1:] > edges[:-1])
    grams = [_pack([_steps(keys[a:b]), *[c[a:b] for c in columns]]) for a, b in zip(edges[held], edges[held + 1], strict=True)]
    return {"shard": held.astype(np.int32), "block": np.full(len(held), block), "grams": grams}


def _questions(block: int, keys, bits: int):
    """A message to each shard that a block has keys of: the keys of every order."""
    import numpy as np

    edges = np.array([_edges(k, bits) for k in keys])
    held = np.flatnonzero((edges[:, 1:] > edges[:, :-1]).any(axis=0))
    grams = [_pack([_steps(k[e[s] : e[s + 1]]) for k, e in zip(keys, edges, strict=True)]) for s in held]
    return {"shard": held.astype(np.int32), "block": np.full(len(held), block), "grams": grams}


def _hashed_blocks(batches):
    """block, docs (doc_id, lang, number of words), words (hashes): the documents of a task
    (doc_id, text, lang), in its order, in blocks."""
    import numpy as np
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, 0
    ids, hashes, size = [], [], 0

    def block():
        vocabulary, at, _ = ngrams.grouped(np.concatenate(hashes))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, ids[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for part in ids:
                to.write_batch(part)
        columns = [pa.array([first + made]), pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([_pack([_steps(vocabulary), at])], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "words"])

    def take(part):
        words, sizes = ngrams.word_hashes(part.column(1).to_pylist())
        ids.append(pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes)], ["doc_id", "lang", "n_words"]))
        hashes.append(words)

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = 0
        for k, n in enumerate(lengths):
            if size and size + n > backoff.BLOCK_CHARS:
                take(batch.slice(start, k - start))
                yield block()
                ids, hashes, size, start, made = [], [], 0, k, made + 1
            size += n
        take(batch.slice(start))
    if ids:
        yield block()


QUESTIONS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("grams", pa.binary())])
BLOCKS = "block long, docs binary, words binary"


def _words(packed: bytes):
    """Hashes of all words of a block."""
    steps, at = _unpack(packed)
    return _from_steps(steps)[at]


def _grams(hashes, sizes, k: int):
    """Distinct k-grams of a block: keys, counts, keys of their suffixes and contexts; and the
    keys that the block asks for at this order, which hold those of contexts, too."""
    import numpy as np

    padded, real = _bordered(hashes, sizes)
    word, every = np.flatnonzero(real), ngrams.gram_keys(padded, k)
    keys, at, one = ngrams.grouped(every[word])
    shorter = ngrams.gram_keys(padded, max(1, k - 1))
    asked = keys if k == ORDER else ngrams.distinct(np.concatenate([every[word], every[word - 1]]))
    return keys, np.bincount(at, minlength=len(keys)), shorter[word[one]], shorter[word[one] - 1], asked


def counts_sharded(texts: DataFrame, bits: int) -> tuple[list[dict], list[common.Bucketed]]:
    """Counts of counts of each order 1..ORDER, and of each order a table of packed counts by
    shard, from a DataFrame of trusted texts.

    From the longest order on, blocks of texts send their distinct n-grams to shards, which add
    up the counts and tell each block what they are, and one block of each n-gram that it
    speaks for it: that block counts it once for its suffix (the continuation count) and in
    its context (sum of counts; n-grams of counts 1, 2, and more). Answers are deleted when
    the next order has read them.
    """
    import numpy as np
    import pandas as pd

    packed = texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")).mapInArrow(_hashed_blocks, BLOCKS)
    written = common.Bucketed(packed, "kn-blocks", "block")
    blocks = written.rows()
    asks, adds = "shard int, block long, grams binary", "kind string, block long, shard int, data binary, n1 long, n2 long, n3 long, n4 long, more long, total long"

    def of_block(docs: bytes, words: bytes, k: int):
        return _grams(_words(words), backoff._documents(docs).column(2).to_numpy(), k)

    def ask(batches):
        for batch in batches:
            for block, docs, words in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                keys, counts, *_ = of_block(docs, words, ORDER)
                yield pa.RecordBatch.from_pandas(pd.DataFrame(_to_shards(block, keys, [counts], bits)), QUESTIONS, preserve_index=False)

    def ask_shorter(k):
        def run(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            grams, _, suffix, context, before = of_block(own["docs"].iloc[0], own["words"].iloc[0], k + 1)
            if not len(answers):
                return pd.DataFrame(_to_shards(key[0], np.empty(0, np.uint64), [], bits))
            found = [_unpack(x) for x in answers.sort_values("shard")["data"]]
            at = before.searchsorted(grams)
            a, speaks = (np.concatenate([f[c] for f in found])[at].astype(np.int64) for c in (0, 1))
            keys, where, _ = ngrams.grouped(np.concatenate([suffix, context]))
            of_suffix, of_context = where[: len(suffix)], where[len(suffix) :]
            columns = [np.bincount(of_suffix, speaks, len(keys))]
            columns += [np.bincount(of_context, c * speaks, len(keys)) for c in (a, a == 1, a == 2, a > 2)]
            return pd.DataFrame(_to_shards(key[0], keys, [c.astype(np.int64) for c in columns], bits))

        return run

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(g) for g in frame["grams"]]
        distinct, at, _ = ngrams.grouped(np.concatenate([_from_steps(p[0]) for p in parts]))
        sent = [np.concatenate([p[c] for p in parts]) for c in range(1, len(parts[0]))]
        columns = [np.bincount(at, c, len(distinct)).astype(np.int64) for c in sent]
        speaks, one = np.zeros(len(at), np.uint8), np.full(len(distinct), -1)
        asked = np.flatnonzero(sent[0])
        one[at[asked]] = asked  # one of those that ask
        speaks[one[one >= 0]] = 1
        rows, end = [], 0
        for block, (own, *_) in zip(frame["block"], parts, strict=True):
            start, end = end, end + len(own)
            rows.append(("answer", block, key[0], _pack([columns[0][at[start:end]], speaks[start:end]])))
        a = columns[0]
        stats = [int((a == j).sum()) for j in (1, 2, 3, 4)] + [int((a > 4).sum()), int(a.sum())]
        out = pd.DataFrame([*rows, ("model", None, key[0], _pack([_steps(distinct), *columns]))], columns=["kind", "block", "shard", "data"])
        for name, x in zip(["n1", "n2", "n3", "n4", "more", "total"], stats, strict=True):
            out[name] = np.where(out["kind"] == "model", x, 0)
        return out.assign(block=out["block"].astype("Int64"))

    asked, stats, found = blocks.mapInArrow(ask, asks), [], []
    for k in range(ORDER, 0, -1):
        made = common.Bucketed(asked.groupBy("shard").applyInPandas(add, adds), f"kn-counts{k}", "shard", 1 << bits, "kind")
        of = made.part("model").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")]).first()
        stats.append(of.asDict())
        if found:
            found[-1].discard("answer")
        found.append(made)
        if k > 1:
            answers = made.part("answer").select("block", "shard", "data")
            asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(ask_shorter(k - 1), asks)
    found[-1].discard("answer")
    written.discard()
    return stats[::-1], found[::-1]


def _known(model, wanted, order: int):
    """Answer to wanted keys (sorted) of one order: how many, which of them are in the model
    (keys, counts), and the counts of those."""
    import numpy as np

    known, *columns = model or [np.empty(0, np.uint64)]
    if not len(known):
        return [np.array([len(wanted)]), np.zeros((len(wanted) + 7) // 8, np.uint8), *[np.empty(0, np.uint8)] * COLUMNS[order]]
    place = known.searchsorted(wanted)
    place[place == len(known)] = 0
    hit = known[place] == wanted
    place = place[hit]
    return [np.array([len(wanted)]), np.packbits(hit), *[c[place] for c in columns]]


#: Columns of counts by order: the longest n-grams are no contexts.
COLUMNS = {k: 1 if k == ORDER else 5 for k in range(1, ORDER + 1)}


def _found(answers):
    """By order the counts (rows of an array) of all keys that a block asked for, from the
    answers in the order of shards."""
    import numpy as np

    got, start, out = [_unpack(x) for x in answers], 0, []
    for k in range(1, ORDER + 1):
        end = start + 2 + COLUMNS[k]
        own = [g[start:end] for g in got]
        hit = np.concatenate([np.empty(0, bool), *[np.unpackbits(bits, count=int(n[0])).astype(bool) for n, bits, *_ in own]])
        counts = np.zeros((COLUMNS[k], len(hit)))
        for c in range(COLUMNS[k]):
            counts[c, hit] = np.concatenate([np.empty(0), *[o[2 + c] for o in own]])
        out.append(counts)
        start = end
    return out


def _chances(real, at, found, stats):
    """Probability of every real word. at: by order the position of every padded word's key
    among the block's; found: by order the counts of those keys, and as contexts the sums of
    counts and the n-grams of counts 1, 2, and more."""
    import numpy as np

    word = np.flatnonzero(real)
    n_words = sum(stats[0][c] for c in ("n1", "n2", "n3", "n4", "more"))
    if not n_words:
        return np.full(len(word), NO_MODEL)
    p = np.full(len(word), 1 / (n_words + 1))
    for k in range(1, ORDER + 1):
        of = stats[k - 1]
        less = np.array([0.0, *_discounts(of["n1"], of["n2"], of["n3"], of["n4"])])
        a = found[k - 1][0]
        cut = (a - less[np.minimum(a, 3).astype(np.int64)])[at[k - 1][word]]
        if k == 1:
            total, left = of["total"], of["n1"] * less[1] + of["n2"] * less[2] + (of["n3"] + of["n4"] + of["more"]) * less[3]
        else:
            context = at[k - 2][word - 1]
            total, left = found[k - 2][1][context], (less[1:] @ found[k - 2][2:])[context]
        # Without the context, the shorter one's probability stays.
        p = np.where(total > 0, (cut + left * p) / np.maximum(total, 1), p)
    return p


def score_sharded(docs: DataFrame, stats: list[dict], counts: list[common.Bucketed], bits: int, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every row, from what ``counts_sharded`` gives.

    A part of the documents a round asks the shards: what blocks send and get is on disk for
    one round only.
    """
    import numpy as np
    import pandas as pd

    # One row a shard, with its tables of every order.
    model = docs.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("shard"))
    for k, part in enumerate(counts, 1):
        model = model.join(part.part("model").select("shard", F.col("data").alias(f"data{k}")).hint("merge"), "shard", "left")

    def ask(batches):
        for batch in batches:
            for block, docs, words in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                padded, _ = _bordered(_words(words), backoff._documents(docs).column(2).to_numpy())
                keys = [ngrams.distinct(ngrams.gram_keys(padded, k)) for k in range(1, ORDER + 1)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(_questions(block, keys, bits)), QUESTIONS, preserve_index=False)

    def answer(key, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        wanted, out = [[_from_steps(x) for x in _unpack(g)] for g in asked["grams"]], [[] for _ in asked["grams"]]
        for k in range(1, ORDER + 1) if wanted else ():
            data = [x for x in own[f"data{k}"] if x is not None]
            table = _unpack(data[0]) if data else []
            if table:
                table[0] = _from_steps(table[0])
            for keys, to in zip(wanted, out, strict=True):
                to += _known(table, keys[k - 1], k)
        return pd.DataFrame({"block": asked["block"], "shard": key[0], "data": [_pack(x) for x in out]})

    def give(key, packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = backoff._documents(packed["docs"].iloc[0])
        sizes = own.column(2).to_numpy()
        padded, real = _bordered(_words(packed["words"].iloc[0]), sizes)
        chance = np.empty(0)
        if real.any():
            at = [ngrams.grouped(ngrams.gram_keys(padded, k))[1] for k in range(1, ORDER + 1)]
            chance = _chances(real, at, _found(answers.sort_values("shard")["data"]), stats)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.log(chance), len(sizes))
        with np.errstate(over="ignore"):
            perplexity = np.exp(-total / np.maximum(sizes, 1))
        out = pd.DataFrame({"doc_id": own.column(0).to_pandas(integer_object_nulls=True), "lang": own.column(1).to_pandas(), "n_words": sizes, "perplexity": perplexity})
        return out.assign(perplexity=out["perplexity"].astype(object).where(sizes > 0, None))

    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    turn, scored = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds)), None
    for k in range(rounds):
        written = common.Bucketed(rows.filter(turn == k).mapInArrow(_hashed_blocks, BLOCKS), "kn-round", "block")
        dealt = written.rows()
        asked = dealt.mapInArrow(ask, "shard int, block long, grams binary")
        answered = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(answer, "block long, shard int, data binary")
        given = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(give, "doc_id long, lang string, n_words long, perplexity double")
        part = common.materialize(given, "kn-scores")
        written.discard()
        scored = part if scored is None else scored.union(part)
    for part in counts:
        part.discard()
    return scored


def judge(scored: DataFrame, held_out: DataFrame) -> DataFrame:
    """Adds ``kept`` and ``limit_from`` to scored rows; held_out: doc_id of trusted rows
    outside the sample."""
    own = scored.filter("perplexity IS NOT NULL").join(held_out, "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", QUANTILE, QUANTILE_ACCURACY).alias("limit")
    by_lang = own.groupBy(F.col("lang").alias("_lang")).agg(limit, F.count("*").alias("n")).filter(F.col("n") >= MIN_TRUSTED).select("_lang", "limit")
    overall = own.agg(limit).first()["limit"]
    joined = scored.join(common.materialize(by_lang, "kn-limits"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("limit", F.lit(overall if overall is not None else math.inf))
    origin = F.when(F.col("limit").isNotNull(), "language").otherwise("none" if overall is None else "pooled")
    return joined.withColumn("kept", F.coalesce(F.col("perplexity") <= limit, F.lit(False))).withColumn("limit_from", origin)


def classify(docs: DataFrame, labels: DataFrame, train_docs: int | None = None) -> DataFrame:
    """doc_id, n_words, perplexity, kept, limit_from of every row of ``docs`` (doc_id, lang,
    text). The model is of all trusted texts that are not held out, or of about
    ``train_docs`` of them a language."""
    good = common.materialize(trusted(labels), "kn-trusted")
    ids = good.filter(~_held()) if train_docs is None else common.materialize(training_ids(docs, good, train_docs), "kn-ids")
    ids = F.broadcast(ids) if ids.count() <= 1_000_000 else ids
    if train_docs is None:
        chars = docs.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
        bits = max(0, math.ceil(math.log2(max(1, chars * ORDER / 24 / backoff.SHARD_KEYS))))
        rounds = max(1, min(ROUNDS, math.ceil(chars / ROUND_CHARS)))
        with common.shuffles_freed(docs.sparkSession):
            scored = score_sharded(docs, *counts_sharded(docs.join(ids, "doc_id", "left_semi"), bits), bits, rounds)
        rest = good.filter(_held())
    else:
        texts = common.materialize(training_texts(docs, ids), "kn-sample")
        scored = common.materialize(score(docs, fit(texts)), "kn-scores")
        rest = good.join(texts.select("doc_id"), "doc_id", "left_anti")
    return judge(scored, rest).select("doc_id", "n_words", "perplexity", "kept", "limit_from")


def op9_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    return classify(docs, common.bare(common.table(spark, sf_dir, "labels"), "doc_id", "quality"))
