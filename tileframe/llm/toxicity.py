"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters in lower case; a chain is a document. Each token has a tag
(other, toxic) scored by hashed features of the word (itself, its first three to five
letters, its last three) and by the tag before it.

Labels are of documents, so tokens are labelled by evidence: a feature is a seed
where enough different toxic training documents hold it and next to no other
document does; in toxic documents, tokens with a seed are toxic. Training documents
that mostly repeat earlier ones do not count as evidence. The field is trained on
all tokens of four fifths of the training documents by stochastic gradient steps
(Adagrad), the gradient coming from forward-backward marginals. A document's score is
its largest marginal, mapped by a logistic fitted on the last fifth; offsets of the tokens
with a marginal of one half or more, neighbours joined, are the offending spans.

Forward and backward sums of a chain are products of 2 x 2 matrices, so a chain is cut
into chunks of ``CHUNK`` tokens whose products are made side by side, then joined chunk
by chunk: marginals are those of the whole document.

The model is fitted on a bounded sample: ``TRAIN_DOCS`` labelled documents a class and
``TRAIN_CHARS`` characters of them, in the order of a hash of the id among all labelled
rows, one row an id; texts beyond a tenth of that are passed over. Only its weights go to
tasks.

Defined cases: null and empty texts get the score of a text without toxic tokens; a very
long text is one chain and is scored whole, in a batch of its own; a document with
several labels is toxic if one says so; null labels and null ids of labels are not used;
without labels of both classes every score is the share of toxic training rows, below
one half; repeated and null ids are scored row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 2500
TRAIN_CHARS = 10_000_000
CHUNK = 64
BUCKETS = 1 << 18
SEED_DOCS = 5
SEED_ODDS = 30.0
#: Passes over the training chains, and gradient steps, at least; tokens of a step.
EPOCHS = 4
STEPS = 200
BATCH_TOKENS = 16_384
#: Tokens that a task works on at a time, unless a single text is longer.
TASK_TOKENS = 200_000
HOLDOUT = 5
TOKEN = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 500_000
SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int>>"


def _features(word: str) -> list[int]:
    names = ("w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "e" + word[-3:])
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Chains:
    """Forward-backward sums of documents of the given lengths, whose tokens follow each
    other in flat arrays. Arrays here are (CHUNK, chunks); the places of a document's
    last chunk that have no token pass on what comes in."""

    def __init__(self, lengths):
        import numpy as np

        per = -(-lengths // CHUNK)
        self.doc = np.repeat(np.arange(len(lengths)), per)
        first = np.cumsum(lengths) - lengths
        self.nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        inside = self.nth * CHUNK + np.arange(CHUNK)[:, None]
        self.real = inside < lengths[self.doc]
        self.at = np.where(self.real, first[self.doc] + inside, 0)
        self.opens = inside == 0
        # Chunks by their place in the document: levels[k] holds the k-th ones.
        order = np.argsort(self.nth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.nth))[:-1]) if len(order) else []

    def sums(self, emission, step, start):
        """m: matrix into each token (2, 2, ...); a, b: forward and backward sums (2, ...)
        up to a factor; before: forward sums before each token."""
        import numpy as np

        x = np.where(self.real, emission[self.at] if len(emission) else 0.0, 0.0)
        x = np.exp(np.clip(x, -40, 40))
        scale = 1 / np.maximum(x, 1)
        t, s = np.exp(step - step.max()), np.exp(start - start.max())
        m = np.empty((2, 2, *x.shape))
        for i in (0, 1):
            for j in (0, 1):
                m[i, j] = np.where(self.opens, s[j], t[i, j]) * scale * (x if j else 1)
                m[i, j][~self.real] = float(i == j)
        f = np.empty_like(m)
        f[:, :, 0] = m[:, :, 0]
        for k in range(1, CHUNK):
            now = f[:, 0, k - 1][:, None] * m[0, :, k][None] + f[:, 1, k - 1][:, None] * m[1, :, k][None]
            f[:, :, k] = now / now.sum((0, 1))
        whole = f[:, :, -1]
        enter, leave = np.ones((2, len(self.doc))), np.ones((2, len(self.doc)))
        for level in self.levels[1:]:
            out = enter[0, level - 1] * whole[0][:, level - 1] + enter[1, level - 1] * whole[1][:, level - 1]
            enter[:, level] = out / out.sum(0)
        for level in self.levels[:0:-1]:
            back = whole[:, 0, level] * leave[0, level] + whole[:, 1, level] * leave[1, level]
            leave[:, level - 1] = back / back.sum(0)
        a = enter[0] * f[0] + enter[1] * f[1]
        b = np.empty_like(a)
        b[:, -1] = leave
        for k in range(CHUNK - 2, -1, -1):
            now = m[:, 0, k + 1] * b[0, k + 1] + m[:, 1, k + 1] * b[1, k + 1]
            b[:, k] = now / now.sum(0)
        before = np.concatenate([enter[:, None], a[:, :-1]], axis=1)
        return m, a, b, before

    def toxic(self, a, b):
        """P(toxic) in the shape of the chunks."""
        both = a * b
        return both[1] / (both[0] + both[1])


def marginals(emission, lengths, step, start):
    """P(toxic) of each token of documents of these lengths. emission: scores of toxic
    against other; step: (2, 2) scores from tag to tag; start: (2,)."""
    import numpy as np

    out = np.zeros(int(lengths.sum()))
    chains = Chains(lengths)
    _, a, b, _ = chains.sums(emission, step, start)
    out[chains.at[chains.real]] = chains.toxic(a, b)[chains.real]
    return out


def _largest(p, lengths):
    """Largest of each document's values; LEAST for documents without tokens."""
    import numpy as np

    best = np.full(len(lengths), LEAST)
    np.maximum.at(best, np.repeat(np.arange(len(lengths)), lengths), p)
    return np.clip(best, LEAST, 1 - LEAST)


LEAST = 1e-9


def _evidence(docs: list[list[str]], labels):
    """Seed features: (name kinds are hashed) -> set of buckets."""
    import numpy as np

    seen: set[int] = set()
    counts = np.zeros((2, BUCKETS))
    totals = [0, 0]
    known: dict[str, list[int]] = {}
    for words, label in zip(docs, labels, strict=True):
        grams = {hash(g) for g in zip(words, words[1:], words[2:], strict=False)}
        if grams and len(grams & seen) * 2 > len(grams):
            continue
        seen |= grams
        own = set()
        for w in set(words):
            own.update(known.get(w) or known.setdefault(w, _features(w)))
        counts[label, list(own)] += 1
        totals[label] += 1
    rates = [(counts[k] + 0.5) / (totals[k] + 1) for k in (0, 1)]
    return np.flatnonzero((counts[1] >= SEED_DOCS) & (rates[1] >= SEED_ODDS * rates[0]) & (counts[0] <= 0.001 * totals[0]))


def _platt(best, labels):
    """(slope, shift) of a logistic of the logit of the largest marginal."""
    import numpy as np

    x = np.log(best / (1 - best))
    a, b = 1.0, 0.0
    y = np.clip(labels.astype(float), 0.01, 0.99)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + 1e-3 * (a - 1), (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(0.05, a - move[0]), b - move[1]
    return float(a), float(b)


def train(texts: list[str | None], labels: list[int]) -> dict:
    """weights (bucket -> score), bias, step, start, slope, shift."""
    import numpy as np

    labels = np.array(labels, np.int64)
    base = {"weights": np.zeros(BUCKETS, np.float32), "bias": -8.0, "step": np.zeros((2, 2)), "start": np.zeros(2), "slope": 0.0, "shift": math.log(0.01 / 0.99)}
    if len(set(labels.tolist())) < 2:
        return base
    docs = [tokens(t) for t in texts]
    lengths = np.array([len(d) for d in docs])
    rng = np.random.default_rng(0)
    aside = rng.permutation(len(docs)) % 5 == 0
    if len(set(labels[aside].tolist())) < 2 or len(set(labels[~aside].tolist())) < 2:
        aside[:] = False
    seeds = np.zeros(BUCKETS, bool)
    seeds[_evidence([d for d, off in zip(docs, aside, strict=True) if not off], labels[~aside])] = True
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for d in docs for w in d], np.int64)
    feats = np.array([_features(w) for w in known] or [[0] * 5], np.int64)
    toxic = seeds[feats].any(1)[flat] & np.repeat(labels, lengths).astype(bool)
    ends = np.cumsum(lengths)
    chosen = np.flatnonzero(~aside & (lengths > 0))
    w, bias, step, start = np.zeros(BUCKETS), -3.0, np.zeros((2, 2)), np.zeros(2)
    sums = [np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    for _ in range(max(EPOCHS, -(-STEPS * BATCH_TOKENS // max(1, int(lengths[chosen].sum()))))):
        rng.shuffle(chosen)
        upto = np.cumsum(lengths[chosen])
        for part in np.split(chosen, np.flatnonzero(np.diff(upto // BATCH_TOKENS)) + 1):
            at = np.concatenate([np.arange(ends[d] - lengths[d], ends[d]) for d in part])
            words = feats[flat[at]]
            chains = Chains(lengths[part])
            m, a, b, before = chains.sums(w[words].sum(1) + bias, step, start)
            y = toxic[at][chains.at] & chains.real
            off = np.where(chains.real, chains.toxic(a, b) - y, 0.0)
            each = np.zeros(len(at))
            each[chains.at[chains.real]] = off[chains.real]
            grad = np.bincount(words.ravel(), np.repeat(each, 5), BUCKETS) + 1e-4 * w
            inner = chains.real & ~chains.opens
            joint = before[:, None] * m * b[None]
            joint = joint / joint.sum((0, 1))
            was = np.zeros_like(y)
            was[1:] = y[:-1]
            was[0, chains.nth > 0] = y[-1, np.flatnonzero(chains.nth > 0) - 1]
            moved = np.array([[((joint[i, j] - ((was == bool(i)) & (y == bool(j)))) * inner).sum() for j in (0, 1)] for i in (0, 1)])
            first = off[chains.opens].sum()
            grads = (grad, off.sum(), moved + 1e-2 * step, np.array([-first, first]))
            old = (w, bias, step, start)
            sums = [total + g * g for total, g in zip(sums, grads, strict=True)]
            w, bias, step, start = (v - 0.5 * g / np.sqrt(total) for v, g, total in zip(old, grads, sums, strict=True))
    model = base | {"weights": w.astype(np.float32), "bias": float(bias), "step": step, "start": start}
    judged = np.flatnonzero(aside) if aside.any() else np.arange(len(docs))
    best = np.full(len(judged), LEAST)
    for k in range(0, len(judged), 500):
        part = judged[k : k + 500]
        at = np.concatenate([np.arange(ends[d] - lengths[d], ends[d]) for d in part])
        best[k : k + 500] = _largest(marginals(w[feats[flat[at]]].sum(1) + bias, lengths[part], step, start), lengths[part])
    model["slope"], model["shift"] = _platt(best, labels[judged])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, toxic (boolean), text: the bounded sample."""
    place = F.crc32(F.concat(F.lit("tox:"), F.col("doc_id").cast("string")))
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("place", place)
    counts = known.groupBy("toxic").agg(F.count("*").alias("of"))
    near = known.join(F.broadcast(counts), "toxic").filter(F.col("place") <= F.lit(2**32) * F.lit(train_docs) / F.col("of"))
    # About train_docs ids a class by the hash, and no more than twice as many.
    ids = near.select("doc_id", "toxic", "place").orderBy("place", "doc_id").limit(4 * train_docs)
    one = docs.select("doc_id", "text").filter(F.length("text") <= train_chars // 10).join(F.broadcast(ids), "doc_id")
    one = one.groupBy("doc_id", "toxic", "place").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("s"))
    by_class = Window.partitionBy("toxic").orderBy("place", "doc_id")
    ranked = one.select("doc_id", "toxic", "s.text", F.row_number().over(by_class).alias("rank"), F.sum(F.length("s.text")).over(by_class).alias("upto"))
    return ranked.filter((F.col("rank") <= train_docs) & (F.col("upto") <= train_chars)).select("doc_id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """A model from doc_id, text and labels (doc_id, toxic)."""
    rows = sorted(training_rows(docs, labels, train_docs).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def _sparse(model: dict) -> dict:
    """The model as it goes to the tasks: without the weights that are zero."""
    import numpy as np

    at = np.flatnonzero(np.abs(model["weights"]) > 1e-4)
    return model | {"weights": None, "at": at, "values": model["weights"][at]}


def tag(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans (start, end in code points of the text) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(_sparse(model))

    def run(batches):
        import numpy as np

        m = sent.value
        weights = np.zeros(BUCKETS)
        weights[m["at"]] = m["values"]
        known: dict[str, float] = {}

        def emission(word: str) -> float:
            value = known[word] = float(weights[_features(word)].sum() + m["bias"])
            return value

        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [tokens(t) for t in texts]
            if len(known) > KEPT_WORDS:
                known.clear()
            for k, end in _groups(found):
                part = found[k:end]
                lengths = np.array([len(d) for d in part], np.int64)
                scores = np.array([s if (s := known.get(w)) is not None else emission(w) for d in part for w in d], np.float64)
                p = marginals(scores, lengths, m["step"], m["start"])
                best = _largest(p, lengths)
                score = 1 / (1 + np.exp(-np.clip(m["slope"] * np.log(best / (1 - best)) + m["shift"], -60, 60)))
                starts = np.concatenate([[0], np.cumsum(lengths)])
                spans = [_spans(text, p[starts[i] : starts[i + 1]] >= 0.5) if best[i] >= 0.5 else [] for i, text in enumerate(texts[k:end])]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, end - k), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _groups(found):
    """Slices of the list with at most TASK_TOKENS tokens, or one text."""
    start = size = 0
    for k, own in enumerate(found):
        if k > start and size + len(own) > TASK_TOKENS:
            yield start, k
            start, size = k, 0
        size += len(own)
    if start < len(found):
        yield start, len(found)


def _spans(text: str, flagged) -> list[dict]:
    """Offsets of flagged tokens, neighbours joined. A lower-cased text of another
    length is searched token by token from the last place."""
    low = text.lower()
    places = [(m.start(), m.end()) for m in TOKEN.finditer(low)]
    if len(low) != len(text):
        back = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
        places = [(back[a], back[b]) for a, b in places]
    out: list[dict] = []
    last = -2
    for k in flagged.nonzero()[0]:
        start, end = places[k]
        if k == last + 1:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end})
        last = k
    return out


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = common.bare(common.table(spark, sf_dir, "labels"), "doc_id", "toxic")
    model = fit(docs, labels.filter(common.crc_mod(F.col("doc_id"), HOLDOUT) != 0))
    scored = tag(docs, model).withColumn("held_out", common.crc_mod(F.col("doc_id"), HOLDOUT) == 0)
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), written.alias("spans"))
