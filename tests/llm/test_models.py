"""Language models, toxicity, language identification, search, token codec."""

import itertools
import math
import random
import re
import struct
import zlib
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from tileframe.llm import backoff, common, kneser_ney, langid, metric_tree, ngrams, pieces, toxicity

# Stupid backoff


def brute_backoff(rows, order):
    words = [(t or "").encode().split() for _, t in rows]
    counts = [{} for _ in rows]
    for own, ws in zip(counts, words, strict=True):
        for k, j in itertools.product(range(1, order + 1), range(len(ws))):
            if j >= k - 1:
                g = tuple(ws[j - k + 1 : j + 1])
                own[g] = own.get(g, 0) + 1
    total = {}
    for own in counts:
        for g, n in own.items():
            total[g] = total.get(g, 0) + n
    out = []
    for (doc_id, _), own, ws in zip(rows, counts, words, strict=True):
        other = lambda g: total[g] - own.get(g, 0) if g in total else 0  # noqa: E731, B023
        outside = max(1, sum(map(len, words)) - len(ws))

        def score(g):
            if len(g) == 1:
                return math.log(max(other(g), 1) / outside)  # noqa: B023
            return math.log(other(g) / other(g[:-1])) if other(g) > 0 else math.log(0.4) + score(g[1:])

        out.append((doc_id, len(ws), sum(score(tuple(ws[max(0, j - order + 1) : j + 1])) for j in range(len(ws)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, odd, order, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_CHARS", 40)
    monkeypatch.setattr(backoff, "SHARD_KEYS", 2_000)  # most blocks have no key of most shards
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(50 + k, "one two three tie tie word1 and word2 and") for k in range(3)]
    docs = odd.select("doc_id", "text", "block").union(spark.createDataFrame([(*r, 1) for r in rows[-3:]], "doc_id long, text string, block int"))
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["log_score"]) for r in backoff.score(docs, order).collect()))
    want = sorted((d or 0, n, s) for d, n, s in brute_backoff(rows, order))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-6, rel=1e-9)


def test_backoff_of_nothing(no_docs):
    assert backoff.score(no_docs).count() == 0


# Kneser-Ney


def plain_kneser_ney(texts):
    """p(word | two words before) as dictionaries, straight from the definition."""
    grams = []
    for t in texts:
        ws = ["<", "<", *t.split()]
        grams += [tuple(ws[k - 2 : k + 1]) for k in range(2, len(ws))]
    counts = {3: {}}
    for g in grams:
        counts[3][g] = counts[3].get(g, 0) + 1
    for k in (2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    less, total, mass = {}, {}, {}
    for k in (1, 2, 3):
        of = [sum(n == j for n in counts[k].values()) for j in (1, 2, 3, 4)]
        less[k] = kneser_ney._discounts(*of)
        for g, n in counts[k].items():
            total[g[:-1], k] = total.get((g[:-1], k), 0) + n
            mass[g[:-1], k] = mass.get((g[:-1], k), 0) + less[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        if (g[:-1], k) not in total:
            return p(g[1:])
        n = counts[k].get(g, 0)
        own = n - less[k][min(n, 3) - 1] if n else 0
        return (own + mass[g[:-1], k] * p(g[1:])) / total[g[:-1], k]

    return p


def test_kneser_ney_probabilities(spark):
    texts = ["a b a b c", "a b c a", "b c d", "a a a a b", "e", "c a b a b c d e a"]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = plain_kneser_ney(texts)
    asked = ["a b c", "z a b", "d e z", "a z z b", "", None]
    got, sizes = kneser_ney.log_probabilities(model, asked)
    for t, g, n in zip(asked, got, sizes, strict=True):
        ws = ["<", "<", *(t or "").split()]
        assert n == len(ws) - 2
        assert g == pytest.approx(sum(math.log(p(tuple(ws[k - 2 : k + 1]))) for k in range(2, len(ws))), abs=1e-4)
    assert sum(p(("a", "b", w)) for w in "abcde") + p(("a", "b", "?")) == pytest.approx(1)


def test_kneser_ney_keeps_the_trusted(spark, odd, no_docs, no_labels):
    good = [(k, "en", f"the cat {k % 5} sat on the mat and the dog {k % 7} ran to the house") for k in range(400)]
    bad = [(1000 + k, "en", " ".join(f"zq{k}x{j}" for j in range(14))) for k in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in kneser_ney.classify(docs, labels, train_docs=200).filter("kept").collect()}
    assert len(kept & set(range(400))) >= 390 and not kept & set(range(1000, 1020))
    without = {(r["doc_id"], r["kept"]) for r in kneser_ney.classify(odd, no_labels).collect()}
    assert without == {(1, True), (2, False), (3, False), (4, False), (None, True), (5, True), (6, True), (7, True), (8, True)}
    assert kneser_ney.classify(no_docs, no_labels).count() == 0


def test_kneser_ney_small_languages_have_own_limits(spark):
    rng = random.Random(5)
    noise = lambda: " ".join(f"w{rng.randrange(90)}" for _ in range(30))
    rows = [(k, "en", f"the cat {k % 5} sat on the mat and the dog {k % 7} ran to the house") for k in range(400)]
    rows += [(1000 + k, None, noise()) for k in range(400)]
    rows += [(2000 + k, "fr", f"le chat {k % 5} dort") for k in range(20)]
    rows += [(3000 + k, "en", noise()) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 3000).cast("int").alias("quality"))
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, labels).collect()}
    # The null language's limit, far above that of "en", does not keep its garbled rows.
    assert not any(got[3000 + k]["kept"] for k in range(20))
    assert sum(got[1000 + k]["kept"] for k in range(400)) >= 380 and sum(got[k]["kept"] for k in range(400)) >= 380
    assert [got[d]["limit_from"] for d in (0, 1000, 2000, 3000)] == ["language", "language", "pooled", "language"]


def test_kneser_ney_sample_is_bounded_in_words(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MAX_GRAMS", 3000)
    rows = [(k, "en", " ".join(f"e{k}x{j}" for j in range(40 if k else 5000))) for k in range(60)]
    rows += [(100 + k, "fr", f"le chat {k} dort") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert kneser_ney.classify(docs, labels).filter("perplexity > 0").count() == 80
    every = docs.withColumn("text", F.when(F.col("doc_id") < 100, "a " * 5000).otherwise(F.col("text")))
    sample = kneser_ney.training_texts(every, docs.select("doc_id")).collect()
    n = {lang: sum(len(r["text"].split()) for r in sample if r["lang"] == lang) for lang in ("en", "fr")}
    # The language with few words is whole, the other one is cut within a text.
    assert n["fr"] == 80 and 400 <= n["en"] <= 920
    assert all(r["doc_id"] >= 100 or len(r["text"].split()) < 5000 for r in sample)


def test_kneser_ney_is_of_all_trusted_texts(spark, monkeypatch):
    """More trusted texts than any sample: no word of theirs is unknown to the model."""
    monkeypatch.setattr(backoff, "BLOCK_CHARS", 4_000)
    monkeypatch.setattr(backoff, "SHARD_KEYS", 2_000)
    rows = [(k, "en", f"the word{k} of text{k} is here") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    held = dict(docs.select("doc_id", kneser_ney._held()).collect())
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == 2000
    assert max(x for d, x in got.items() if not held[d]) < min(x for d, x in got.items() if held[d])
    p = plain_kneser_ney([t for d, _, t in rows if not held[d]])
    for d in (next(d for d in held if held[d]), next(d for d in held if not held[d])):
        ws = ["<", "<", *rows[d][2].split()]
        assert got[d] == pytest.approx(math.exp(-sum(math.log(p(tuple(ws[k - 2 : k + 1]))) for k in range(2, len(ws))) / (len(ws) - 2)), rel=1e-4)


def test_kneser_ney_tables_are_packed(spark, monkeypatch):
    """No table takes a row of keys an n-gram, and shuffle files are freed only meanwhile."""
    sizes, write = {}, common.materialize

    def weighed(df, name):
        out = write(df, name)
        size = sum(f.stat().st_size for f in Path(urlparse(out._written_to).path).rglob("*.parquet"))
        sizes[name] = max(size, sizes.get(name, 0))
        return out

    monkeypatch.setattr(common, "materialize", weighed)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng, before = random.Random(3), spark.conf.get(setting)
    rows = [(k, "en", " ".join(f"w{rng.randrange(50_000)}" for _ in range(300))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert kneser_ney.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count() == 200
    assert max(sizes.values()) < 20 * 60_000
    assert spark.conf.get(setting) == before


def test_kneser_ney_rounds_shuffle_no_tables(spark, monkeypatch):
    """Scoring reads the model's tables and the blocks in their buckets."""
    plans, write = [], common.materialize

    def planned(df, name):
        if name == "kn-scores":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(common, "materialize", planned)
    monkeypatch.setattr(backoff, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(backoff, "SHARD_KEYS", 500)
    monkeypatch.setattr(kneser_ney, "ROUND_CHARS", 2_000)
    texts = [f"the word{k} of text{k} is here" for k in range(300)]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = kneser_ney.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert len(got) == 300 and all(r["perplexity"] > 0 for r in got)
    assert len(plans) == 5  # 8,780 characters
    for plan in plans:
        assert plan.count("Bucketed: true") == kneser_ney.ORDER + 2  # blocks ask and are given
        # Questions, answers, and the list of shards.
        assert plan.count("Exchange hashpartitioning") == 3


def test_kneser_ney_buckets_are_packed(spark, monkeypatch):
    sizes, write = {}, common.Bucketed.__init__

    def weighed(self, df, name, *args):
        write(self, df, name, *args)
        sizes[name] = sum(f.stat().st_size for f in Path(urlparse(self.path).path).rglob("*.parquet"))

    monkeypatch.setattr(common.Bucketed, "__init__", weighed)
    rng = random.Random(3)
    rows = [(k, "en", " ".join(f"w{rng.randrange(50_000)}" for _ in range(300))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert kneser_ney.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count() == 200
    assert {"kn-blocks", "kn-counts3", "kn-counts2", "kn-counts1", "kn-round"} == set(sizes)
    assert max(sizes.values()) < 20 * 60_000


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_distinct_and_grouped_numbers(n):
    x = np.random.default_rng(n).integers(0, max(1, n // 3), n).astype(np.uint64) << np.uint64(50)
    keys, at = np.unique(x, return_inverse=True)
    assert ngrams.distinct(x).tolist() == keys.tolist()
    got, places, one = ngrams.grouped(x)
    assert got.tolist() == keys.tolist() == x[one].tolist() and places.tolist() == at.tolist()


def test_kneser_ney_equals_plain_python(spark, sf_mid, tmp_path):
    """The whole query against plain code: trusted rows, held-out share, model, limits."""
    rows = [tuple(r) for r in common.table(spark, sf_mid, "documents").select("doc_id", "lang", "text").collect()]
    rows += [(90001, None, "words of no language"), (90002, "en", None), (90003, "en", ""), (90004, "xx", "!? " * 3000), rows[0]]
    votes = [tuple(r) for r in common.table(spark, sf_mid, "labels").select("doc_id", "quality").collect()]
    votes += [(90001, 1), (90001, 0), (90003, 1), (90004, None), (None, 1), votes[0]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(votes, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    held = dict(docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("kn-held")), F.lit(kneser_ney.HELD_SHARE)) == 0).collect())
    quality = {}
    for d, q in votes:
        if d is not None and q is not None:
            quality[d] = min(q, quality.get(d, 1))
    good = {d for d, q in quality.items() if q == 1}
    # So few labelled documents are all in the sample, but for the held-out share.
    p = plain_kneser_ney([t or "" for d, _, t in rows if d in good and not held[d]])

    def perplexity(text):
        ws = ["<", "<", *(text or "").split()]
        return math.exp(-sum(math.log(p(tuple(ws[k - 2 : k + 1]))) for k in range(2, len(ws))) / (len(ws) - 2)) if len(ws) > 2 else None

    scored = [(d, lang, perplexity(t)) for d, lang, t in rows]
    trusted = {lang: sorted(x for d, of, x in scored if of == lang and d in good and held[d] and x is not None) for lang in {r[1] for r in rows}}
    pooled = sorted(itertools.chain(*trusted.values()))
    at = lambda xs: xs[math.ceil(kneser_ney.QUANTILE * len(xs)) - 1]
    limits = {lang: at(own) if len(own) >= kneser_ney.MIN_TRUSTED else at(pooled) for lang, own in trusted.items()}
    got = sorted(kneser_ney.op9_quality_perplexity(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows) and {r["kept"] for r in got} == {True, False}
    for r, (d, lang, x) in zip(got, sorted(scored, key=lambda s: s[0]), strict=True):
        assert r["doc_id"] == d
        if x is None:
            assert r["perplexity"] is None and not r["kept"]
        else:
            assert r["perplexity"] == pytest.approx(x, rel=1e-4)
            # A document at the limit itself may fall on either side by rounding.
            assert r["kept"] == (x <= limits[lang]) or x == pytest.approx(limits[lang], rel=1e-4)
            assert r["limit_from"] == ("language" if len(trusted[lang]) >= kneser_ney.MIN_TRUSTED else "pooled")


# Language identification


def test_language_id(spark, sf_mid):
    from tileframe.llm.langid import op6_language_id

    lang = common.table(spark, sf_mid, "documents").select("doc_id", "lang")
    got = op6_language_id(spark, sf_mid).filter("held_out").join(lang, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_odd_rows(odd, no_docs):
    known = {"en": b"one two three four and the word tie lost with id " * 9, "fr": "été où ça éè ÄÖÜ".lower().encode() * 9}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.classify(odd, known).collect()}
    assert (got[1], got[2], got[3], got[4], got[8]) == ("en", "und", "und", "und", "fr")
    assert {r["lang_pred"] for r in langid.classify(odd, {}).collect()} == {"und"}
    assert langid.classify(no_docs, known).count() == 0
    assert langid.fit(no_docs) == {}
    assert set(langid.fit(odd)) == {"en", "de", "fr"}


def test_language_id_ties(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "zzz")], "doc_id long, text string")
    same = b"one two three four five " * 9
    assert [r["lang_pred"] for r in langid.classify(docs, {"b": same, "a": same}).collect()] == ["a"] * 3
    assert {r["score"] for r in langid.classify(docs, {"b": same, "a": same}).collect()} == {0.5}


def test_language_id_equals_plain_python(spark, sf_small, tmp_path):
    """The whole query against plain code: sample, dictionaries, sizes."""
    rows = [tuple(r) for r in common.table(spark, sf_small, "documents").select("doc_id", "lang", "text").collect()]
    rows += [(90001, None, "words of no language"), (90002, "en", None), (90004, "xx", "!?"), (90005, "en", "word " * 40_000)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda t: zlib.crc32(t.encode())
    own = lambda t: regex.sub(r"\P{L}+", " ", t.lower())
    learned = {}
    for lang in {r[1] for r in rows} - {None}:
        usable = sorted((crc(f"lid:{d}"), d, t) for d, x, t in rows if x == lang and t is not None and crc(str(d)) % 3 != 1 and len(t) <= langid.SAMPLE_CHARS)
        ends = list(itertools.accumulate(len(t) for _, _, t in usable))
        if parts := [own(t) for (_, _, t), end in zip(usable, ends, strict=True) if end <= langid.SAMPLE_CHARS]:
            learned[lang] = zstandard.ZstdCompressionDict("\n".join(parts).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            learned[lang].precompute_compress(level=langid.LEVEL)

    def size(lang, data):
        pack = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=learned[lang], write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(pack.compress(data[k : k + langid.PIECE_BYTES])) for k in range(0, len(data), langid.PIECE_BYTES))

    got = {r["doc_id"]: r for r in langid.op6_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, _, text in rows:
        r = got[doc_id]
        assert r["held_out"] == (crc(str(doc_id)) % 3 == 1)
        if not text or not regex.search(r"\p{L}", text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            sizes = {lang: size(lang, own(text).encode()) for lang in learned}
            assert sizes[r["lang_pred"]] == min(sizes.values())


def test_language_id_of_an_empty_table(spark, sf_small, tmp_path):
    common.table(spark, sf_small, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert langid.op6_language_id(spark, str(tmp_path)).count() == 0


# Toxicity


def enumerated(e, step, start):
    weight = {}
    for tags in itertools.product((0, 1), repeat=len(e)):
        s = start[tags[0]] + sum(e[k] for k in range(len(e)) if tags[k]) + sum(step[a, b] for a, b in itertools.pairwise(tags))
        weight[tags] = math.exp(s)
    total = sum(weight.values())
    return [sum(w for tags, w in weight.items() if tags[k]) / total for k in range(len(e))]


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 3)  # documents of one to four chunks
    rng = np.random.default_rng(1)
    lengths = np.array([6, 0, 1, 10, 3, 7])
    e, step, start = rng.normal(size=27) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    want = [p for a, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True) if n for p in enumerated(e[a : a + n], step, start)]
    assert toxicity.marginals(e, lengths, step, start) == pytest.approx(want)
    assert len(toxicity.marginals(e[:0], np.array([0, 0]), step, start)) == 0


def plain_toxicity(text, model):
    """(score, spans) by log-sums over the whole chain, token by token."""
    low = (text or "").lower()
    found = list(re.finditer(r"[^\W\d_]+", low))
    e = [float(model["weights"][toxicity._features(m[0])].astype(float).sum() + model["bias"]) for m in found]
    add, step, start = np.logaddexp, model["step"], model["start"]
    ahead, back = [], [(0.0, 0.0)]
    for k, x in enumerate(e):
        o, t = ahead[-1] if k else (None, None)
        ahead.append((add(o + step[0, 0], t + step[1, 0]), add(o + step[0, 1], t + step[1, 1]) + x) if k else (start[0], start[1] + x))
    for x in e[:0:-1]:
        o, t = back[0]
        back.insert(0, (add(step[0, 0] + o, step[0, 1] + t + x), add(step[1, 0] + o, step[1, 1] + t + x)))
    p = [1 / (1 + math.exp(min(700, max(-700, (a[0] + b[0]) - (a[1] + b[1]))))) for a, b in zip(ahead, back, strict=False)]
    best = min(1 - 1e-9, max([1e-9, *p]))
    score = 1 / (1 + math.exp(-(model["slope"] * math.log(best / (1 - best)) + model["shift"])))
    spans, last = [], -2
    for k, (m, x) in enumerate(zip(found, p, strict=True)):
        if x >= 0.5:
            spans = [*spans[:-1], (spans[-1][0], m.end())] if last == k - 1 else [*spans, m.span()]
            last = k
    return score, spans


def test_toxicity_equals_plain_python(spark, sf_small):
    """The whole query against plain code with the same model."""
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf_small, "labels").collect()}
    rows = common.table(spark, sf_small, "documents").select("doc_id", "text").collect()
    split = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    sample = sorted((d, t) for d, t in rows if t and d in labels and not split(d))
    model = toxicity.train([t for _, t in sample], [int(labels[d] > 0) for d, _ in sample])
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, sf_small).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        score, spans = plain_toxicity(text, model)
        r = got[doc_id]
        assert r["held_out"] == split(doc_id) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["score"] == pytest.approx(score, abs=1e-4)
        assert r["spans"] == ",".join(f"{a}:{b}" for a, b in spans) and r["n_spans"] == len(spans)


def test_toxicity_sample_is_bounded(spark):
    rows = [(k % 400, "word " * (1 + k % 7)) for k in range(2000)] + [(k, "x" * 5000) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.training_rows(docs, labels, 60, 2000).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    for toxic in (True, False):
        own = [r["text"] for r in got if r["toxic"] == toxic]
        assert 20 < len(own) <= 60 and sum(map(len, own)) <= 2000 and max(map(len, own)) <= 200


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(5)
    words = [a + b + c for a in "bdfgk" for b in ("ata", "elo", "ini", "uro") for c in "lmnprstz"]
    clean = [" ".join(rng.choice(words, 40)) for _ in range(150)]
    foul = [" ".join([*rng.choice(words, 20), rng.choice(["vileness", "vilest", "scumbag"]), *rng.choice(words, 20)]) for _ in range(150)]
    return toxicity.train([*clean, *foul], [0] * 150 + [1] * 150)


def test_toxic_documents_and_spans(spark, toxic_model):
    rows = [(1, "batal delom Vilest finin"), (2, "batal delom finin"), (3, "É İ😀 SCUMBAG scumbag, gurop " + "kuroz " * 300 + "vileness")]
    got = {r["doc_id"]: r for r in toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string"), toxic_model).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[3]["score"] > 0.5
    assert [rows[0][1][s["start"] : s["end"]] for s in got[1]["spans"]] == ["Vilest"]
    assert [rows[2][1][s["start"] : s["end"]] for s in got[3]["spans"]] == ["SCUMBAG scumbag", "vileness"]
    assert got[2]["spans"] == []


def test_toxicity_of_odd_rows(odd, no_docs, no_labels, toxic_model):
    got = toxicity.tag(odd, toxic_model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.tag(no_docs, toxic_model).count() == 0
    model = toxicity.fit(odd, no_labels)
    assert all(r["score"] < 0.5 for r in toxicity.tag(odd, model).collect())


def test_toxicity_held_out(spark, sf_mid):
    labels = common.table(spark, sf_mid, "labels").select("doc_id", "toxic")
    got = toxicity.op5_toxicity(spark, sf_mid).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)


# Search


def brute_top(rows, top):
    """rows: (id or None, ints)."""
    out = []
    for k, (q, x) in enumerate(rows):
        if q is not None and q % metric_tree.EVERY == 0:
            scored = [(-sum(a * b for a, b in zip(x, y, strict=False)), v is None, v or 0, v) for j, (v, y) in enumerate(rows) if j != k]
            out += [(q, at, v, -s) for at, (s, _, _, v) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def searched(df, top=20):
    found = metric_tree.top_scores(metric_tree.integer_vectors(df), F.col("vec_id") % metric_tree.EVERY == 0, top)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize(("n", "spread", "top"), [(700, 40, 20), (700, 1, 20), (15, 9, 20), (300, 0, 5)])
def test_search(spark, n, spread, top, monkeypatch):
    monkeypatch.setattr(metric_tree, "SHARD_ROWS", 250)
    monkeypatch.setattr(metric_tree, "QUERY_ROWS", 10)
    rng = np.random.default_rng(n + spread)
    x = rng.integers(-spread, spread + 1, (n, 6))
    # Some ids are repeated, some are null.
    rows = [(None if k % 37 == 5 else int((k - k % 7 // 6) * 2 - 300), [int(a) for a in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame([(k, [a / 64 for a in v]) for k, v in rows], "vec_id long, embedding array<float>")
    assert searched(df, top) == brute_top(rows, top)


def test_search_equals_sql_with_repeated_ids(spark, tmp_path):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.5]), (None, [3.0, 0.0]), (40, None), (60, [float("inf"), 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT query_id, rank, vec_id, score FROM ({metric_tree.OP8_SQL})").fetchall()
    got = metric_tree.op8_top_scores(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert (20, 1, 1, 12288) in want and len(want) == 3 * 6


def test_search_prunes():
    """Clustered vectors: each query opens few of the leaf pages and stays exact."""
    rng = np.random.default_rng(0)
    centers = rng.integers(-900, 900, (40, 8))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-5, 6, (4000, 8))).astype(np.int64)
    tree = metric_tree.build_tree(x)
    leaves = int(tree["is_leaf"].sum())
    assert leaves > 40 and (tree["last"] - tree["first"])[tree["is_leaf"]].sum() == 4000
    place = np.argsort(tree["rows"])
    search = metric_tree.Search(tree, tree["rows"], x[:200], place[:200], 5)
    q, p, s = search.run()
    for k in range(200):
        scores = np.delete(x[k] @ x.T, k)
        assert sorted(s[q == k], reverse=True) == sorted(scores, reverse=True)[:5]
    assert search.counts["opened"] < 0.2 * search.counts["pages"]
    assert search.counts["distances"] < 0.3 * 200 * 4000


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 1.0]), (3, [1.0, None]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0]), (7, [2.0, 2.0]), (7, [1.0, 1.0]), (60, [-0.01, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("vec", F.lit(2)).withColumn("row", F.lit(2))
    whole = [(0, [64, 128]), (5, []), (None, [64, 64]), (6, [64]), (7, [128, 128]), (7, [64, 64]), (60, [-1, 64 * 10**9])]
    assert searched(df) == brute_top(whole, 20)
    assert searched(df.limit(0)) == []


# Pieces


def proto(number, kind, value):
    if kind == 0:
        return bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
    if kind == 5:
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2]) + _length(len(value)) + value


def _length(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + _length(n >> 7)


def unigram_model(squeeze):
    """A unigram model with byte fallback, put together by hand."""
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    texts = ["▁", "▁the", "▁cat", "s", "at", "c", "a", "t", "▁s", "e", "h", "▁a", "▁mat", "m", "ing", "i", "n", "g"]
    pieces_ += [(t, -1.0 - 0.37 * k, 1) for k, t in enumerate(texts)]
    out = b"".join(proto(1, 2, proto(1, 2, t.encode()) + proto(2, 5, s) + proto(3, 0, kind)) for t, s, kind in pieces_)
    trainer = proto(3, 0, 1) + proto(35, 0, 1)
    rules = proto(3, 0, 1) + proto(4, 0, squeeze) + proto(5, 0, 1)
    return out + proto(2, 2, trainer) + proto(3, 2, rules)


NAMES = ["<s>", "the <s> cat", "</s>", "<unk>", "<0x41>", "x<0x0A>y", "<0x41><0x", "😀<unk>é"]
TEXTS = [*NAMES, "", " ", "the cat sat", "  the  cats   sat ing ", "x the cat\nsat\t", "😀 é", "the▁cat", "catcatting" * 40]


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_parity(squeeze):
    data = unigram_model(squeeze)
    assert pieces.read_model(data)["byte_fallback"]
    assert pieces.parity(data, TEXTS) == []


def test_unigram_names_of_pieces_are_text(spark):
    data = unigram_model(0)
    docs = spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, text string")
    encoded = pieces.encode(docs, data)
    assert all(r["round_trip"] for r in encoded.collect())
    assert [r["text"] for r in pieces.decode(encoded, data).orderBy("doc_id").collect()] == NAMES
    a = pieces.Codec(data).open().encode(["<0x41>", "A"])
    assert a[0] != a[1]


def test_bpe_parity_on_whole_texts(spark, sf_mid):
    texts = [r["text"] for r in common.table(spark, sf_mid, "documents").select("text").collect()]
    assert pieces.parity(pieces.model_bytes(), [*texts, *TEXTS, "<s> </s> <0x41> <unk>", "a" * 5000, " " * 50 + "x"]) == []


def test_round_trip_and_decode(spark, odd, no_docs):
    data = pieces.model_bytes()
    encoded = pieces.encode(odd, data)
    got = encoded.collect()
    assert len(got) == odd.count()
    for r in got:
        if r["text"] is None:
            assert r["ids"] is None and r["n_tokens"] == 0 and r["round_trip"] is None
        else:
            assert r["round_trip"] and len(r["ids"]) == r["n_tokens"]
    back = sorted(pieces.decode(encoded, data).collect(), key=str)
    assert back == sorted(odd.select("doc_id", "text").collect(), key=str)
    assert pieces.encode(no_docs, data).count() == 0
    assert pieces.decode(pieces.encode(no_docs, data), data).count() == 0


def test_words_are_encoded_apart(monkeypatch):
    """Ids and round trips by words are those of whole texts, and a word is encoded once."""
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 8)
    odd = ["", "▁", "  ", "a▁ b", "▁▁x", " <s> </s> <0x41> ", "\n\n \t x", "😀 ▁😀", "<unk>", "a b  a b", "\x00 z", "the cat the cat the"]
    whole, codec = pieces.Codec(pieces.model_bytes()).open(), pieces.Codec(pieces.model_bytes()).open()
    whole.words = False
    for _ in range(2):
        assert codec.encode(odd) == whole.encode(odd)
        assert codec.checked(odd) == whole.checked(odd)
        assert len(codec._known) == 8
    # Where a word comes back changed, the whole text decides.
    codec._changed.add("▁cat")
    assert codec.checked(odd) == whole.checked(odd)

    class Once:
        encode_batch_fast = lambda self, words, **_: [] if not words else pytest.fail("encoded again")

    codec._plain, known = Once(), [w[1:] for w in codec._known if re.fullmatch("▁[^▁]+", w)]
    assert known and len(codec.encode([" ".join(known * 3)])) == 1


def test_a_process_loads_one_tokenizer_once():
    """Later tasks of a process get the tokenizer of the first, and its words."""
    codec = pieces.Codec(pieces.model_bytes()).open()
    codec.checked(["some words of a text"])
    plain, known = codec._plain, dict(codec._known)
    assert codec.open()._plain is plain and codec._known == known and known
    assert codec._decoder is plain and "_encoder" not in vars(codec)


def test_unknown_model_type():
    with pytest.raises(ValueError):
        pieces.Codec(proto(2, 2, proto(3, 0, 3)))
