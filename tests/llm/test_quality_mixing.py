"""Quality rules and source mixing against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tileframe.llm import common, mixing, quality

SPACE = " \t\n\x0b\x0c\r"


def measures(text):
    text = text or ""
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if any(c not in SPACE for c in x)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    twice = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(twice) > 30 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_equal_plain_python(spark, odd, sf_small):
    for docs in (odd, common.table(spark, sf_small, "documents")):
        for r in quality.measure(docs).collect():
            assert tuple(r[c] for c in COLUMNS) == measures(r["text"])


def exact_tail(n, k, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(1, 0), (50, 0), (1000, 3), (1000, 9), (5000, 20), (400, 0), (100_000, 800)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect():
        if r["k"] >= r["n"] * 0.01:
            assert r["p"] == 1
        elif r["n"] <= 5000:
            assert r["p"] == pytest.approx(exact_tail(r["n"], r["k"], 0.01), rel=1e-9)
        else:
            assert 0 < r["p"] < 1e-9


def labelled(spark, n, bad_every):
    """n labelled good documents, of which every bad_every-th is full of symbols."""
    rows = [(k, " ".join(f"w{k}x{j}" + ("###" if bad_every and k % bad_every == 0 else "") for j in range(30)), "en") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, docs.select("doc_id", F.lit(1).alias("quality"))


def test_certified_steps(spark):
    docs, labels = labelled(spark, 500, 0)
    cuts = quality.certify(quality.measure(docs), labels).collect()
    assert [tuple(r) for r in cuts] == [("=en", quality.STEPS)]
    docs, labels = labelled(spark, 500, 20)  # 5 % of good documents would go: above the risk
    steps = quality.certify(quality.measure(docs), labels).first()["steps"]
    assert quality.PATH[steps - 1][0] == "symbols" and quality.PATH[steps - 1][1] > 300
    docs, labels = labelled(spark, 90, 0)  # too few to be sure
    assert quality.certify(quality.measure(docs), labels).count() == 0


def test_first_step_follows_the_path(spark):
    base = "n_symbols long, word_chars long, n_repeat_words long, n_words long, n_dup_lines long, n_lines long"
    rows = [(0, 100, 0, 100, 0, 9), (60, 100, 0, 100, 0, 9), (1, 100, 60, 100, 0, 9), (0, 100, 0, 100, 1, 9), (0, 100, 45, 100, 9, 9), (0, 0, 0, 0, 0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, base).select(quality.first_step()).collect()]
    n = len(quality.CUTOFFS)
    assert got == [None, 1, n, 2 * n + 1 + sum(c > 111 for c in quality.CUTOFFS), n + 2, None]


def test_false_rejections_stay_within_the_risk(spark):
    """Of many simulated strata, each tested at DELTA, few certify a setting that truly
    rejects more than RISK; certified settings are not all empty."""
    rng = np.random.default_rng(11)
    cuts = sorted(quality.CUTOFFS, reverse=True)
    # Chance that a good document is first rejected at each of the first steps.
    chance = [0.004, 0.006, 0.01, 0.009, 0.004, 0.01, 0.02]
    truly = np.cumsum(chance)
    strata, n = 300, 600
    steps = rng.choice(len(chance) + 1, (strata, n), p=[*chance, 1 - truly[-1]])
    rows = [(s * n + k, str(s), int(cuts[step]) + 1 if step < len(chance) else 0) for s in range(strata) for k, step in enumerate(steps[s])]
    measured = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "lang", "n_symbols"]))
    measured = measured.selectExpr("doc_id", "lang", "n_symbols", "1000L AS word_chars", "0L AS n_repeat_words", "100L AS n_words", "0L AS n_dup_lines", "9L AS n_lines", "false AS base_failed")
    labels = measured.selectExpr("doc_id", "1 AS quality")
    got = [r["steps"] for r in quality.certify(measured, labels, delta=quality.DELTA * strata).collect()]
    wrong = sum(s > 0 and truly[min(s, len(truly)) - 1] > quality.RISK for s in got)
    assert wrong <= quality.DELTA * strata + 3 * math.sqrt(quality.DELTA * strata)
    assert sum(s >= 2 for s in got) > strata / 2


def test_certified_rule_rejects(spark):
    docs, labels = labelled(spark, 1500, 0)
    noisy = spark.createDataFrame([(5000, " ".join(f"w{j}###" for j in range(30)), "en"), (5001, " ".join(f"w{j}###" for j in range(30)), "de")], docs.schema)
    kept = {r["doc_id"] for r in quality.kept_documents(docs.union(noisy), labels).collect()}
    assert 5000 not in kept and 5001 in kept and len(kept) == 1501


def test_odd_rows_pass_through(odd, no_docs, no_labels):
    kept = quality.kept_documents(odd, no_labels)
    assert kept.columns == odd.columns
    want = sorted((r for r in odd.collect() if not measures(r["text"])[5]), key=str)
    assert sorted(kept.collect(), key=str) == want
    assert quality.kept_documents(no_docs, no_labels).count() == 0


def plain_targets(sizes):
    """Resharing, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, weights = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / weights for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"é": 7, "z": 7, "a": 7, "b": 900, "c": 1}, {"x": 3}, {None: 4}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(0, s, n) for s, n in sizes.items()], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_of_many(spark):
    rows = [(k, f"s{k % 7}" if k % 11 else None, " ".join(["w"] * (1 + k % 13))) for k in range(3000)] + [(9000 + k, "big", "x " * 9) for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for _, s, text in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
    targets, taken = plain_targets(sizes), {}
    for r in got:
        assert r["taken"] in {0, r["size"], 2 * r["size"], 3 * r["size"]}
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 40
    assert sorted(map(tuple, mixing.mix(docs.repartition(13)).collect())) == sorted(map(tuple, got))


def test_mixed_documents(odd, no_docs):
    taken = {}
    for r in mixing.mix(odd).collect():
        taken[r["doc_id"], r["source"], r["size"]] = r["repeats"]
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    got, rows = {}, {}
    for key, r in [((r["doc_id"], r["source"], measures(r["text"])[0]), r) for r in mixed.collect()]:
        got[key] = got.get(key, 0) + 1
    for r in odd.collect():
        key = (r["doc_id"], r["source"], measures(r["text"])[0])
        rows[key] = rows.get(key, 0) + 1
    assert got == {k: n * taken[k] for k, n in rows.items() if taken[k]}
    assert mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
