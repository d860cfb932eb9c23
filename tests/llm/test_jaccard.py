"""N-gram Jaccard join against a comparison of all pairs."""

import itertools
import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from tileframe.llm import common, components, jaccard_join


def sets(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        out.append((doc_id, {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    return out


def brute(rows):
    """Sorted (doc_id, n, component) of rows with ids."""
    own = sets(rows)
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(own)), 2):
        x, y = own[a][1], own[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(own):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(k)]) for k, (doc_id, s) in enumerate(own))


def got(spark, rows):
    df = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def near_copies(seed):
    """Chains and stars of near copies round the threshold, passages, exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 9, 30, 120]))]
        for _ in range(rng.choice([1, 3, 8])):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text += passage
            rows.append(" ".join(text))
            if rng.random() < 0.2:
                base = text
    rows += rows[:5]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = near_copies(seed)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark, odd, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    found = sorted((tuple(r) for r in jaccard_join.classes(odd).collect() if r["doc_id"] is not None))
    assert found == brute(rows)
    assert jaccard_join.classes(no_docs).count() == 0
    kept = jaccard_join.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 8]


def test_ids_may_be_null_on_both_sides(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(None, text), (3, text + " more"), (9, text + " other")], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_join.classes(docs).collect()] == [3, 3, 3]


def test_large_broadcast_and_shuffle_agree(spark, monkeypatch):
    rows = near_copies(3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize(("seed", "most"), [(4, 2), (5, 5)])
def test_long_lists_in_blocks(spark, seed, most, monkeypatch):
    """Near copies of one text and of a second one that shares a passage with it."""
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", most)
    monkeypatch.setattr(jaccard_join, "PAIR_BATCH", 7)
    rng = random.Random(seed)
    rows = near_copies(seed)
    common_part = [f"p{k}" for k in range(40)]
    for name in "xy":
        base = [f"{name}{k}" for k in range(20)] + common_part
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(40)}"
            rows.append((len(rows), " ".join(text)))
    assert got(spark, rows) == brute(rows)


def test_bitmap_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard_join._bitmap(s), np.uint8) for s in (x, y))
        while len(a) != len(b):
            a, b = sorted((a, b), key=len)
            b = jaccard_join._fold(b)
        assert (len(x) + len(y) - int(np.bitwise_count(a ^ b).sum())) // 2 >= len(np.intersect1d(x, y))


def test_whole_words_and_case():
    a = jaccard_join.shingles("A\x0bB\x0cc\td e F")
    assert len(a) == 2 and (a == jaccard_join.shingles("a b C d\nE f")).all()
    assert len(jaccard_join.shingles("É é")) == len(jaccard_join.shingles("x")) == 1
    assert not (jaccard_join.shingles("É a") == jaccard_join.shingles("é a")).any()
    assert len(jaccard_join.shingles("a b\x1fc d e f g")) == 1  # neither is white space here


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r["id"], r["root"]) for r in components.roots(links, "path").collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}
    assert components.roots(links.limit(0), "none").count() == 0


def test_common_reads_whole_tables(spark, sf_small):
    assert common.table(spark, sf_small, "documents").count() == 200


def test_distinct_documents_with_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(30)) for w in "abcd")
    rows = [(3, c), (5, a), (5, b), (6, c), (7, a), (8, c), (8, d), (8, d), (None, a), (None, "n " + b), (None, "x y z"), (None, "x y z"), (9, ""), (9, "own text here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in jaccard_join.distinct_documents(docs).collect()))
    assert got == sorted([(3, c), (5, a), (5, b), (8, d), (0, "x y z"), (9, ""), (9, "own text here"), (0, "")])


def test_components_need_few_rounds_and_files(spark, monkeypatch):
    """Stars are found to be ready without another round, and small tables have few files."""
    written, write = [], common.materialize

    def counted(df, name):
        out = write(df, name)
        written.append(len(list(Path(urlparse(out._written_to).path).glob("part-*"))))
        return out

    monkeypatch.setattr(common, "materialize", counted)
    monkeypatch.setattr(common, "LEAST_TASKS", 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star = spark.createDataFrame([(k, 0) for k in range(1, 40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
        assert dict(components.roots(star, "star", 42).collect()) == {k: 0 for k in range(40)} | {50: 50, 51: 50}
        assert len(written) == 1 and max(written) <= 2
        chain = spark.createDataFrame([(k, k + 1) for k in range(-30, 30)] + [(90, 95), (95, 80)], "a long, b long")
        assert dict(components.roots(chain, "chain").collect()) == {k: -30 for k in range(-30, 31)} | {80: 80, 90: 80, 95: 80}
        assert max(written[2:]) <= 2
        assert components.roots(chain.filter("a > 1000"), "none", 0).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
