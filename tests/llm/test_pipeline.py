"""The corpus pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard import brute
from test_quality_mixing import measures
from test_secrets import brute as spans_of

from tileframe.llm import common, mixing, pieces, secrets


def masked(text):
    out, at = "", 0
    for start, _, _, end in spans_of(text):
        if start >= at:
            out += text[at:start] + secrets.MASK
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, sf_small):
    docs = common.table(spark, sf_small, "documents")
    names = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "secret scan", "source mix", "piece encoding"]

    def run(name, source):
        out = common.materialize(stages[name](spark, source, sf_small), "test-stage")
        return out, out.collect()

    first, kept = run("quality rules", docs)
    assert first.columns == names
    # With so few labels no threshold is certified: the base rule decides.
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, r in rows.items() if not measures(r["text"])[5])
    second, single = run("near duplicates", first)
    assert second.columns == names
    want = [d for d, _, c in brute([(r["doc_id"], r["text"]) for r in kept]) if d == c]
    assert sorted(r["doc_id"] for r in single) == want
    third, clean = run("secret scan", second)
    assert third.columns == names
    assert {r["doc_id"]: r["text"] for r in clean} == {d: masked(rows[d]["text"]) for d in want}
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    taken = {r["doc_id"]: r["repeats"] for r in mixing.mix(third).collect()}
    fourth, mixed = run("source mix", third)
    assert fourth.columns == names
    counts = {}
    for r in mixed:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {d: n for d, n in taken.items() if n}
    _, encoded = run("piece encoding", fourth)
    assert len(encoded) == len(mixed) and all(r["round_trip"] for r in encoded)
    codec = pieces.Codec(pieces.model_bytes()).open()
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert all(list(r["ids"]) == codec.encode([texts[r["doc_id"]]])[0] for r in encoded)


def test_odd_rows(spark, odd, no_labels, tmp_path):
    """Nulls, repeated rows and clashing columns go through all stages; what the base rule
    of the first stage rejects is gone."""
    words = "some quite ordinary words that no rule rejects as they are neither few nor repeated in any way here at all".split()
    row = odd.filter("doc_id = 5")
    clean = " ".join(words)
    more = [(11, clean, "en"), (12, clean, None), (None, clean, "en"), (13, " ".join(reversed(words)), None), (14, clean + " password: hunter2hunter2", "de"), (13, clean.upper() + " tail", "en")]
    for doc_id, text, lang in more:
        one = row.withColumn("doc_id", F.lit(doc_id).cast("long")).withColumn("text", F.lit(text)).withColumn("lang", F.lit(lang).cast("string"))
        odd = odd.union(one.withColumn("source", F.lit(None).cast("string")))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = pieces.Codec(pieces.model_bytes()).open()
    texts = {(r["doc_id"], codec.decode([list(r["ids"])])[0]) for r in got}
    assert all(r["round_trip"] for r in got) and {t for _, t in texts if "hunter2" in t} == set()
    # 11 stands for its copies 12, null, 13's upper case and 14; the reversed text is its own.
    assert {d for d, t in texts if t == clean} <= {11} and (12, clean) not in texts and (None, clean) not in texts
    kept = {r["doc_id"] for r in common.materialize(corpus_pipeline.quality_rules(spark, odd, str(tmp_path)), "odd").collect()}
    assert kept >= {11, 12, 13, 14, None} and not kept & {1, 2, 3, 4, 6, 7}


def test_empty_tables(spark, odd, no_labels, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
