"""A training corpus from raw documents: five stages, each written as Parquet and read
again as the next one's documents.

Quality rules drop documents; of each group of near-duplicates the document with the
smallest id stays; secrets are replaced by a mask; sources are mixed to their target
weights (a document may be left out, or come up to three times); texts are encoded.

Defined cases: the base rule of the first stage rejects null, empty and short texts; rows
with null or repeated ids are rows of their own, of which one stays where their texts link;
very long texts go through whole; nulls in other columns, and other columns whatever their
names, are kept up to the last stage; an empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tileframe.llm import common, jaccard_join, mixing, pieces, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified threshold rejects go."""
    return quality.kept_documents(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 stays."""
    return jaccard_join.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked; all documents stay."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in its order, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, round_trip and the token ids of every document."""
    encoded = pieces.encode(common.bare(docs, "doc_id", "lang", "source", "text"), pieces.model_bytes())
    return encoded.select("doc_id", "lang", "source", "n_tokens", "round_trip", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("piece encoding", piece_encoding),
]

#: Near-duplicate components and tokens are beyond SQL; tests hold the stages against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
