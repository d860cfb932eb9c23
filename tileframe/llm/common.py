"""Shared pieces of the training-data operators: tables, words, shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and U+0009..U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tasks of a small table.
LEAST_TASKS = 8
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this run in the one that driver and executors share
    (``spark.checkpoint.dir``); it is deleted when the driver ends.

    Only where the session names none and runs on this machine alone (tests), a temporary
    folder is made, and put into the session's configuration.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        folder = "file://" + (made := tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, made, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if folder not in _runs:
        _runs[folder] = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_delete, _runs[folder])
    return _runs[folder]


#: Folder of this run by shared folder.
_runs: dict[str, str] = {}


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as lost:  # what is left over does no harm
        warnings.warn(f"{path} is left: {lost}", stacklevel=2)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and
    survives lost executors. Every call writes a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def gathered(df: DataFrame, rows: int, a_task: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, in no more tasks than these need (never in more than
    before), so that a small table costs no start of a task and no file for every shuffle
    partition."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // a_task)))


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    for table in tables:
        _delete(table._written_to)


class Bucketed:
    """A table of this run in the shared folder, written in buckets by a column: what joins
    or groups by that column reads it without a shuffle. Rows with each value of a column
    ``split`` can be read and deleted apart."""

    def __init__(self, df: DataFrame, name: str, by: str, buckets: int = 1, split: str | None = None):
        self.spark, self.split = df.sparkSession, split
        own = f"{name}-{uuid.uuid4().hex}"
        self.path, self.name = f"{shared_folder(self.spark)}/{own}", own.replace("-", "_")
        # Below the number of shuffle partitions Spark would shuffle both sides of a join.
        buckets = min(100_000, max(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        df.write.partitionBy(*[split] if split else []).bucketBy(buckets, by).option("path", self.path).saveAsTable(self.name, format="parquet")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def part(self, value: str) -> DataFrame:
        return self.rows().filter(F.col(self.split) == value)

    def discard(self, value: str | None = None) -> None:
        """Deletes the rows with a value of ``split``, or all, once nothing reads them any more."""
        if value is None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.path if value is None else f"{self.path}/{self.split}={value}")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, each written table's shuffle files go as soon as it is written."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"[{SPACE_CLASS}]+"))


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed split of labelled rows."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def set_aside(df: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with every column but the needed ones renamed by place, so that none of
    their names can clash, and the columns that give the names back."""
    inner = [c if c in needed else f"_in{k}" for k, c in enumerate(df.columns)]
    return df.toDF(*inner), [F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True)]


def bare(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: others, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
