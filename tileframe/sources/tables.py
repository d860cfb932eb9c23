"""Tables, loading, CSV import and scalar views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUOTED_EMPTY = "\x01empty\x01"
#: About so many rows are sorted by one task and written to one file.
FILE_ROWS = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def populate(source: DataFrame, path: str, columns=None, predicate: Column | str | None = None, sort=(), mode: str = "append") -> int:
    """Writes the chosen columns and rows of ``source`` to a Parquet table, sorted within
    files by ``sort`` after a range shuffle (so that row groups have narrow bounds);
    returns how many rows it wrote."""
    rows = source if predicate is None else source.where(predicate)
    rows = rows.select(*columns) if columns else rows
    if sort:
        # Ties are parted by the rows' values, as the order of rows of any source may change.
        rows = in_ranges(rows, sort, F.xxhash64(*[f"`{c}`" for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]))
    return write_counted(rows, path, mode)


def in_ranges(rows: DataFrame, sort, tie: Column) -> DataFrame:
    """Rows dealt to tasks by ranges of ``sort`` and sorted within them, about ``FILE_ROWS``
    a task however many there are. Rows that are alike in ``sort`` are parted by ``tie``, so
    a few frequent values are no few large tasks."""
    tasks = -(-rows.count() // FILE_ROWS)
    place = "_tie" + "_" * max(map(len, rows.columns))
    return rows.withColumn(place, tie).repartitionByRange(max(1, tasks), *sort, place).sortWithinPartitions(*sort).drop(place)


def write_counted(rows: DataFrame, path: str, mode: str = "append") -> int:
    """Writes Parquet and counts the rows in the same job."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def read_csv(spark: SparkSession, path: str, schema, separator: str = ",", skip: int = 0, quote: str = '"') -> DataFrame:
    """Rows of a CSV file: fields may be quoted, with the quote doubled inside; a missing
    field is NULL, a quoted empty one the empty string. ``skip`` leaves out that many
    lines at the start of each file. ``quote`` has one character, or two of which each
    field may use either. A record is a line. A bad record fails the read.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if skip > 1 or len(quote) > 1:
        return _parsed(_lines(spark, path, skip), schema, separator, quote)
    # Spark reads an empty string as NULL whether quoted or not, unless it has a name.
    options = {"sep": separator, "quote": quote, "escape": quote, "mode": "FAILFAST", "emptyValue": QUOTED_EMPTY}
    named = [F.when(F.col(f.name) == QUOTED_EMPTY, "").otherwise(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in schema]
    return spark.read.schema(schema).options(header=skip == 1, enforceSchema=True, **options).csv(path).select(*named)


def _lines(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """``value``: the lines that are not empty, without the first ``skip`` of each file.

    Files are read in blocks by many tasks. The lines of a block are numbered in a row, so
    the first lines of a file are those of its first block with the least numbers.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if skip:
        first = rows.where("block = 0").groupBy("file").agg(F.min("at").alias("first"))
        rows = rows.join(first, "file").where((F.col("block") > 0) | (F.col("at") >= F.col("first") + skip))
    return rows.where("value <> ''").select("value")


def _parsed(lines: DataFrame, schema: T.StructType, separator: str, quote: str) -> DataFrame:
    literal = re.escape(separator)
    quoted = "|".join(f"{q}(?:[^{q}]|{q}{q})*+{q}" for q in map(re.escape, quote))
    # A separator before each field, the first one too, so that no match is empty.
    fields = F.regexp_extract_all(F.concat(F.lit(separator), "value"), F.lit(f"{literal}((?:{quoted})|[^{literal}]*+)"), F.lit(1))
    rows = lines.withColumn("fields", fields)
    rows = rows.withColumn("fields", F.when(F.size("fields") <= len(schema), F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("too many fields: "), "value"))))

    def plain(field: Column) -> Column:
        out = F.when(field != "", field)
        for q in quote:
            inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit(q * 2), F.lit(q))
            out = F.when(field.startswith(q) & (F.length(field) > 1), inner).otherwise(out)
        return out

    return rows.select(*[plain(F.get("fields", F.lit(k))).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)])


def import_csv(spark: SparkSession, path: str, destination: str, schema, separator: str = ",", skip: int = 0, quote: str = '"') -> int:
    """Appends a CSV file to a Parquet table; returns how many rows it wrote."""
    return write_counted(read_csv(spark, path, schema, separator, skip, quote), destination)


def register_view(spark: SparkSession, name: str, data, columns: dict[str, str] | None = None, schema_name: str | None = None) -> DataFrame:
    """A scalar view ``name`` of a DataFrame, a Parquet path or a table; ``columns`` maps
    the view's column names to those of the data (unmapped columns keep their names)."""
    if isinstance(data, DataFrame):
        rows = data
    elif "/" in data:
        rows = spark.read.parquet(data)
    else:
        rows = spark.table(f"{schema_name}.{data}" if schema_name else data)
    if columns:
        missing = [c for c in columns.values() if c not in rows.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        mapped = set(columns.values())
        rows = rows.select(*[F.col(c).alias(n) for n, c in columns.items()], *[c for c in rows.columns if c not in mapped and c not in columns])
    rows.createOrReplaceTempView(name)
    return rows


def statistics(df: DataFrame, *columns: str) -> DataFrame:
    """column, n_rows, n_null, low, high, n_distinct (approximate), as text where needed."""
    names = columns or df.columns
    one = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}__{name}") for c in names for name, f in (("nonnull", F.count), ("low", F.min), ("high", F.max), ("distinct", F.approx_count_distinct))])
    rows = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"{c}__nonnull")).alias("n_null"), F.col(f"{c}__low").cast("string").alias("low"), F.col(f"{c}__high").cast("string").alias("high"), F.col(f"{c}__distinct").alias("n_distinct")) for c in names]
    return one.select(F.inline(F.array(*rows)))


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
