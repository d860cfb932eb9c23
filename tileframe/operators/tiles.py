"""Fixed-size column chunks: packing rows, unpacking, text form, per-chunk bounds.

A tile row holds the scalar keys, ``tile_id`` and, for each packed column, an array of
up to ``TILE`` values. Parquet already stores columns in chunks with bounds, so this
form is for interchange; queries run on plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import _col
from .windows import Spread

TILE = 64


def pack(df: DataFrame, keys, columns, order, size: int = TILE, split: Column | None = None) -> DataFrame:
    """keys, tile_id, and an array a column; rows of a key in the order of ``order``.

    A tile has rows of one key only. With ``split``, a column that never falls in that
    order, the rows of a frequent key, or of a table without keys, are numbered over many
    tasks (see ``windows.Spread``); tiles are the same.
    """
    rows = df.select(*keys, *[c for c in columns if c not in keys], *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)], (F.lit(0) if split is None else split).alias("_part"))
    names = [f"_order{k}" for k in range(len(order))]
    if split is None:
        numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*names)))
    else:
        numbered = Spread(keys, names, F.col("_part")).numbered(rows, "_at")
    numbered = numbered.withColumn("tile_id", F.call_function("div", F.col("_at") - 1, F.lit(size)))
    lanes = numbered.groupBy(*keys, "tile_id").agg(F.array_sort(F.collect_list(F.struct("_at", *columns))).alias("_lanes"))
    return lanes.select(*keys, "tile_id", *[F.col("_lanes").getField(c).alias(c) for c in columns])


def unnest(tiles: DataFrame, columns, where: Column | None = None) -> DataFrame:
    """One row for each lane of the packed ``columns``; other columns are repeated."""
    others = [c for c in tiles.columns if c not in columns]
    rows = tiles.select(*others, F.inline(F.arrays_zip(*[F.col(c) for c in columns])))
    return rows if where is None else rows.where(where)


def first(tile) -> Column:
    """First value of the tile that is not NULL."""
    return F.get(F.filter(_col(tile), lambda x: x.isNotNull()), F.lit(0))


def last(tile) -> Column:
    return F.get(F.reverse(F.filter(_col(tile), lambda x: x.isNotNull())), F.lit(0))


def low(tile) -> Column:
    return F.array_min(_col(tile))


def high(tile) -> Column:
    return F.array_max(_col(tile))


def zone_map(tiles: DataFrame, columns) -> DataFrame:
    """Bounds of each tile: first, last, low, high and number of lanes of each column."""
    others = [c for c in tiles.columns if c not in columns]
    bounds = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("first", first), ("last", last), ("low", low), ("high", high))]
    return tiles.select(*others, F.size(columns[0]).alias("lanes"), *bounds)


def format_tile(tile, size: int = TILE) -> Column:
    """Text form: values in braces, ``?`` for NULL, nothing for a lane that is empty."""
    values = F.transform(_col(tile), lambda x: F.coalesce(x.cast("string"), F.lit("?")))
    empty = F.array_repeat(F.lit(""), F.greatest(F.lit(size) - F.size(values), F.lit(0)))
    return F.concat(F.lit("{"), F.array_join(F.concat(values, empty), ","), F.lit("}"))


def parse_tile(text, kind: str, size: int = TILE) -> Column:
    """Array of the lanes that exist, of a text form or of a constant for all lanes."""
    text = _col(text)
    inner = F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",")
    lanes = F.filter(inner, lambda x: x != "")
    values = F.transform(lanes, lambda x: F.when(x != "?", x).cast(kind))
    return F.when(text.startswith("{"), values).otherwise(F.array_repeat(F.when(text != "?", text).cast(kind), size))
