"""Aggregates: weighted average, approximate distinct count, first and last by time,
and grouping into array-valued records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import _col

#: Standard error of ``approxdc`` unless another is asked for.
RSD = 0.05


def countall() -> Column:
    """All rows, NULLs included."""
    return F.count("*")


def wavg(price, volume) -> Column:
    """Average of ``price`` weighted by ``volume`` over rows that have both; NULL where
    the weights add up to zero."""
    p, v = _col(price).cast("double"), _col(volume).cast("double")
    return F.try_divide(F.sum(p * v), F.sum(F.when(p.isNotNull(), v)))


def approxdc(x, rsd: float = RSD) -> Column:
    """Approximate number of distinct values; NULL without any value."""
    return F.when(F.count(_col(x)) > 0, F.approx_count_distinct(_col(x), rsd))


def approxdc_sketch(x, lg_k: int = 12) -> Column:
    """Mergeable sketch for ``approxdc_merge``."""
    return F.hll_sketch_agg(_col(x), F.lit(lg_k))


def approxdc_merge(sketch) -> Column:
    """Distinct values of all sketched groups together."""
    return F.hll_sketch_estimate(F.hll_union_agg(_col(sketch)))


def first_by(value, ts) -> Column:
    """Value at the smallest ``ts`` (NULL if that value is); rows without ts are left out."""
    return F.min_by(_col(value), _col(ts))


def last_by(value, ts) -> Column:
    """Value at the greatest ``ts``."""
    return F.max_by(_col(value), _col(ts))


#: Names as they are written in ``map_reduce``.
BY_NAME = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
VARIANCES = {"var_pop": F.var_pop, "var_samp": F.var_samp, "variance": F.var_samp, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "stddev": F.stddev_samp}


def map_reduce(df: DataFrame, key, names: str, *values) -> DataFrame:
    """group_by, count, aggs (array<double>): one record for each key that is not NULL.

    ``names`` lists an aggregate for each value: sum, avg, min, max or count. ``key``
    is a column or a sequence of columns, whose struct is then the key.
    """
    wanted = [n.strip().lower() for n in names.split(",")]
    unknown = [n for n in wanted if n not in BY_NAME]
    if unknown:
        raise ValueError(f"unknown aggregates: {', '.join(unknown)}")
    if len(wanted) != len(values):
        raise ValueError(f"{len(wanted)} aggregates for {len(values)} columns")
    keys = [_col(k) for k in key] if isinstance(key, list | tuple) else [_col(key)]
    group = F.struct(*keys) if len(keys) > 1 else keys[0]
    known = keys[0].isNotNull()
    for k in keys[1:]:
        known = known & k.isNotNull()
    aggs = F.array(*[BY_NAME[n](_col(v)).cast("double") for n, v in zip(wanted, values, strict=True)])
    return df.where(known).groupBy(group.alias("group_by")).agg(F.count("*").alias("count"), aggs.alias("aggs"))
