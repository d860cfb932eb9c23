"""Running and moving window aggregates. An order is required: Spark has no row order
of its own. ``Moving`` gives each partition to one task; ``Spread`` splits partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expressions import _col


class Moving:
    """Window functions over ``partition`` in the order of ``order``.

    Without ``n``, functions run from the first row to the current one; with it, over
    the last ``n`` rows (fewer at the start). Both must be sequences of columns, and
    ``order`` should identify rows, or ties come in any order.
    """

    def __init__(self, partition, order):
        if not order:
            raise ValueError("a window needs an order")
        self.spec = Window.partitionBy(*partition).orderBy(*order)

    def frame(self, n: int | None = None) -> WindowSpec:
        if n is not None and n < 1:
            raise ValueError("a moving window has at least one row")
        return self.spec.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, Window.currentRow)

    def mcount(self, x=None, n: int | None = None) -> Column:
        """Rows so far, or with ``x`` its values that are not NULL."""
        return F.count("*" if x is None else _col(x)).over(self.frame(n))

    def msum(self, x, n: int | None = None) -> Column:
        return F.sum(_col(x)).over(self.frame(n))

    def mavg(self, x, n: int | None = None) -> Column:
        return F.avg(_col(x).cast("double")).over(self.frame(n))

    def mmin(self, x, n: int | None = None) -> Column:
        return F.min(_col(x)).over(self.frame(n))

    def mmax(self, x, n: int | None = None) -> Column:
        return F.max(_col(x)).over(self.frame(n))

    def lag(self, x, offset: int = 1) -> Column:
        """Value of the previous row, NULL if that was."""
        return F.lag(_col(x), offset).over(self.spec)


class Spread:
    """The same results over partitions of any size, a frequent key's or the whole table's.

    ``split`` is a column that never falls in the order of ``order``, such as a day of a
    timestamp or a number divided by a constant. Rows are dealt by partition and split;
    only one row of totals a split meets in the window over a whole partition.
    """

    #: Rows that ``moving`` deals to a task at a time.
    ROWS = 65_536

    def __init__(self, partition, order, split: Column):
        if not order:
            raise ValueError("a window needs an order")
        self.partition, self.order, self.split = list(partition), list(order), split

    def _with_earlier(self, df: DataFrame, totals: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """Adds ``_split`` and, for each split's totals, what ``carry`` makes of those of
        the earlier splits."""
        rows = df.withColumn("_split", self.split)
        earlier = Window.partitionBy(*self.partition).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*self.partition, "_split").agg(*[c.alias(n) for n, c in totals.items()])
        sums = sums.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate([*self.partition, "_split"])], *[c.over(earlier).alias(n) for n, c in carry.items()])
        same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate([*self.partition, "_split"])]
        return rows.join(sums, same).drop(*[f"_k{k}" for k in range(len(same))])

    def running(self, df: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
        """Adds the columns of ``wanted``: name -> (count, sum, avg, min or max; column, or
        None to count rows) from the first row to the current one."""
        parts: dict[str, tuple] = {}
        for name, (kind, x) in wanted.items():
            for own in ("sum", "count") if kind == "avg" else (kind,):
                parts[f"_{name}_{own}"] = (own, F.lit(1) if x is None else _col(x).cast("double") if kind == "avg" else _col(x))
        merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        plain = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
        totals = {n: plain[kind](x) for n, (kind, x) in parts.items()}
        rows = self._with_earlier(df, totals, {n: merge[kind](F.col(n)) for n, (kind, _) in parts.items()})
        inside = Window.partitionBy(*self.partition, "_split").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = {
            "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "sum": lambda a, b: F.coalesce(a + b, a, b),
            "min": F.least, "max": F.greatest,
        }
        found = {n: both[kind](F.col(n), plain[kind](x).over(inside)) for n, (kind, x) in parts.items()}
        out = {name: F.try_divide(found[f"_{name}_sum"], found[f"_{name}_count"]) if kind == "avg" else found[f"_{name}_{kind}"] for name, (kind, _) in wanted.items()}
        return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])

    def numbered(self, df: DataFrame, name: str = "row_number") -> DataFrame:
        """Adds the number of the row in its partition, from 1."""
        return self.running(df, {name: ("count", None)})

    def moving(self, df: DataFrame, n: int, wanted: dict[str, tuple]) -> DataFrame:
        """As ``running`` over the last ``n`` rows; (lag, column) is the value n - 1 rows
        before. A third entry, (sum, column, m), is a smaller window of its own. Rows are
        numbered and dealt once, in runs, each with the n - 1 rows before it."""
        wanted = {name: (kind, x, *own) if own else (kind, x, n) for name, (kind, x, *own) in wanted.items()}
        if n < 1 or any(not 1 <= m <= n for _, _, m in wanted.values()):
            raise ValueError("a moving window has at least one row, and none is wider than n")
        size = max(self.ROWS, n)
        at, run = F.col("_at") - 1, F.call_function("div", F.col("_at") - 1, F.lit(size))
        own, next_one = F.struct(run.alias("run"), F.lit(True).alias("own")), F.struct((run + 1).alias("run"), F.lit(False).alias("own"))
        dealt = F.when(at % size >= size - (n - 1), F.array(own, next_one)).otherwise(F.array(own))
        rows = self.numbered(df, "_at").withColumn("_to", F.explode(dealt))
        spec = Window.partitionBy(*self.partition, "_to.run").orderBy("_at")
        made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}

        def over(kind, x, m):
            if kind == "lag":
                return F.lag(_col(x), m - 1).over(spec)
            return made[kind](F.lit(1) if x is None else _col(x)).over(spec.rowsBetween(1 - m, Window.currentRow))

        out = [over(*of).alias(name) for name, of in wanted.items()]
        return rows.select(*df.columns, "_to", *out).where("_to.own").drop("_to")

    def ranks(self, df: DataFrame) -> DataFrame:
        """Adds ``rank`` and ``dense_rank`` by the order; rows that tie have one split."""
        rows = self._with_earlier(df, {"_n": F.count("*"), "_d": F.countDistinct(*self.order)}, {"_n": F.sum("_n"), "_d": F.sum("_d")})
        inside = Window.partitionBy(*self.partition, "_split").orderBy(*self.order)
        add = lambda name, f: (F.coalesce(F.col(name), F.lit(0)) + f().over(inside))
        return rows.select(*df.columns, add("_n", F.rank).alias("rank"), add("_d", F.dense_rank).alias("dense_rank"))


def ntile(number: Column, of: Column, tiles: int) -> Column:
    """Bucket, from 1, of the row with this number among ``of`` rows, in ``tiles`` buckets
    whose sizes differ by one at most, larger ones first."""
    small, larger = F.call_function("div", of, F.lit(tiles)), of % tiles
    first = larger * (small + 1)
    later = larger + F.call_function("div", number - first - 1, F.greatest(small, F.lit(1))) + 1
    return F.when(number <= first, F.call_function("div", number - 1, small + 1) + 1).otherwise(later)
