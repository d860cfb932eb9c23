"""Registered queries of the engine's own operators, and their DuckDB SQL.

Each query runs over its whole tables. NULLs, which the tables lack, are made from
values, alike in query and SQL.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import aggregates as A
from .functions import expressions as E
from .operators import tiles
from .operators.windows import Spread, ntile
from .plans.projections import Catalog
from .plans.substitution import Engine
from .sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir where it is set."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"spark-{name}-")


# Filter, projection, arithmetic


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q6_filter_sum(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    year = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    rows = li.where(year & E.betwixt("l_discount", 0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


Q1_COLUMNS = """round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
count(*) AS count_order"""
Q1_SQL = f"""SELECT l_returnflag, l_linestatus, {Q1_COLUMNS} FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-01'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
#: The same text for Spark, whose timestamps without zone have a literal of their own.
Q1_TEXT = Q1_SQL.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


@query(Q1_SQL)
def q1_group_agg(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-12-01").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        li.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("""SELECT CAST(ascii(l_returnflag) * 256 + ascii(l_linestatus) AS INTEGER) AS group_by, count(*) AS "count",
sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, max(l_discount) AS max_disc, min(l_tax) AS min_tax, CAST(count(l_tax) AS DOUBLE) AS n_tax
FROM lineitem GROUP BY ALL""")
def q1_map_reduce(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    records = A.map_reduce(li, E.pack_chars("l_returnflag", "l_linestatus"), "sum,avg,max,min,count", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_tax")
    names = ("sum_qty", "avg_price", "max_disc", "min_tax", "n_tax")
    rows = records.select("group_by", "count", *[F.col("aggs")[k].alias(n) for k, n in enumerate(names)])
    return rows.withColumn("avg_price", F.round("avg_price", 4))


@query("""SELECT l_linenumber, sum(CAST(l_partkey // (l_linenumber + 1) AS BIGINT))::BIGINT AS quotients, sum(l_partkey % (l_linenumber + 1))::BIGINT AS rests,
sum((-l_partkey) // 7)::BIGINT AS below, sum((-l_partkey) % 7)::BIGINT AS rests_below FROM lineitem GROUP BY l_linenumber""")
def arith_int_div_rem(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    by = (F.col("l_linenumber") + 1).cast("long")
    down = -F.col("l_partkey")
    return li.groupBy("l_linenumber").agg(
        F.sum(E.int_div("l_partkey", by)).alias("quotients"), F.sum(F.col("l_partkey") % by).alias("rests"),
        F.sum(E.int_div(down, F.lit(7).cast("long"))).alias("below"), F.sum(down % 7).alias("rests_below"),
    )


@query("SELECT l_returnflag, sum(-l_quantity) AS negated, sum(-(-l_quantity) - 1) AS less_one FROM lineitem GROUP BY l_returnflag")
def arith_neg(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.sum(-F.col("l_quantity")).alias("negated"), F.sum(-(-F.col("l_quantity")) - 1).alias("less_one"))


@query("""SELECT o_orderkey, CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no,
CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) // 30 AS BIGINT) AS month30, CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER) AS rest30,
CAST(CAST(o_orderdate AS DATE) + 45 AS DATE) AS due FROM orders""")
def date_arith(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    number = E.day_number(day)
    return _t(spark, sf_dir, "orders").select("o_orderkey", number.alias("day_no"), E.int_div(number, 30).alias("month30"), (number % 30).alias("rest30"), E.from_day_number(number + 45).alias("due"))


@query("""SELECT o_orderkey, to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)) > INTERVAL 365 DAYS AS later,
(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2000-01-01')) // 86400000000 AS days FROM orders""")
def date_interval_arith(spark, sf_dir):
    since = E.date_interval(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", (since > F.expr("INTERVAL '365' DAY")).alias("later"), E.time_ratio("o_orderdate", F.lit(86_400_000_000)).alias("days"))


@query("""SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01') AS us, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS since,
epoch_us(ts + INTERVAL 90 MINUTE) - epoch_us(TIMESTAMP '2000-01-01') AS later_us, (epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01')) % 1000000 AS rest FROM events""")
def ts_arith(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    since = E.interval_micros(F.col("ts") - F.lit("2024-01-01").cast("timestamp_ntz"))
    later = F.col("ts") + F.expr("INTERVAL '90' MINUTE")
    return ev.select("event_id", E.micros("ts").alias("us"), since.alias("since"), E.micros(later).alias("later_us"), (E.micros("ts") % 1_000_000).alias("rest"))


@query("""WITH d AS (SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events)
SELECT event_id, us * 2 AS twice, us + 3600000000 AS plus_hour, us // 3600000000 AS hours, us % 3600000000 AS rest, us >= 86400000000 AS after_day FROM d""")
def interval_arith(spark, sf_dir):
    hour = F.expr("INTERVAL '1' HOUR")
    ev = _t(spark, sf_dir, "events").withColumn("i", F.col("ts") - F.lit("2024-01-01").cast("timestamp_ntz"))
    return ev.select(
        "event_id", E.interval_micros(F.col("i") * 2).alias("twice"), E.interval_micros(F.col("i") + hour).alias("plus_hour"),
        E.interval_ratio("i", hour).alias("hours"), E.interval_rest("i", hour).alias("rest"), (F.col("i") >= F.expr("INTERVAL '1' DAY")).alias("after_day"),
    )


@query("""SELECT count(*) FILTER (l_quantity = 25) AS eq, count(*) FILTER (l_quantity <> 25) AS ne, count(*) FILTER (l_quantity < 25) AS lt, count(*) FILTER (l_quantity <= 25) AS le,
count(*) FILTER (l_quantity > 25) AS gt, count(*) FILTER (l_quantity >= 25) AS ge, count(*) FILTER (l_discount > l_tax) AS columns_gt FROM lineitem""")
def cmp_all(spark, sf_dir):
    q = F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").agg(*[F.count_if(c).alias(n) for n, c in {"eq": q == 25, "ne": q != 25, "lt": q < 25, "le": q <= 25, "gt": q > 25, "ge": q >= 25, "columns_gt": F.col("l_discount") > F.col("l_tax")}.items()])


@query("""SELECT count(*) FILTER (event_type = 'click') AS eq, count(*) FILTER (event_type <> 'click') AS ne, count(*) FILTER (event_type < 'm') AS lt,
count(*) FILTER (event_type >= 'm') AS ge, min(event_type) AS low, max(event_type) AS high FROM events""")
def text_cmp(spark, sf_dir):
    x = F.col("event_type")
    return _t(spark, sf_dir, "events").agg(F.count_if(x == "click").alias("eq"), F.count_if(x != "click").alias("ne"), F.count_if(x < "m").alias("lt"), F.count_if(x >= "m").alias("ge"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_type BETWEEN 'E' AND 'P' GROUP BY p_brand")
def betwixt_text(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(E.betwixt("p_type", "E", "P")).groupBy("p_brand").agg(F.count("*").alias("n"))


def _nullable(spark, sf_dir) -> DataFrame:
    """events with ``v``: NULL in every third row."""
    return _t(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))


NULLABLE = "(SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) AS e"


@query(f"""SELECT count(*) FILTER (v > 50 AND event_id % 2 = 0) AS both_true, count(*) FILTER (v > 50 OR event_id % 2 = 0) AS any_true,
count(*) FILTER (NOT (v > 50 AND event_id % 2 = 0)) AS not_both, count(*) FILTER (NOT v > 50) AS not_more FROM {NULLABLE}""")
def bool_ops(spark, sf_dir):
    more, even = F.col("v") > 50, F.col("event_id") % 2 == 0
    return _nullable(spark, sf_dir).agg(F.count_if(more & even).alias("both_true"), F.count_if(more | even).alias("any_true"), F.count_if(~(more & even)).alias("not_both"), F.count_if(~more).alias("not_more"))


@query(f"""SELECT count(*) FILTER (v IS NOT NULL AND v > 50 AND event_id % 2 = 0) AS both_true, count(*) FILTER (v IS NOT NULL AND (v > 50 OR event_id % 2 = 0)) AS any_true,
count(*) FILTER (v IS NOT NULL AND NOT (v > 50 AND event_id % 2 = 0)) AS not_both, count(*) FILTER (v IS NULL) AS unknown FROM {NULLABLE}""")
def strict_bool_ops(spark, sf_dir):
    more, even = F.col("v") > 50, F.col("event_id") % 2 == 0
    return _nullable(spark, sf_dir).agg(F.count_if(E.strict_and(more, even)).alias("both_true"), F.count_if(E.strict_or(more, even)).alias("any_true"), F.count_if(~E.strict_and(more, even)).alias("not_both"), F.count_if(E.strict_or(more, even).isNull()).alias("unknown"))


@query(f"SELECT event_type, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NOT NULL) AS present FROM {NULLABLE} GROUP BY event_type")
def null_tests(spark, sf_dir):
    return _nullable(spark, sf_dir).groupBy("event_type").agg(F.count_if(E.is_null("v")).alias("missing"), F.count_if(E.is_not_null("v")).alias("present"))


@query(f"SELECT event_type, round(sum(coalesce(v, 0)), 2) AS total, count(*) FILTER (coalesce(v, 0) >= 0) AS n FROM {NULLABLE} GROUP BY event_type")
def ifnull_scalar(spark, sf_dir):
    filled = E.ifnull("v", 0.0)
    return _nullable(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(filled), 2).alias("total"), F.count_if(filled >= 0).alias("n"))


@query(f"SELECT event_type, round(sum(coalesce(v, -value)), 2) AS total, count(*) FILTER (coalesce(nullif(event_type, 'view'), 'none') = 'none') AS n_none FROM {NULLABLE} GROUP BY event_type")
def coalesce_cols(spark, sf_dir):
    ev = _nullable(spark, sf_dir)
    named = E.ifnull(F.nullif(F.col("event_type"), F.lit("view")), "none")
    return ev.groupBy("event_type").agg(F.round(F.sum(E.ifnull("v", -F.col("value"))), 2).alias("total"), F.count_if(named == "none").alias("n_none"))


@query("SELECT l_returnflag || l_linestatus AS flags, l_returnflag || '/' || l_linestatus AS text, count(*) AS n FROM lineitem GROUP BY ALL")
def concat_text(spark, sf_dir):
    keyed = _t(spark, sf_dir, "lineitem").select(E.concat_text("l_returnflag", "l_linestatus").alias("flags"), E.concat_text("l_returnflag", F.lit("/"), "l_linestatus").alias("text"))
    return keyed.groupBy("flags", "text").agg(F.count("*").alias("n"))


@query("""SELECT CAST((l_linenumber << 16) | (l_linenumber & 65535) AS INTEGER) AS short_key, (CAST(l_linenumber AS BIGINT) << 32) | 7 AS int_key, count(*) AS n FROM lineitem GROUP BY ALL""")
def concat_keys(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(E.pack_shorts("l_linenumber", "l_linenumber").alias("short_key"), E.pack_ints("l_linenumber", F.lit(7)).alias("int_key"))
    return li.groupBy("short_key", "int_key").agg(F.count("*").alias("n"))


# Aggregates


@query("""SELECT l_returnflag, min(l_quantity) AS low_qty, max(l_quantity) AS high_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_linestatus) AS low_status FROM lineitem GROUP BY l_returnflag""")
def agg_min_max(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("low_qty"), F.max("l_quantity").alias("high_qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.min("l_linestatus").alias("low_status"))


@query(f"SELECT event_type, count(*) AS all_rows, count(v) AS values_only, count(*) FILTER (v > 50) AS chosen FROM {NULLABLE} GROUP BY event_type")
def agg_count_variants(spark, sf_dir):
    return _nullable(spark, sf_dir).groupBy("event_type").agg(A.countall().alias("all_rows"), F.count("v").alias("values_only"), F.count_if(F.col("v") > 50).alias("chosen"))


@query("""SELECT l_returnflag, round(var_pop(l_quantity), 4) AS var_pop, round(var_samp(l_quantity), 4) AS var_samp, round(variance(l_quantity), 4) AS variance,
round(stddev_pop(l_quantity), 4) AS stddev_pop, round(stddev_samp(l_quantity), 4) AS stddev_samp, round(stddev(l_quantity), 4) AS stddev FROM lineitem GROUP BY l_returnflag""")
def agg_variance_family(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(f("l_quantity"), 4).alias(n) for n, f in A.VARIANCES.items()])


@query("""SELECT l_returnflag, round(sum(l_extendedprice * q) / sum(q), 4) AS vwap
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS q FROM lineitem) GROUP BY l_returnflag""")
def agg_wavg(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")))
    return li.groupBy("l_returnflag").agg(F.round(A.wavg("l_extendedprice", "q"), 4).alias("vwap"))


@query("SELECT event_type, true AS close FROM events GROUP BY event_type")
def agg_approxdc(spark, sf_dir):
    """Of distinct pairs, which leave both counts as they are: aggregated beside a distinct
    count, every pair would carry a sketch of its own."""
    pairs = _t(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    found = pairs.groupBy("event_type").agg(A.approxdc("user_id", 0.02).alias("near"), F.count("user_id").alias("exact"))
    return found.select("event_type", (F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query("SELECT true AS close")
def agg_approxdc_merge(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    near = ev.groupBy("event_type").agg(A.approxdc_sketch("user_id").alias("s")).agg(A.approxdc_merge("s").alias("near"))
    exact = ev.agg(F.countDistinct("user_id").alias("exact"))
    return near.select((F.abs(F.col("near") - exact.scalar()) <= 0.1 * exact.scalar()).alias("close"))


@query(f"""SELECT event_type, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, arg_min_null(v, ts) AS first_v, arg_max_null(v, ts) AS last_v FROM {NULLABLE} GROUP BY event_type""")
def agg_first_last_by_ts(spark, sf_dir):
    return _nullable(spark, sf_dir).groupBy("event_type").agg(A.first_by("value", "ts").alias("first_value"), A.last_by("value", "ts").alias("last_value"), A.first_by("v", "ts").alias("first_v"), A.last_by("v", "ts").alias("last_v"))


@query("SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 15000")
def agg_having(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 15000")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_quantity) AS quantities FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_quantity").alias("quantities"))


@query("""SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS f_qty, count(*) FILTER (l_discount > 0.05) AS discounted,
CAST(list_sort(list(DISTINCT l_linenumber)) AS INTEGER[]) AS line_numbers FROM lineitem GROUP BY l_returnflag""")
def agg_filter_clause(spark, sf_dir):
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("tileframe_lineitem")
    return spark.sql("""SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f_qty, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
        array_sort(collect_set(l_linenumber)) AS line_numbers FROM tileframe_lineitem GROUP BY l_returnflag""")


GROUPED = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY "


@query(GROUPED + "CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query(GROUPED + "ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query(GROUPED + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    flags = [F.col("l_returnflag"), F.col("l_linestatus")]
    return li.groupingSets([[flags[0]], [flags[1]], []], *flags).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


# Windows. In order of event_id, which is unique, and split by it: few event types hold
# all rows.

SPLIT = 65_536


def _by_type(order="event_id") -> Spread:
    return Spread(["event_type"], [order], F.call_function("div", F.col(order.removeprefix("-")), F.lit(SPLIT)))


@query(f"""SELECT event_id, count(*) OVER w AS mcount_rows, count(v) OVER w AS mcount, round(sum(v) OVER w, 2) AS msum,
avg(round(v * 100)) OVER w AS mavg_cents, min(v) OVER w AS mmin, max(v) OVER w AS mmax
FROM {NULLABLE} WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_running(spark, sf_dir):
    wanted = {
        "mcount_rows": ("count", None), "mcount": ("count", "v"), "msum": ("sum", "v"),
        "mavg_cents": ("avg", F.round(F.col("v") * 100)), "mmin": ("min", "v"), "mmax": ("max", "v"),
    }
    found = _by_type().running(_nullable(spark, sf_dir), wanted)
    return found.withColumn("msum", F.round("msum", 2)).select("event_id", *wanted)


@query(f"""SELECT event_id, round(sum(v) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 2) AS msum10,
round(sum(v) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 2) AS msum64 FROM {NULLABLE}""")
def win_msum_n(spark, sf_dir):
    found = _by_type().moving(_nullable(spark, sf_dir), 64, {"msum10": ("sum", "v", 10), "msum64": ("sum", "v")})
    return found.select("event_id", F.round("msum10", 2).alias("msum10"), F.round("msum64", 2).alias("msum64"))


@query(f"SELECT event_id, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY event_id), 4) AS delta FROM {NULLABLE}")
def win_lag_delta(spark, sf_dir):
    found = _by_type().moving(_nullable(spark, sf_dir), 2, {"before": ("lag", "v")})
    return found.select("event_id", F.round(F.col("v") - F.col("before"), 4).alias("delta"))


@query("""SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY event_type ORDER BY user_id) AS INTEGER) AS rk,
CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS INTEGER) AS dr, lead(value) OVER w AS next_value,
CAST(ntile(4) OVER w AS INTEGER) AS quarter, first_value(value) OVER w AS first_value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def win_rank_lead(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value")
    types = ev.groupBy("event_type").agg(F.count("*").alias("of"), F.min_by("value", "event_id").alias("first_value"))
    by_user = Spread(["event_type"], ["user_id"], F.call_function("div", F.col("user_id"), F.lit(SPLIT)))
    back = Spread(["event_type"], [F.desc("event_id")], -F.call_function("div", F.col("event_id"), F.lit(SPLIT)))
    rows = back.moving(by_user.ranks(_by_type().numbered(ev, "rn")), 2, {"next_value": ("lag", "value")}).join(types, "event_type")
    return rows.select(
        "event_id", F.col("rn").cast("int").alias("rn"), F.col("rank").cast("int").alias("rk"), F.col("dense_rank").cast("int").alias("dr"),
        "next_value", ntile(F.col("rn"), F.col("of"), 4).cast("int").alias("quarter"), "first_value",
    )


@query("""SELECT o_orderkey, nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_price,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW), 2) AS last_90_days FROM orders""")
def win_nth_range(spark, sf_dir):
    """Partitions are customers, so a window a task holds few rows."""
    by_key = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_time = Window.partitionBy("o_custkey").orderBy(E.micros("o_orderdate")).rangeBetween(-90 * E.MICROS["day"], 0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.nth_value("o_totalprice", 2).over(by_key).alias("second_price"), F.round(F.sum("o_totalprice").over(by_time), 2).alias("last_90_days"))


# Buckets


def _bucketed(spark, sf_dir, bucket) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _bucket_sql(bucket: str) -> str:
    return f"SELECT {bucket} AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


@query(_bucket_sql("time_bucket(INTERVAL '2 minutes', ts, TIMESTAMP '2000-01-01')"))
def bucket_time_2min(spark, sf_dir):
    return _bucketed(spark, sf_dir, E.time_bucket("2 minutes", "ts"))


@query(_bucket_sql("time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01')"))
def bucket_time_day(spark, sf_dir):
    return _bucketed(spark, sf_dir, E.time_bucket("1 day", "ts"))


@query("SELECT time_bucket(INTERVAL '2 months', l_shipdate, TIMESTAMP '2000-01-01') AS bucket, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL")
def bucket_time_month(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(E.time_bucket("2 months", "l_shipdate").alias("bucket")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("""SELECT CAST(time_bucket(INTERVAL '7 days', CAST(l_shipdate AS DATE), DATE '2000-01-01') AS DATE) AS bucket,
CAST(DATE '2000-01-01' + CAST(date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)) // 7 * 7 AS INTEGER) AS DATE) AS toward_epoch, count(*) AS n FROM lineitem GROUP BY ALL""")
def bucket_date_7d(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    return _t(spark, sf_dir, "lineitem").groupBy(E.date_bucket("7 days", day).alias("bucket"), E.date_bucket("7 days", day, legacy=True).alias("toward_epoch")).agg(F.count("*").alias("n"))


@query("SELECT CAST(time_bucket(INTERVAL '3 months', CAST(l_shipdate AS DATE), DATE '2000-01-01') AS DATE) AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def bucket_date_3mon(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(E.date_bucket("3 months", F.col("l_shipdate").cast("date")).alias("bucket")).agg(F.count("*").alias("n"))


# Joins


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name ORDER BY revenue DESC""")
def q5_star_join(spark, sf_dir):
    """The one selective dimension first: lineitem meets the suppliers of the region, then the
    orders of the period, then the customers of the supplier's nation."""
    c, o, li, s, n, r = (_t(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    window = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    nations = n.join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = s.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    sold = li.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(o.where(window), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = sold.join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return bought.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"))


@query("""SELECT s_nationkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey ORDER BY qty DESC, s_nationkey LIMIT 5""")
def join_scalar_key_topk(spark, sf_dir):
    joined = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_nationkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n")).orderBy(F.desc("qty"), "s_nationkey").limit(5)


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def join_left(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN nation ON s_nationkey = n_nationkey")
def join_full(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "full").select("n_name", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti(spark, sf_dir):
    dear = _t(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return _t(spark, sf_dir, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, sf_dir):
    rich = _t(spark, sf_dir, "supplier").where("s_acctbal > 9000")
    return rich.join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    """Region and nation have a fixed number of rows."""
    return _t(spark, sf_dir, "region").crossJoin(_t(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


# Sort, limit, set operations, subqueries


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def topk(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 20")
def limit_ordered(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.asc_nulls_first("o_orderdate"), "o_orderkey").limit(20)


def _keys(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.union(b)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500")
def set_except(spark, sf_dir):
    rich = _t(spark, sf_dir, "supplier").where("s_acctbal > 9500").select("s_nationkey")
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(rich)


CTE = """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS n, round(sum(total), 2) AS total FROM {customer} JOIN spent ON c_custkey = o_custkey GROUP BY c_mktsegment"""


@query(CTE.format(customer="customer"))
def cte_subquery(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    _t(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(CTE.format(customer="customer"))


EXISTS = """SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)
AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)"""


@query(EXISTS)
def exists_subquery(spark, sf_dir):
    for name in ("supplier", "nation", "lineitem"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(EXISTS)


# Tiles


def _tiles(spark, sf_dir) -> DataFrame:
    return tiles.pack(_nullable(spark, sf_dir), ["event_type"], ["event_id", "v"], ["event_id"], split=_tile_split())


def _tile_split():
    return F.call_function("div", F.col("event_id"), F.lit(SPLIT))


@query(f"SELECT event_type, event_id, v FROM {NULLABLE}")
def tile_roundtrip(spark, sf_dir):
    return tiles.unnest(_tiles(spark, sf_dir), ["event_id", "v"]).select("event_type", "event_id", "v")


TILED = f"(SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS tile_id FROM {NULLABLE})"


@query(f"""SELECT event_type, CAST(tile_id AS BIGINT) AS tile_id, CAST(count(*) AS INTEGER) AS lanes, arg_min(v, event_id) AS v_first, arg_max(v, event_id) AS v_last, min(v) AS v_low, max(v) AS v_high
FROM {TILED} GROUP BY ALL""")
def tile_zone_map(spark, sf_dir):
    return tiles.zone_map(_tiles(spark, sf_dir), ["v"]).drop("event_id")


@query(f"""SELECT event_type, CAST(tile_id AS BIGINT) AS tile_id, '{{' || string_agg(CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '?' END, ',' ORDER BY event_id) || repeat(',', CAST(64 - count(*) AS INTEGER)) || '}}' AS tile,
CAST(count(*) AS INTEGER) AS lanes FROM {TILED} GROUP BY ALL""")
def tile_format(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").withColumn("id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    text = tiles.pack(ev, ["event_type"], ["id"], ["event_id"], split=_tile_split()).select("event_type", "tile_id", tiles.format_tile("id").alias("tile"))
    return text.withColumn("lanes", F.size(tiles.parse_tile("tile", "bigint")))


@query(f"SELECT event_type, event_id, v FROM {NULLABLE} WHERE v > 90 ORDER BY v DESC, event_id LIMIT 25")
def tile_limit(spark, sf_dir):
    """Order and limit over unpacked rows."""
    rows = tiles.unnest(_tiles(spark, sf_dir), ["event_id", "v"], F.col("v") > 90)
    return rows.select("event_type", "event_id", "v").orderBy(F.desc("v"), "event_id").limit(25)


@query("""SELECT n_name, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE l_quantity > 25 GROUP BY n_name""")
def tile_join(spark, sf_dir):
    """Joins over unpacked rows; tiles of a supplier, whose rows are few."""
    packed = tiles.pack(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity"], ["l_orderkey", "l_linenumber"])
    sold = tiles.unnest(packed, ["l_quantity"], F.col("l_quantity") > 25).join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = sold.join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


# Projections


def _engine(spark, sf_dir, source, vectors, scalars, order_by=None) -> Engine:
    catalog = Catalog(spark, _scratch(spark, "projections"))
    catalog.register_source(source, f"{sf_dir}/{source}.parquet")
    catalog.create_projection("own", source, vectors, scalars, order_by)
    catalog.refresh("own")
    return Engine(catalog, substitute=True)


def _substituted(engine: Engine, text: str) -> DataFrame:
    """The query's rows, from a projection or not at all."""
    found = engine.explain_substitution(text)
    if "-> own" not in found:
        raise AssertionError(found)
    return engine.sql(text)


Q1_VECTORS = ["l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(Q1_SQL)
def projection_q1(spark, sf_dir):
    return _substituted(_engine(spark, sf_dir, "lineitem", Q1_VECTORS, ["l_returnflag", "l_linestatus"]), Q1_TEXT)


RANGE = "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-01' GROUP BY l_linestatus"


@query(RANGE)
def projection_range(spark, sf_dir):
    engine = _engine(spark, sf_dir, "lineitem", ["l_shipdate", "l_quantity"], ["l_linestatus"], "l_shipdate")
    return _substituted(engine, RANGE.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


JOINED = "SELECT s_nationkey, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey"


@query(JOINED)
def projection_join(spark, sf_dir):
    engine = _engine(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice"], ["l_suppkey"])
    engine.catalog.register_source("supplier", f"{sf_dir}/supplier.parquet")
    return _substituted(engine, JOINED)


@query("SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag")
def projection_by_name(spark, sf_dir):
    """A refreshed projection is a view under its own name."""
    engine = _engine(spark, sf_dir, "lineitem", ["l_quantity"], ["l_returnflag"])
    return engine.spark.sql("SELECT l_returnflag, sum(l_quantity) AS qty FROM own GROUP BY l_returnflag")


@query("""SELECT * FROM (VALUES ('summed', 'lineitem -> own'), ('plain', 'none: the query does not aggregate'),
('lacking', 'none: own: aggregates use l_tax'), ('dropped', 'none: no projection of the sources')) AS t(text, choice)""")
def projection_explain(spark, sf_dir):
    """What substitution would do, before and after the projection is dropped."""
    engine = _engine(spark, sf_dir, "lineitem", ["l_quantity"], ["l_returnflag"])
    summed = "SELECT l_returnflag, sum(l_quantity) FROM lineitem GROUP BY l_returnflag"
    texts = {"summed": summed, "plain": "SELECT l_quantity FROM lineitem", "lacking": "SELECT sum(l_tax) FROM lineitem GROUP BY l_returnflag"}
    rows = [(name, engine.explain_substitution(text)) for name, text in texts.items()]
    engine.catalog.drop_projection("own")
    return spark.createDataFrame([*rows, ("dropped", engine.explain_substitution(summed))], "text string, choice string")


@query("SELECT 'own' AS name, 'events' AS source, 'value' AS vector_columns, 'event_type' AS scalar_columns, count(*) AS n_rows FROM events")
def projection_catalog(spark, sf_dir):
    """The catalog as another session of the same root finds it."""
    first = _engine(spark, sf_dir, "events", ["value"], ["event_type"]).catalog
    again = Catalog(spark, first.root)
    rows = [(p.name, p.source, ",".join(p.vector_columns), ",".join(p.scalar_columns), again.read(p.name).count()) for p in again.projections.values()]
    return spark.createDataFrame(rows, "name string, source string, vector_columns string, scalar_columns string, n_rows long")


@query("""SELECT count(*) FILTER (ts <= TIMESTAMP '2024-01-15') AS first_rows, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS added_rows, CAST(0 AS BIGINT) AS again_rows, count(*) AS all_rows, round(sum(value), 2) AS total FROM events""")
def projection_refresh(spark, sf_dir):
    """Refreshes after half of the rows, after the rest, and once more."""
    root = _scratch(spark, "refresh")
    ev, source = _t(spark, sf_dir, "events"), f"{root}/source"
    half = F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")
    tables.populate(ev, source, predicate=half)
    catalog = Catalog(spark, f"{root}/catalog")
    catalog.register_source("events", source)
    catalog.create_projection("own", "events", ["ts", "value"], ["event_type"], "ts")
    first = catalog.refresh("own")
    tables.populate(ev, source, predicate=~half)
    added, again = catalog.refresh("own"), catalog.refresh("own")
    return catalog.read("own").agg(F.lit(first).cast("long").alias("first_rows"), F.lit(added).cast("long").alias("added_rows"), F.lit(again).cast("long").alias("again_rows"), F.count("*").alias("all_rows"), F.round(F.sum("value"), 2).alias("total"))


# Sources


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_import_roundtrip(spark, sf_dir):
    path = _scratch(spark, "csv")
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.write.mode("overwrite").csv(f"{path}/in", header=True, quote='"', escape='"', emptyValue="")
    tables.import_csv(spark, f"{path}/in", f"{path}/out", "n_nationkey int, n_name string, n_regionkey int", skip=1)
    return spark.read.parquet(f"{path}/out")


@query("SELECT l_returnflag, sum(l_quantity) AS qty, sum(l_linenumber)::BIGINT AS line_sum FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def populate_filtered(spark, sf_dir):
    path = _scratch(spark, "populate")
    tables.populate(_t(spark, sf_dir, "lineitem"), f"{path}/t", ["l_returnflag", "l_quantity", "l_linenumber"], "l_quantity > 10", ["l_returnflag", "l_quantity"])
    return spark.read.parquet(f"{path}/t").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.sum("l_linenumber").alias("line_sum"))


@query("SELECT l_returnflag AS flag, sum(l_quantity) AS qty FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag")
def view_column_mapping(spark, sf_dir):
    tables.register_view(spark, "sales_view", f"{sf_dir}/lineitem.parquet", {"flag": "l_returnflag", "amount": "l_quantity"})
    return spark.sql("SELECT flag, sum(amount) AS qty FROM sales_view WHERE l_discount < 0.05 GROUP BY flag")


@query("""SELECT 'l_quantity' AS "column", count(*) AS n_rows, count(*) - count(l_quantity) AS n_null, CAST(min(l_quantity) AS VARCHAR) AS low, CAST(max(l_quantity) AS VARCHAR) AS high FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), min(l_returnflag), max(l_returnflag) FROM lineitem""")
def table_statistics(spark, sf_dir):
    return tables.statistics(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag").drop("n_distinct")


CSV_TEXT = '''a note
another
1;'it''s; fine';1.5
2;"say ""hi""";
3;'';2
4;;3'''


@query("SELECT * FROM (VALUES (1, 'it''s; fine', 1.5), (2, 'say \"hi\"', NULL), (3, '', 2.0), (4, NULL, 3.0)) AS t(id, name, x)".replace("1.5", "CAST(1.5 AS DOUBLE)"))
def csv_two_quotes(spark, sf_dir):
    """Fields quoted with either character, two lines left out at the start of the file."""
    path = _scratch(spark, "csv")
    spark.createDataFrame([(CSV_TEXT,)], "value string").coalesce(1).write.text(f"{path}/in")
    return tables.read_csv(spark, f"{path}/in", "id int, name string, x double", separator=";", skip=2, quote="\"'")


@query()
def table_sample_stats(spark, sf_dir):
    """A sampling operator: 10 % of the rows."""
    return tables.sample_rows(_t(spark, sf_dir, "lineitem"), 0.1).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 2).alias("avg_qty"))
