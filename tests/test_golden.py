"""Small fixed inputs with known results: NULLs, windows, buckets, tiles, text forms."""

import datetime as dt
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tileframe import queries
from tileframe.functions import aggregates as A
from tileframe.functions import expressions as E
from tileframe.operators import tiles
from tileframe.operators.windows import Moving, Spread, ntile


@pytest.fixture(scope="module")
def s(spark):
    rows = [(k, x) for k, x in enumerate([1.0, 2.0, None, 3.0, None, 4.0])]
    return spark.createDataFrame(rows, "at int, x float")


@pytest.fixture(scope="module")
def quote(spark):
    rows = [("AAA", dt.datetime(2018, 3, 12, 10, k), p, n) for k, (p, n) in enumerate([(10.1, 100), (11.2, 120), (10.5, 110), (11.2, 125), (11.4, 105)])]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bid_price float, ask_size int")


def test_filter_and_null_counts(s):
    assert [r["x"] for r in s.where("x > 1").orderBy("at").collect()] == [2, 3, 4]
    assert s.where(E.is_not_null("x")).count() == 4
    assert s.where(E.is_null("x")).count() == 2
    assert s.where(E.ifnull("x", 0.0) >= 0).count() == 6
    assert s.where(E.ifnull("x", F.lit(0.0)) >= 0).count() == 6


@pytest.mark.parametrize(
    ("least", "want"),
    [(0.0, (4, 4, 10, 2.5, 1, 4, 5 / 3, 1.25, 1.29099444873581, 1.11803398874989)), (1.5, (3, 3, 9, 3, 2, 4, 1, 2 / 3, 1, 0.816496580927726))],
)
def test_twelve_aggregates(s, least, want):
    row = s.where(F.col("x") >= least).agg(
        A.countall(), F.count("x"), F.sum("x"), F.avg("x"), F.min("x"), F.max("x"),
        A.VARIANCES["variance"]("x"), A.VARIANCES["var_pop"]("x"), A.VARIANCES["stddev"]("x"), A.VARIANCES["stddev_pop"]("x"),
    ).first()
    assert tuple(row) == pytest.approx(want)


def test_running_windows(s):
    w = Moving([], ["at"])
    got = s.select("at", w.mcount(), w.mcount("x"), w.msum("x"), w.mavg("x"), w.mmin("x"), w.mmax("x"), F.col("x") - w.lag("x")).orderBy("at").collect()
    assert [tuple(r)[1:] for r in got] == [
        (1, 1, 1, 1, 1, 1, None), (2, 2, 3, 1.5, 1, 2, 1), (3, 2, 3, 1.5, 1, 2, None),
        (4, 3, 6, 2, 1, 3, None), (5, 3, 6, 2, 1, 3, None), (6, 4, 10, 2.5, 1, 4, None),
    ]


def test_moving_sum(spark):
    df = spark.range(1, 101).select(F.col("id"), F.col("id").cast("double").alias("x"))
    got = [r[0] for r in df.select(Moving([], ["id"]).msum("x", 10).alias("m"), "id").orderBy("id").collect()]
    assert got == [sum(range(max(1, k - 9), k + 1)) for k in range(1, 101)]
    assert got[-1] == 955
    with pytest.raises(ValueError):
        Moving([], ["id"]).msum("x", 0)
    with pytest.raises(ValueError):
        Moving([], [])


def test_first_last_and_buckets(quote):
    assert tuple(quote.groupBy("symbol").agg(A.first_by("bid_price", "ts"), A.last_by("ask_size", "ts")).first()) == ("AAA", pytest.approx(10.1), 105)
    got = [r[0].minute for r in quote.orderBy("ts").select(E.time_bucket("2 minutes", "ts")).collect()]
    assert got == [0, 0, 2, 2, 4]
    micros = [r[0] for r in quote.orderBy("ts").select(E.micros(E.time_bucket("2 minutes", "ts"))).collect()]
    assert micros[0] == 574164000000000


def test_buckets_before_the_epoch(spark):
    df = spark.createDataFrame([(dt.datetime(1999, 12, 31, 23, 59), dt.date(1999, 12, 30))], "ts timestamp_ntz, d date")
    row = df.select(E.time_bucket("1 hour", "ts"), E.time_bucket("1 hour", "ts", legacy=True), E.date_bucket("7 days", "d"), E.date_bucket("7 days", "d", legacy=True), E.time_bucket("3 months", "ts"), E.date_bucket("1 year", "d")).first()
    assert tuple(row) == (dt.datetime(1999, 12, 31, 23), dt.datetime(2000, 1, 1), dt.date(1999, 12, 25), dt.date(2000, 1, 1), dt.datetime(1999, 10, 1), dt.date(1999, 1, 1))


@pytest.mark.parametrize("width", ["", "2", "2 parsecs", "1 month 2 days", "0 days", "-1 day", "1 day x"])
def test_bad_widths(width):
    with pytest.raises(ValueError):
        E.time_bucket(width, "ts")


def test_date_bucket_needs_days():
    with pytest.raises(ValueError):
        E.date_bucket("90 minutes", "d")


def test_interval_text_predicates(spark):
    rows = [(dt.timedelta(seconds=1), "sec"), (dt.timedelta(minutes=1), "min"), (dt.timedelta(hours=1), "hour")]
    df = spark.createDataFrame(rows, "i interval day to second, t string")
    assert df.where("t = 'min'").count() == 1
    assert df.where(F.col("i") >= F.expr("INTERVAL '1' MINUTE")).count() == 2
    got = df.select(E.interval_micros("i").alias("us"), E.micros_interval(E.interval_micros("i")).alias("back"), E.interval_ratio("i", F.expr("INTERVAL '7' SECOND")), E.interval_rest("i", F.expr("INTERVAL '7' SECOND"))).orderBy("us").collect()
    assert [tuple(r) for r in got] == [(1_000_000, rows[0][0], 0, 1_000_000), (60_000_000, rows[1][0], 8, 4_000_000), (3_600_000_000, rows[2][0], 514, 2_000_000)]


def test_real_arithmetic_keeps_single_precision(spark):
    rows = [(10.1, 10.8), (11.2, 11.5), (10.5, 10.4), (11.2, 11.4), (11.4, 11.1)]
    df = spark.createDataFrame(rows, "open float, close float")
    mean = df.select(F.avg(E.as_real(E.as_real(F.col("open") + F.col("close")) / 2))).first()[0]
    assert mean == pytest.approx(10.960000038147, abs=1e-9)


def test_strict_booleans(spark):
    df = spark.createDataFrame([(True, None), (False, None), (True, False)], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(E.strict_and(a, b), E.strict_or(a, b), a & b, a | b).collect()] == [(None, None, None, True), (None, None, False, None), (False, True, False, True)]


def test_keys_and_division(spark):
    df = spark.createDataFrame([("A", "F", -7, -1)], "l string, r string, n int, m int")
    row = df.select(E.pack_chars("l", "r"), E.int_div("n", 2), F.col("n") % 3, E.pack_ints("n", "m"), E.pack_shorts("n", "m")).first()
    assert tuple(row) == (16710, -3, -1, (-7 << 32) | 0xFFFFFFFF, (-7 << 16) | 0xFFFF)


def test_wavg_and_approxdc(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 3.0), (1, None, 5.0), (1, 7.0, None), (2, 5.0, 0.0), (3, None, None)], "k int, p double, v double")
    got = {r["k"]: (r["w"], r["d"]) for r in df.groupBy("k").agg(A.wavg("p", "v").alias("w"), A.approxdc("p").alias("d")).collect()}
    assert got == {1: (17.5, 3), 2: (None, 1), 3: (None, None)}


def test_approxdc_has_no_sketch_for_each_value(spark, tmp_path):
    rows = [(t, u) for t in ("a", "b") for u in [*range(50), *range(50), None]] + [("c", None), (None, 1)]
    spark.createDataFrame(rows, "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["agg_approxdc"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("a", True), ("b", True), ("c", None), (None, True)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "approx_count_distinct" in plan
    assert not [line for line in plan.splitlines() if "approx_count_distinct" in line and re.search(r"keys=\[[^]]*user_id", line)]


def test_map_reduce(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (1, 4.0, None), (None, 1.0, 1), (2, None, 7)], "k int, x double, y int")
    got = {r["group_by"]: (r["count"], r["aggs"]) for r in A.map_reduce(df, "k", "sum,count,max", "x", "y", "y").collect()}
    assert got == {1: (2, [6.0, 1.0, 5.0]), 2: (1, [None, 1.0, 7.0])}
    assert A.map_reduce(df, ["k", "y"], "avg", "x").count() == 2
    with pytest.raises(ValueError):
        A.map_reduce(df, "k", "median", "x")
    with pytest.raises(ValueError):
        A.map_reduce(df, "k", "sum,avg", "x")


def test_tiles(s):
    packed = tiles.pack(s.withColumn("k", F.col("at") % 2), ["k"], ["at", "x"], ["at"], size=2)
    assert packed.count() == 4
    back = tiles.unnest(packed, ["at", "x"]).orderBy("at")
    assert [tuple(r) for r in back.select("at", "x").collect()] == [tuple(r) for r in s.orderBy("at").collect()]
    one = tiles.pack(s, [], ["x"], ["at"])
    assert tuple(one.select(tiles.first("x"), tiles.last("x"), tiles.low("x"), tiles.high("x")).first()) == (1, 4, 1, 4)
    text = one.select(tiles.format_tile(F.col("x").cast("array<int>")).alias("t"))
    assert text.first()["t"] == "{1,2,?,3,?,4" + "," * 58 + "}"
    assert text.select(tiles.parse_tile("t", "int")).first()[0] == [1, 2, None, 3, None, 4]
    assert text.select(tiles.parse_tile(F.lit("7"), "int", 3)).first()[0] == [7, 7, 7]


def test_split_tiles_are_the_same_tiles(s):
    for size in (2, 4, 64):
        want = sorted(map(tuple, tiles.pack(s, [], ["at", "x"], ["at"], size=size).collect()))
        assert sorted(map(tuple, tiles.pack(s, [], ["at", "x"], ["at"], size=size, split=F.floor(F.col("at") / 3)).collect())) == want


@pytest.mark.parametrize("rows", [3, 50])
def test_spread_equals_moving(spark, rows, monkeypatch):
    """Split partitions, some of them empty or with null keys, give what whole ones give."""
    monkeypatch.setattr(Spread, "ROWS", rows)
    df = spark.range(200).selectExpr("id * 3 AS id", "CASE WHEN id % 5 <> 0 THEN id % 3 END AS k", "CASE WHEN id % 4 <> 0 AND id > 20 THEN CAST((id * 7919) % 101 AS DOUBLE) END AS v")
    spread, whole = Spread(["k"], ["id"], F.floor(F.col("id") / 40)), Moving(["k"], ["id"])
    got = spread.running(df, {"a": ("count", None), "b": ("count", "v"), "c": ("sum", "v"), "d": ("avg", "v"), "e": ("min", "v"), "f": ("max", "v")})
    want = df.select("*", whole.mcount(), whole.mcount("v"), whole.msum("v"), whole.mavg("v"), whole.mmin("v"), whole.mmax("v"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    for n in (1, 2, 7, 90):
        got = spread.moving(df, n, {"a": ("count", "v"), "b": ("sum", "v"), "c": ("max", "v"), "d": ("lag", "v"), "e": ("sum", "v", (n + 1) // 2), "f": ("lag", "v", 1)})
        want = df.select("*", whole.mcount("v", n), whole.msum("v", n), whole.mmax("v", n), F.lag("v", n - 1).over(whole.spec), whole.msum("v", (n + 1) // 2), F.col("v"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    ties = df.withColumn("u", F.floor(F.col("id") / 7))
    spec = Window.partitionBy("k").orderBy("u")
    got = Spread(["k"], ["u"], F.floor(F.col("u") / 10)).ranks(ties)
    want = ties.select("*", F.rank().over(spec), F.dense_rank().over(spec))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        Spread([], [], F.lit(0))
    with pytest.raises(ValueError):
        spread.moving(df, 3, {"a": ("sum", "v", 4)})


def test_ntile(spark):
    for n in (1, 3, 4, 5, 11):
        df = spark.range(1, n + 1).withColumn("k", F.lit(1))
        got = df.select(ntile(F.col("id"), F.lit(n), 4).cast("int"), F.ntile(4).over(Window.partitionBy("k").orderBy("id"))).collect()
        assert all(a == b for a, b in got)


def test_legacy_month_buckets(spark):
    df = spark.createDataFrame([(dt.date(1999, 12, 30),)], "d date")
    assert tuple(df.select(E.date_bucket("3 months", "d"), E.date_bucket("3 months", "d", legacy=True)).first()) == (dt.date(1999, 10, 1), dt.date(2000, 1, 1))


def test_sql_names(spark):
    from tileframe.functions import sql_names

    sql_names.register(spark)
    row = spark.sql("""SELECT betwixt(2, 1, 3), betwixt_text('b', 'a', 'bb'), strict_or(true, NULL), pack_chars('A', 'F'), pack_ints(-7, -1),
        time_bucket(INTERVAL '2' MINUTE, TIMESTAMP_NTZ'2018-03-12 10:03:59'), time_micros(TIMESTAMP_NTZ'2018-03-12 10:00:00'),
        date_bucket(7, DATE'1999-12-30'), month_bucket(3, DATE'2018-05-09'), day_number(DATE'2000-02-01')""").first()
    assert tuple(row) == (True, True, None, 16710, (-7 << 32) | 0xFFFFFFFF, dt.datetime(2018, 3, 12, 10, 2), 574164000000000, dt.date(1999, 12, 25), dt.date(2018, 4, 1), 31)


def test_betwixt_never_answers_wrong(spark):
    from tileframe.functions import sql_names

    sql_names.register(spark)
    row = spark.sql("""SELECT betwixt_long(9007199254740993, 9007199254740992, 9007199254740992), betwixt_decimal(9007199254740993, 0, 9007199254740992),
        betwixt(2.5, 1, 3), betwixt(NULL, 1, 3), betwixt_double(1e300, 1, 1e301), pack_shorts(-7, -1), interval_ratio(INTERVAL '1' HOUR, INTERVAL '7' SECOND),
        interval_micros(INTERVAL '1' MINUTE), ifnull_long(NULL, 4), is_null(NULL), wavg_parts(2, 3).product""").first()
    assert tuple(row) == (False, False, True, None, True, (-7 << 16) | 0xFFFF, 514, 60_000_000, 4, True, 6.0)
    with pytest.raises(Exception, match="betwixt"):
        spark.sql("SELECT betwixt(9007199254740993, 9007199254740992, 9007199254740992)").first()
