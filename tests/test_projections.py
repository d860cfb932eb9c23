"""Projections, substitution, refresh, CSV import and views."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tileframe.plans.projections import Catalog
from tileframe.plans.substitution import Engine
from tileframe.sources import tables
from tileframe.streaming.refresh import stream_refresh

STOCK = [(10.0, 11.0, 10.1, 10.8), (11.0, 12.0, 11.2, 11.5), (10.4, 10.6, 10.5, 10.4), (11.1, 11.5, 11.2, 11.4), (11.0, 11.3, 11.4, 11.1)]
MORE = [(10.1, 10.8, 10.3, 10.2), (11.1, 11.8, 10.2, 11.4), (11.2, 11.6, 11.4, 11.3), (10.6, 11.1, 11.3, 10.8), (10.7, 11.3, 10.8, 11.1)]
TEXT = "SELECT avg((open + close) / 2) AS mid, max(high - low) AS spread FROM stock GROUP BY symbol"


def rows(spark, values, start):
    data = [("AAA", dt.date(2018, start + k, 11), *v) for k, v in enumerate(values)]
    return spark.createDataFrame(data, "symbol string, day date, low float, high float, open float, close float")


@pytest.fixture
def stock(spark):
    root = tempfile.mkdtemp(prefix="spark-test-")
    rows(spark, STOCK, 1).write.parquet(f"{root}/stock")
    catalog = Catalog(spark, f"{root}/catalog")
    catalog.register_source("stock", f"{root}/stock")
    catalog.create_projection("vstock", "stock", ["day", "low", "high", "open", "close"], ["symbol"], "day")
    return catalog


def files_of(df):
    return {f.rsplit("/", 3)[-3] for f in df.inputFiles()}


def test_refresh_and_substitution(spark, stock):
    on, off = Engine(stock, substitute=True), Engine(stock)
    assert "none" in on.explain_substitution(TEXT)  # nothing in it yet
    assert stock.refresh("vstock") == 5
    first = on.sql(TEXT)
    assert files_of(first) == {"vstock"}
    assert tuple(first.first()) == tuple(off.sql(TEXT).first()) == (pytest.approx(10.96, abs=1e-6), pytest.approx(1.0, abs=1e-6))
    rows(spark, MORE, 6).write.mode("append").parquet(stock.sources["stock"])
    stock.register_source("stock", stock.sources["stock"])
    assert stock.refresh("vstock") == 5
    assert stock.refresh("vstock") == 0
    assert tuple(on.sql(TEXT).first()) == tuple(off.sql(TEXT).first())
    assert on.sql(TEXT).first()["mid"] == pytest.approx(10.92, abs=1e-6)


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("SELECT symbol, day FROM stock", "aggregate"),
        ("SELECT day, count(*) FROM stock GROUP BY day", "outside"),
        ("SELECT max(symbol) FROM stock", "aggregates use"),
        ("SELECT s.day, t.n FROM stock s JOIN (SELECT count(*) AS n FROM names) t ON s.low > t.n", "outside"),
        ("SELECT sum(a.low) FROM stock a JOIN stock b ON a.symbol = b.symbol", "more than once"),
        ("SELECT sum(low) FROM stock WHERE low > (SELECT avg(low) FROM stock)", "Subquery"),
        ("SELECT sum(low) OVER (PARTITION BY symbol ORDER BY day) FROM stock", "Window"),
    ],
)
def test_no_substitution(spark, stock, text, why):
    stock.refresh("vstock")
    spark.createDataFrame([("AAA", "first")], "symbol string, label string").write.parquet(f"{stock.root}/names")
    stock.register_source("names", f"{stock.root}/names")
    engine = Engine(stock, substitute=True)
    assert why in engine.explain_substitution(text)
    assert "vstock" not in files_of(engine.sql(text))


def test_filters_may_use_scalar_columns(stock):
    stock.refresh("vstock")
    engine = Engine(stock, substitute=True)
    assert engine.explain_substitution("SELECT sum(low) AS s FROM stock WHERE symbol = 'AAA' AND day > DATE '2018-02-01' GROUP BY symbol HAVING count(*) > 1 ORDER BY s") == "stock -> vstock"


def test_smallest_projection_wins_under_a_join(spark, stock):
    root = stock.root
    spark.createDataFrame([("AAA", "first")], "symbol string, label string").write.parquet(f"{root}/names")
    stock.register_source("names", f"{root}/names")
    stock.create_projection("narrow", "stock", ["low"], ["symbol"])
    for name in ("vstock", "narrow"):
        stock.refresh(name)
    engine = Engine(stock, substitute=True)
    text = "SELECT label, sum(low) AS s FROM stock JOIN names ON stock.symbol = names.symbol GROUP BY label"
    assert engine.explain_substitution(text) == "stock -> narrow"
    assert tuple(engine.sql(text).first()) == tuple(Engine(stock).sql(text).first())


def test_without_order_key_a_refresh_replaces(stock):
    stock.create_projection("plain", "stock", ["low"], ["symbol"])
    assert stock.refresh("plain") == 5
    assert stock.refresh("plain") == 5
    assert stock.read("plain").count() == 5


def test_catalog_survives_and_drops(spark, stock):
    stock.refresh("vstock")
    again = Catalog(spark, stock.root)
    assert again.projections == stock.projections
    again.drop_projection("vstock")
    assert Catalog(spark, stock.root).projections == {}


def test_bad_definitions(stock):
    for bad in (("vstock", "stock", ["day"]), ("a", "none", ["day"]), ("a", "stock", ["dya"]), ("a", "stock", ["low"], ["symbol"], "day"), ("a", "stock", ["low"], ["low"])):
        with pytest.raises(ValueError):
            stock.create_projection(*bad)


def test_stream_refresh(spark, stock):
    marks = f"{stock.root}/marks"
    engine = Engine(stock, substitute=True)
    stream_refresh(stock, "vstock", marks).awaitTermination()
    assert engine.explain_substitution(TEXT) == "stock -> vstock"
    assert engine.sql(TEXT).first()["mid"] == pytest.approx(10.96, abs=1e-6)
    rows(spark, MORE, 6).write.mode("append").parquet(stock.sources["stock"])
    stream_refresh(stock, "vstock", marks).awaitTermination()
    assert stock.read("vstock").count() == 10
    assert engine.sql(TEXT).first()["mid"] == pytest.approx(10.92, abs=1e-6)
    with pytest.raises(ValueError):
        stock.refresh("vstock")
    stock.create_projection("batches", "stock", ["low"])
    stock.refresh("batches")
    with pytest.raises(ValueError):
        stream_refresh(stock, "batches", f"{stock.root}/others")


def test_substitution_keeps_the_session(spark, stock):
    """Settings, functions and views of the caller's session hold under substitution."""
    stock.refresh("vstock")
    on, off = Engine(stock, substitute=True), Engine(stock)
    spark.udf.register("plus1", lambda x: x + 1, "double")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION halved(x DOUBLE) RETURNS DOUBLE RETURN x / 2")
    texts = [
        "SELECT max(hour(timestamp_seconds(1520000000 + 0 * day(day)))) AS h, sum(plus1(low)) AS s FROM stock GROUP BY symbol",
        "SELECT symbol, sum(halved(low)) AS s FROM stock WHERE halved(high) > 5 GROUP BY symbol",
        "SELECT sum(l) AS s FROM (SELECT low AS l, symbol FROM stock) GROUP BY symbol",
    ]
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for text in texts:
                assert on.explain_substitution(text) == "stock -> vstock"
                assert files_of(on.sql(text)) == {"vstock"}
                assert on.sql(text).collect() == off.sql(text).collect()
        spark.sql("SELECT low + 1 AS low FROM stock").createOrReplaceTempView("raised")
        assert on.sql("SELECT sum(low) FROM raised").first() == off.sql("SELECT sum(low) FROM raised").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    # The source's own name is the source again.
    assert "vstock" not in files_of(spark.sql("SELECT * FROM stock"))


def test_null_order_keys(spark, stock):
    lost = spark.createDataFrame([("AAA", None, 3.0, 4.0, 3.5, 3.5), ("BBB", None, 5.0, 6.0, 5.5, 5.5)], "symbol string, day date, low float, high float, open float, close float")
    text = "SELECT sum(low) AS s, count(*) AS n FROM stock GROUP BY symbol ORDER BY s"
    on, off = Engine(stock, substitute=True), Engine(stock)
    lost.write.mode("append").parquet(stock.sources["stock"])
    assert stock.refresh("vstock") == 7
    assert on.explain_substitution(text) == "stock -> vstock" and on.sql(text).collect() == off.sql(text).collect()
    assert stock.refresh("vstock") == 0
    lost.limit(1).write.mode("append").parquet(stock.sources["stock"])
    rows(spark, MORE, 6).write.mode("append").parquet(stock.sources["stock"])
    stock.register_source("stock", stock.sources["stock"])
    assert stock.refresh("vstock") == 13
    assert on.sql(text).collect() == off.sql(text).collect()


def test_names_of_any_case_and_views(spark, stock):
    stock.register_source("Trades", stock.sources["stock"])
    stock.create_projection("Narrow", "TRADES", ["low"], ["symbol"])
    stock.refresh("NARROW")
    assert Engine(stock, substitute=True).explain_substitution("SELECT sum(t.low) FROM Trades t GROUP BY symbol") == "trades -> narrow"
    assert spark.sql("SELECT count(*) FROM narrow").first()[0] == 5
    assert spark.sql("SELECT sum(low) AS s FROM Narrow").first()["s"] == pytest.approx(53.5)


def test_refresh_prunes(spark, stock):
    """A range of the order key opens few of the projection's row groups."""
    root = tempfile.mkdtemp(prefix="spark-test-")
    spark.range(200_000).selectExpr("id", "pmod(xxhash64(id), 100000) AS k", "CAST(id AS DOUBLE) AS v").repartition(4).write.parquet(f"{root}/t")
    stock.register_source("t", f"{root}/t")
    stock.create_projection("pt", "t", ["k", "v"], [], "k")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        stock.refresh("pt")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    text = "SELECT count(*) AS n, sum(v) AS s FROM t WHERE k BETWEEN 500 AND 900"
    on, off = Engine(stock, substitute=True).sql(text), Engine(stock).sql(text)
    assert on.collect() == off.collect()
    assert scanned(on) < 0.5 * scanned(off)


def scanned(df):
    """Rows that the scans of an executed query put out."""
    def leaves(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return leaves(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(plan.plan())
        children = plan.children()
        found = [leaves(children.apply(k)) for k in range(children.size())]
        return sum(found, []) if found else [plan]

    df.collect()
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in leaves(df._jdf.queryExecution().executedPlan()))


def test_csv_import(spark):
    root = tempfile.mkdtemp(prefix="spark-test-")
    with open(f"{root}/a.csv", "w") as f:
        f.write('one line\nid;name;x\n1;"a;b";1.5\n2;"say ""hi""";\n3;"";2\n4;;3\n')
    got = tables.read_csv(spark, f"{root}/a.csv", "id int, name string, x double", separator=";", skip=2).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a;b", 1.5), (2, 'say "hi"', None), (3, "", 2.0), (4, None, 3.0)]
    with open(f"{root}/b.csv", "w") as f:
        f.write("id,name\n1,'it''s'\n")
    assert tables.import_csv(spark, f"{root}/b.csv", f"{root}/out", "id int, name string", skip=1, quote="'") == 1
    assert spark.read.parquet(f"{root}/out").first()["name"] == "it's"


def test_csv_files_of_many_blocks(spark):
    root = tempfile.mkdtemp(prefix="spark-test-")
    for name in "ab":
        with open(f"{root}/{name}.csv", "w") as f:
            f.write("x\ny\nz\n" + "".join(f"{name};{k};'{k}''s';\"q{k};\"\n" for k in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = tables.read_csv(spark, f"{root}/*.csv", "f string, k int, s string, q string", separator=";", skip=3, quote="'\"")
        assert got.rdd.getNumPartitions() > 4
        assert got.agg(F.count("*"), F.sum("k"), F.countDistinct("f"), F.count_if(F.col("s") == F.concat(F.col("k"), F.lit("'s"))), F.count_if(F.col("q") == F.concat(F.lit("q"), F.col("k"), F.lit(";")))).first() == (40_000, 2 * sum(range(20_000)), 2, 40_000, 40_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    with pytest.raises(Exception, match="too many fields"):
        tables.read_csv(spark, f"{root}/a.csv", "f string, k int", separator=";", skip=3).collect()


def test_populate_and_view(spark):
    root = tempfile.mkdtemp(prefix="spark-test-")
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert tables.populate(df, f"{root}/t", predicate="v > 3", sort=["v"]) == df.where("v > 3").count()
    tables.register_view(spark, "renamed", f"{root}/t", {"key": "id"})
    assert spark.sql("SELECT min(key) FROM renamed").first()[0] == 4
    with pytest.raises(ValueError):
        tables.register_view(spark, "bad", f"{root}/t", {"key": "none"})


def file_sizes(df):
    return [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]


def test_a_frequent_key_is_no_large_task(spark, tmp_path, monkeypatch):
    """One value in the sort column; its rows are parted, but for copies of one row."""
    monkeypatch.setattr(tables, "FILE_ROWS", 500, raising=False)
    source = spark.range(0, 4000, 1, 3).select(F.lit("N").alias("flag"), F.lit(1.5).alias("qty"), "id")
    source.write.parquet(f"{tmp_path}/sales")
    catalog = Catalog(spark, f"{tmp_path}/catalog")
    catalog.register_source("sales", f"{tmp_path}/sales")
    catalog.create_projection("own", "sales", ["qty"], ["flag"])
    assert catalog.refresh("own") == 4000
    assert tables.populate(source, f"{tmp_path}/sorted", sort=["flag"]) == 4000
    for df in (catalog.read("own"), spark.read.parquet(f"{tmp_path}/sorted")):
        assert sum(file_sizes(df)) == 4000 and max(file_sizes(df)) <= 1000
    assert catalog.read("own").columns == ["flag", "qty"] and spark.read.parquet(f"{tmp_path}/sorted").columns == source.columns
