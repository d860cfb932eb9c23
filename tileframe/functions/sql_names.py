"""SQL names of the scalar functions: temporary functions whose bodies are SQL, so that
the optimizer sees through them. A SQL function has one signature, so names differ by type
where types must not be widened; ``betwixt`` takes numbers that a DOUBLE holds exactly and
raises an error beyond. Aggregates by time have SQL names of their own already (``min_by``,
``max_by``, ``approx_count_distinct``, ``var_pop`` and so on); ``wavg_parts`` gives the
two terms whose sums make a weighted average."""

from __future__ import annotations

from pyspark.sql import SparkSession

_EPOCH = "TIMESTAMP_NTZ'2000-01-01'"
_MICROS = f"timestampdiff(MICROSECOND, {_EPOCH}, {{}})"
_WIDTH = _MICROS.format(f"{_EPOCH} + width")

FUNCTIONS = {
    "betwixt(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS BOOLEAN": "CASE WHEN greatest(abs(x), abs(low), abs(high)) < 9007199254740992 THEN x BETWEEN low AND high WHEN x IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL THEN raise_error('betwixt: use betwixt_long, betwixt_decimal or betwixt_double for numbers of 2^53 and more') END",
    "betwixt_double(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS BOOLEAN": "x BETWEEN low AND high",
    "betwixt_long(x BIGINT, low BIGINT, high BIGINT) RETURNS BOOLEAN": "x BETWEEN low AND high",
    "betwixt_decimal(x DECIMAL(38,10), low DECIMAL(38,10), high DECIMAL(38,10)) RETURNS BOOLEAN": "x BETWEEN low AND high",
    "ifnull_text(x STRING, other STRING) RETURNS STRING": "coalesce(x, other)",
    "ifnull_long(x BIGINT, other BIGINT) RETURNS BIGINT": "coalesce(x, other)",
    "ifnull_double(x DOUBLE, other DOUBLE) RETURNS DOUBLE": "coalesce(x, other)",
    "is_null(x STRING) RETURNS BOOLEAN": "x IS NULL",
    "is_not_null(x STRING) RETURNS BOOLEAN": "x IS NOT NULL",
    "wavg_parts(price DOUBLE, volume DOUBLE) RETURNS STRUCT<product: DOUBLE, volume: DOUBLE>": "named_struct('product', price * volume, 'volume', CASE WHEN price IS NOT NULL THEN volume END)",
    "pack_shorts(l INT, r INT) RETURNS INT": "shiftleft(l, 16) | (r & 65535)",
    "interval_micros(i INTERVAL DAY TO SECOND) RETURNS BIGINT": _MICROS.format(f"{_EPOCH} + i"),
    "interval_ratio(a INTERVAL DAY TO SECOND, b INTERVAL DAY TO SECOND) RETURNS BIGINT": f"{_MICROS.format(f'{_EPOCH} + a')} DIV {_MICROS.format(f'{_EPOCH} + b')}",
    "betwixt_text(x STRING, low STRING, high STRING) RETURNS BOOLEAN": "x BETWEEN low AND high",
    "betwixt_date(x DATE, low DATE, high DATE) RETURNS BOOLEAN": "x BETWEEN low AND high",
    "betwixt_time(x TIMESTAMP_NTZ, low TIMESTAMP_NTZ, high TIMESTAMP_NTZ) RETURNS BOOLEAN": "x BETWEEN low AND high",
    "strict_and(a BOOLEAN, b BOOLEAN) RETURNS BOOLEAN": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a AND b END",
    "strict_or(a BOOLEAN, b BOOLEAN) RETURNS BOOLEAN": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a OR b END",
    "pack_chars(l STRING, r STRING) RETURNS INT": "shiftleft(ascii(l), 8) | ascii(r)",
    "pack_ints(l INT, r INT) RETURNS BIGINT": "shiftleft(CAST(l AS BIGINT), 32) | (CAST(r AS BIGINT) & 4294967295)",
    "day_number(d DATE) RETURNS INT": "datediff(d, DATE'2000-01-01')",
    "time_micros(ts TIMESTAMP_NTZ) RETURNS BIGINT": _MICROS.format("ts"),
    "time_bucket(width INTERVAL DAY TO SECOND, ts TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ": f"timestampadd(MICROSECOND, {_MICROS.format('ts')} - pmod({_MICROS.format('ts')}, {_WIDTH}), {_EPOCH})",
    "date_bucket(days INT, d DATE) RETURNS DATE": "date_add(DATE'2000-01-01', CAST(datediff(d, DATE'2000-01-01') - pmod(datediff(d, DATE'2000-01-01'), days) AS INT))",
    "month_bucket(months INT, d DATE) RETURNS DATE": "add_months(DATE'2000-01-01', CAST((year(d) - 2000) * 12 + month(d) - 1 - pmod((year(d) - 2000) * 12 + month(d) - 1, months) AS INT))",
}


def register(spark: SparkSession) -> None:
    """Defines the functions in the session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
