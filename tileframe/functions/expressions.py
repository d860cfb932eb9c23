"""Column expressions: predicates, NULL handling, key packing, date and interval
arithmetic, time and date buckets.

Everything returns a Column of built-in functions, so it stays in generated code.
Day numbers count days, and microsecond numbers microseconds, from 2000-01-01.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_DATE = "2000-01-01"
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Predicates and NULLs


def betwixt(x, low, high) -> Column:
    """``low <= x <= high``."""
    return _col(x).between(_value(low), _value(high))


def ifnull(x, other) -> Column:
    """``x``, or ``other`` (a column or a constant) where it is NULL."""
    return F.coalesce(_col(x), _value(other))


def is_null(x) -> Column:
    return _col(x).isNull()


def is_not_null(x) -> Column:
    return _col(x).isNotNull()


def strict_and(a: Column, b: Column) -> Column:
    """AND that is NULL if either side is (standard AND is false for FALSE AND NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def strict_or(a: Column, b: Column) -> Column:
    """OR that is NULL if either side is (standard OR is true for TRUE OR NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


# Arithmetic


def int_div(a, b) -> Column:
    """Division of whole numbers that truncates toward zero."""
    return F.call_function("div", _col(a), _value(b))


def as_real(x) -> Column:
    """Rounds an intermediate to single precision, as arithmetic on REAL columns does."""
    return _col(x).cast("float")


def pack_chars(left, right) -> Column:
    """Two one-byte characters as one number."""
    return F.shiftleft(F.ascii(_col(left)), 8).bitwiseOR(F.ascii(_col(right)))


def pack_shorts(left, right) -> Column:
    """Two 16-bit numbers as one 32-bit number, operands taken unsigned."""
    low = _col(right).cast("int").bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(_col(left).cast("int"), 16).bitwiseOR(low)


def pack_ints(left, right) -> Column:
    """Two 32-bit numbers as one 64-bit number, operands taken unsigned."""
    low = _col(right).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(_col(left).cast("long"), 32).bitwiseOR(low)


def concat_text(*columns) -> Column:
    return F.concat(*[_col(c) for c in columns])


# Dates, timestamps, intervals


def day_number(d) -> Column:
    return F.datediff(_col(d), F.lit(EPOCH_DATE).cast("date"))


def from_day_number(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH_DATE).cast("date"), n.cast("int"))


def _origin() -> Column:
    return F.lit(f"{EPOCH_DATE} 00:00:00").cast("timestamp_ntz")


def micros(ts) -> Column:
    """Microseconds from the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", _origin(), _col(ts))


def from_micros(n: Column) -> Column:
    return F.timestamp_add("MICROSECOND", n, _origin())


def interval_micros(i) -> Column:
    """Microseconds of a day-time interval (months are not accepted)."""
    return F.timestamp_diff("MICROSECOND", _origin(), _origin() + _col(i))


def date_interval(a, b) -> Column:
    """``a - b`` of two dates as a day-time interval."""
    return F.make_dt_interval(F.datediff(_col(a), _col(b)))


def time_ratio(ts, n) -> Column:
    """Microseconds from the epoch of a timestamp, divided by a whole number, truncated."""
    return int_div(micros(ts), n)


def micros_interval(n: Column) -> Column:
    """Day-time interval of so many microseconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def interval_ratio(a, b) -> Column:
    """How often interval ``b`` fits into ``a``, truncated."""
    return int_div(interval_micros(a), interval_micros(b))


def interval_rest(a, b) -> Column:
    """Microseconds that remain of ``a`` after whole ``b``."""
    return interval_micros(a) % interval_micros(b)


# Buckets


def parse_width(width: str) -> tuple[int, int]:
    """(months, microseconds) of a width such as '2 minutes' or '1 day 12 hours'.

    Raises ValueError for unknown units, widths that are not positive, and widths
    that have both a month part and a day or time part.
    """
    parts = re.findall(r"([+-]?\d+)\s*([A-Za-z]+)", width)
    if not parts or re.sub(r"[+-]?\d+\s*[A-Za-z]+", "", width).strip():
        raise ValueError(f"not an interval: {width!r}")
    months = time = 0
    for n, unit in parts:
        unit = unit.lower().removesuffix("s")
        if unit in MICROS:
            time += int(n) * MICROS[unit]
        elif unit in MONTHS:
            months += int(n) * MONTHS[unit]
        else:
            raise ValueError(f"unknown unit {unit!r} in {width!r}")
    if months and time:
        raise ValueError("a bucket has either months or days and time, not both")
    if months < 0 or time < 0 or months + time == 0:
        raise ValueError("a bucket's width must be positive")
    return months, time


def _down(n: Column, width: int, legacy: bool) -> Column:
    """Start of the bucket: floor, or toward zero with ``legacy``."""
    return n - n % F.lit(width) if legacy else n - F.pmod(n, F.lit(width))


def _month_start(d, months: int, legacy: bool) -> Column:
    number = (F.year(_col(d)) - 2000) * 12 + F.month(_col(d)) - 1
    return F.add_months(F.lit(EPOCH_DATE).cast("date"), _down(number, months, legacy).cast("int"))


def time_bucket(width: str, ts, legacy: bool = False) -> Column:
    """Start of the bucket of ``width`` that holds ``ts``; buckets are counted from
    2000-01-01. Earlier times go to the bucket below, or with ``legacy`` toward the
    epoch."""
    months, time = parse_width(width)
    if months:
        return _month_start(ts, months, legacy).cast("timestamp_ntz")
    return from_micros(_down(micros(ts), time, legacy))


def date_bucket(width: str, d, legacy: bool = False) -> Column:
    """As ``time_bucket`` for dates; the width is whole days or months."""
    months, time = parse_width(width)
    if months:
        return _month_start(d, months, legacy)
    if time % MICROS["day"]:
        raise ValueError("a date bucket is a whole number of days or months")
    return from_day_number(_down(day_number(d), time // MICROS["day"], legacy))
