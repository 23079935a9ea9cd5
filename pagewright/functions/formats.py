"""Display formats: times, percentages, sizes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_time(ts: Column | str) -> Column:
    """``2024-01-01T00:00:07.179575``; whole seconds have no fraction."""
    ts = _col(ts)
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def one_decimal(value: Column | str) -> Column:
    """One decimal of the exact binary value, exact halves rounded up.

    Twenty times the value is an odd number at a half; the error of that product,
    found by splitting the value in two short parts, tells a half from a number
    just below it.
    """
    x = _col(value).cast("double")
    twenty = x * 20
    wide = x * 134217729.0
    high = wide - (wide - x)
    error = (high * 20 - twenty) + (x - high) * 20
    below = (F.pmod(twenty, F.lit(2.0)) == 1) & (error < 0)
    tenths = F.floor((twenty + 1) / 2) - below.cast("int")
    return F.format_string("%.1f", tenths / 10)


def score_percent(score: Column | str) -> Column:
    return F.concat(one_decimal(_col(score) * 100), F.lit("%"))


def milliseconds(value: Column | str) -> Column:
    return F.concat(one_decimal(value), F.lit("ms"))


def size_mb(size_bytes: Column | str) -> Column:
    """``<n> MB`` with up to two decimals and at least one."""
    return F.concat(F.round(_col(size_bytes) / 1048576, 2).cast("string"), F.lit(" MB"))


def query_label(query: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(query), F.lit("")), F.lit("(empty query)"))
