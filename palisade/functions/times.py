"""Timestamp helpers; every value is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def time_floor(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval of ``seconds`` that holds ``ts``."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    over = F.pmod(F.timestamp_diff("MICROSECOND", epoch, ts), F.lit(seconds * 1_000_000))
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (over / 1e6).cast("decimal(18,6)"))


def epoch_date(seconds: Column) -> Column:
    """Date of an epoch-second value, null when it is not a number."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds.try_cast("double") / 86400).cast("int"))


def colon_date(text: Column) -> Column:
    """Date written with colons instead of hyphens, null when it does not parse."""
    return F.translate(text, ":", "-").try_cast("date")


def date_year(date: Column) -> Column:
    return F.year(date)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def display_timestamp(text: Column) -> Column:
    """ISO text for people: blank instead of T, ' UTC' instead of Z."""
    return F.replace(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(" UTC"))
