"""Timestamps, ISO weeks, ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_at(stamp: Column) -> Column:
    """ISO text or epoch text to a UTC timestamp; null when unreadable."""
    text = F.trim(stamp.cast("string"))
    number = F.expr("try_cast(NULL AS DOUBLE)")
    number = F.when(text.rlike(r"^\d{9,16}(\.\d+)?$"), text.cast("double"))
    seconds = F.when(number > 1e14, number / 1e6).when(number > 1e11, number / 1e3).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(text))


def week_of(at: Column) -> Column:
    """ISO week label such as 2026-W05."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def parse_date(value: Column) -> Column:
    """The first ten characters as a date; null when they are not one."""
    head = F.substring(value.cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def seconds(at: Column) -> Column:
    return F.unix_micros(at) / F.lit(1_000_000)
