"""Time columns of a transaction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970; sub-seconds are cut off."""
    return F.unix_timestamp(ts.cast("timestamp"))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def night_activity(ts: Column) -> Column:
    """1 before 06:00 and from 23:00 on."""
    return F.when((F.hour(ts) < 6) | (F.hour(ts) > 22), 1).otherwise(0)


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7).cast("int")


def time_seconds(ts: Column) -> Column:
    return epoch_seconds(ts)


def cyclic_hour(ts: Column) -> tuple[Column, Column]:
    """(sin, cos) of the hour on a 24-hour circle."""
    angle = F.hour(ts) * F.lit(2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def iso_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
