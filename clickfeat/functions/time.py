"""Calendar fields of an epoch-seconds column.

The reference formats epoch seconds in the *machine-local* zone.  Here the
zone is an argument (default UTC) and every field is computed from a
``timestamp_ntz`` wall clock, so results never depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def local_wall_clock(epoch, zone: str = "UTC") -> Column:
    """Epoch seconds -> ``timestamp_ntz`` wall-clock time in ``zone``."""
    utc = F.timestamp_add("SECOND", _c(epoch), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if zone.upper() in ("UTC", "Z", "ETC/UTC", "GMT"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def epoch_seconds(ts) -> Column:
    """Whole epoch seconds of a ``timestamp_ntz`` (or string) column, zone-free."""
    return F.unix_timestamp(_c(ts)).cast("bigint")


def time_columns(epoch="context_timestamp", zone: str = "UTC") -> list[Column]:
    """``time, is_week, day, hour, minute, half_hour`` for one select.

    ``half_hour`` is the slot ``hour*2 + (minute >= 30)`` (0..47): the same
    partition of the day as the reference's "hour + 0/1" string, so every
    grouping on it is identical; ``first_seen_codes`` turns it into
    first-appearance codes when those are wanted.
    """
    w = local_wall_clock(epoch, zone)
    hour = F.hour(w)
    minute = F.minute(w)
    return [
        F.date_format(w, "yyyy-MM-dd HH:mm:ss").alias("time"),
        (F.weekday(w) >= 5).cast("int").alias("is_week"),
        F.dayofmonth(w).alias("day"),
        hour.alias("hour"),
        minute.alias("minute"),
        (hour * 2 + (minute >= 30).cast("int")).alias("half_hour"),
    ]
