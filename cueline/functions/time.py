"""Time texts from seconds. Rounding is half to even on the millisecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("long")


def srt_time_of_millis(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours may pass 99."""
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000]
    return F.format_string("%02d:%02d:%02d,%03d", *[p.cast("long") for p in parts])


def srt_time(seconds: Column) -> Column:
    return srt_time_of_millis(millis(seconds))


def compact_time(seconds: Column) -> Column:
    """HH:MM:SS.cc, the last digit of the milliseconds cut off."""
    t = F.replace(srt_time(seconds), F.lit(","), F.lit("."))
    return F.left(t, F.length(t) - 1)


def clock_time(seconds: Column) -> Column:
    t = srt_time(seconds)
    return F.left(t, F.length(t) - 4)


def duration_text(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3s of the whole seconds, 0s at least."""
    s = F.greatest(F.lit(0).cast("long"), F.rint(seconds).cast("long"))
    h, m, r = (F.floor(s / 3600)).cast("long"), (F.floor(s / 60) % 60).cast("long"), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def mark_to_seconds(value: Column, unit: str = "auto") -> Column:
    """Recogniser time marks: null is 0; with ``auto`` a mark beyond 100 is in milliseconds, else already in seconds."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    if unit == "ms":
        return value / 1000
    return value if unit == "s" else F.when(F.abs(value) > 100, value / 1000).otherwise(value)
