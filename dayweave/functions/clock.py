"""Time spans and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayweave.functions.numbers import half_up


def whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """True when the spans share more than a point."""
    return (s1 < e2) & (s2 < e1)


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.when(overlaps(s1, e1, s2, e2), F.least(e1, e2) - F.greatest(s1, s2)).otherwise(F.lit(0.0))


def span_contains(start: Column, end: Column, at: Column) -> Column:
    """Both ends belong to the span."""
    return (at >= start) & (at <= end)


def make_span(start: Column, end: Column) -> Column:
    """Struct of start and end; negative or reversed bounds are an error."""
    bad = (start < 0) | (end < start)
    span = F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))
    return F.when(bad, F.raise_error(F.lit("invalid time range")).cast("struct<start:double,end:double>")).otherwise(span)


def minutes_seconds(seconds: Column) -> Column:
    """``m:ss``."""
    return F.format_string("%d:%02d", whole(seconds / 60), whole(seconds % 60))


def padded_minutes_seconds(seconds: Column) -> Column:
    """``mm:ss``."""
    return F.format_string("%02d:%02d", whole(seconds / 60), whole(seconds % 60))


def span_text(start: Column, end: Column) -> Column:
    return F.concat(minutes_seconds(start), F.lit(" → "), minutes_seconds(end))


def duration_floor(seconds: Column) -> Column:
    """``1h 5m``, ``5m`` or ``42s``, cut down to the shown unit."""
    hours, minutes = whole(seconds / 3600), whole((seconds % 3600) / 60)
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm", minutes))
        .otherwise(F.format_string("%ds", whole(seconds)))
    )


def duration_rounded(seconds: Column) -> Column:
    """``5m``, ``2h`` or ``2h 5m``, rounded to minutes."""
    minutes = half_up(seconds / 60)
    hours, rest = whole(minutes / 60), minutes % 60
    return (
        F.when(minutes < 60, F.format_string("%dm", minutes))
        .when(rest == 0, F.format_string("%dh", hours))
        .otherwise(F.format_string("%dh %dm", hours, rest))
    )


def duration_exact(seconds: Column) -> Column:
    """``1h 5m``, ``5m 3s`` or ``42s``."""
    hours, minutes, rest = whole(seconds / 3600), whole((seconds % 3600) / 60), whole(seconds % 60)
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def timestamp_text_seconds(text: Column) -> Column:
    """``hh:mm:ss.mmm`` to seconds."""
    part = F.split(text, r"[:.]")
    number = lambda i: F.element_at(part, i).cast("double")
    return number(1) * 3600 + number(2) * 60 + number(3) + number(4) / 1000
