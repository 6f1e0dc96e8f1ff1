"""Selections over the activity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.plans import ordered


def find_by(df: DataFrame, column: str, value, *, order: Sequence[Column] = ()) -> DataFrame:
    """Rows with ``column = value``; the equality reaches the parquet scan."""
    found = df.where(F.col(column) == F.lit(value))
    return found.orderBy(*order) if order else found


def find_pending(recordings: DataFrame) -> DataFrame:
    """Recordings still to be processed."""
    return recordings.where(F.col("status").isin("raw", "processing"))


def filter_observations(
    obs: DataFrame,
    *,
    recording_id=None,
    types: Sequence[str] = (),
    activities: Sequence[str] = (),
    apps: Sequence[str] = (),
    search: str | None = None,
    start: float | None = None,
    end: float | None = None,
    source: str | None = None,
) -> DataFrame:
    """All given conditions must hold; activities are alternatives, every application must be present.

    ``source`` is ``recorder`` (a frame stands behind the row) or ``batch``.
    """
    if recording_id is not None:
        obs = obs.where(F.col("recording_id") == F.lit(recording_id))
    if types:
        obs = obs.where(F.col("type").isin(list(types)))
    if activities:
        obs = obs.where(F.col("activity_type").isin(list(activities)))
    for app in apps:
        obs = obs.where(F.array_contains("apps", app))
    if search:
        needle = search.lower()
        in_description = F.lower("vlm_description").contains(needle)
        obs = obs.where(
            F.coalesce(in_description, F.lit(False)) | F.coalesce(F.lower("text").contains(needle), F.lit(False))
        )
    if start is not None:
        obs = obs.where(F.col("timestamp") >= start)
    if end is not None:
        obs = obs.where(F.col("timestamp") <= end)
    if source == "recorder":
        obs = obs.where(F.col("frame_id").isNotNull())
    elif source == "batch":
        obs = obs.where(F.col("frame_id").isNull())
    return obs


def page_bounds(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    """Page size kept within 10..200 (50 when absent or zero) and a non-negative offset."""
    return min(max(limit or 50, 10), 200), max(offset or 0, 0)


def paginate(df: DataFrame, limit: int | None = None, offset: int | None = None, *, tie: str = "id") -> DataFrame:
    """One page, newest first; the plan is a top-k, never a full sort on one task."""
    size, skip = page_bounds(limit, offset)
    return df.orderBy(F.col("timestamp").desc(), F.col(tie).desc()).offset(skip).limit(size)


def blocks_overlapping(blocks: DataFrame, start: float, end: float) -> DataFrame:
    """Blocks sharing time with ``(start, end)``."""
    return blocks.where((F.col("from_ts") < end) & (F.col("to_ts") > start))


def blocks_within(blocks: DataFrame, start: float, end: float) -> DataFrame:
    return blocks.where((F.col("from_ts") >= start) & (F.col("to_ts") <= end))


def observations_between(obs: DataFrame, start: float, end: float) -> DataFrame:
    """Recorder rows with a time inside the closed range."""
    return obs.where(F.col("frame_id").isNotNull() & F.col("timestamp").between(start, end))


def substantial_blocks(blocks: DataFrame, min_observations: int = 5, min_seconds: float = 60.0) -> DataFrame:
    return blocks.where(
        (F.col("observation_count") >= min_observations)
        & (F.col("to_ts") - F.col("from_ts") >= min_seconds)
    )


def drop_personal(blocks: DataFrame, subjects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Leave out blocks whose first subject is personal; blocks without a subject stay.

    First means the smallest subject id.
    """
    first = (
        bridge.join(subjects.select(F.col("id").alias("subject_id"), "is_personal"), "subject_id")
        .groupBy(F.col("topic_block_id").alias("id"))
        .agg(F.min_by("is_personal", "subject_id").alias("_personal"))
    )
    return blocks.join(first.where("_personal").select("id"), "id", "left_anti")


def usable_visual(obs: DataFrame, *, resume: bool = False) -> DataFrame:
    """Visual rows with a description; ``resume`` also rejects the placeholders of failed answers."""
    text = F.col("vlm_description")
    rows = obs.where((F.col("type") == "visual") & (text != ""))
    if resume:
        rows = rows.where(~text.startswith("No description") & ~text.startswith("Parse error"))
    return rows


def observation_facets(obs: DataFrame) -> DataFrame:
    """Distinct activity types and application names as ``(facet, value)``."""
    activity = obs.where("activity_type is not null").select(
        F.lit("activity").alias("facet"), F.col("activity_type").alias("value")
    )
    app = obs.select(F.lit("app").alias("facet"), F.explode("apps").alias("value"))
    return activity.distinct().unionByName(app.distinct())


def latest_n(df: DataFrame, order: str, n: int = 50, *, tie: str = "id") -> DataFrame:
    """The ``n`` newest rows, as a top-k."""
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def sub_batches(obs: DataFrame, keys: Sequence[str] = (), size: int = 100) -> DataFrame:
    """Number consecutive groups of ``size`` rows in time order."""
    numbered = ordered.row_index(obs, keys, ["timestamp", "id"], "_row")
    return numbered.withColumn("batch_no", F.floor(F.col("_row") / size).cast("long")).drop("_row")


def activity_since(obs: DataFrame, since: float) -> DataFrame:
    """Observations, time span and activity counts from ``since`` on."""
    from dayweave.functions.text import canonical_activity

    recent = obs.where(F.col("timestamp") >= since)
    return recent.groupBy(canonical_activity(F.col("activity_type")).alias("activity")).agg(
        F.count("*").alias("observations"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def since_seconds(text: str, now: float) -> float:
    """Epoch seconds a digest starts at: ``today`` (UTC) or an interval such as ``90m``, ``12h``, ``1d``, ``2w``."""
    if text == "today":
        return now - now % 86400
    unit = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}.get(text[-1:])
    if unit is None or not text[:-1].isdigit():
        raise ValueError(f"neither today nor an interval: {text}")
    return now - int(text[:-1]) * unit


def digest_since(obs: DataFrame, blocks: DataFrame, since: float) -> DataFrame:
    """Counts from ``since`` on as ``(kind, name, n)``: observations by activity and by application, and blocks."""
    from dayweave.functions.text import canonical_activity

    recent = obs.where(F.col("timestamp") >= since)
    activities = recent.select(F.lit("activity").alias("kind"), canonical_activity(F.col("activity_type")).alias("name"))
    apps = recent.select(F.lit("app").alias("kind"), F.explode(F.array_distinct("apps")).alias("name"))
    whole = blocks.where(F.col("to_ts") >= since).select(F.lit("blocks").alias("kind"), F.lit("all").alias("name"))
    return activities.unionByName(apps).unionByName(whole).groupBy("kind", "name").agg(F.count("*").alias("n"))
