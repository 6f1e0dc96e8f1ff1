"""Subjects, contexts, classification scores, clusters and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions import vocab
from dayweave.functions.numbers import half_up
from dayweave.functions.text import capitalise, media_indicators, personal_share_flag
from dayweave.plans import ordered

KEY = ["recording_id", "subject_id"]


def _activity_or_other(column: str = "activity_type") -> Column:
    return F.when(F.col(column) != "", F.col(column)).otherwise(F.lit("other"))


def subject_rows(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of every subject; ``members`` is ``(recording_id, subject_id, label, block_id)``."""
    parts = blocks.select("recording_id", F.col("id").alias("block_id"), "duration", _activity_or_other().alias("activity"), "apps")
    return members.select("recording_id", "subject_id", "label", "block_id").join(parts, ["recording_id", "block_id"])


def build_subjects(members: DataFrame, blocks: DataFrame, *, personal: Column | None = None) -> DataFrame:
    """Total length, seconds per activity, applications and personal flag of every subject.

    Lengths are summed per activity before they meet per subject, so a subject with very many blocks
    moves one row per activity.
    """
    rows = subject_rows(members, blocks)
    parts = rows.groupBy(*KEY, "label", "activity").agg(
        F.sum("duration").alias("seconds"),
        F.count("*").alias("blocks"),
        F.array_distinct(F.flatten(F.collect_set("apps"))).alias("apps"),
    )
    subjects = parts.groupBy(*KEY, "label").agg(
        F.sum("seconds").alias("duration"),
        F.sum("blocks").alias("blocks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("activity", "seconds")))).alias("activity_breakdown"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("apps")))).alias("apps"),
    )
    return subjects.withColumn("is_personal", personal_share_flag(F.col("apps")) if personal is None else personal)


def grouped_members(groups: DataFrame) -> DataFrame:
    """Parsed group lines as subject members; subjects are named by recording and group number."""
    lines = groups.select("recording_id", "line_no").distinct()
    numbered = ordered.row_index(lines.withColumn("_at", F.col("line_no").cast("double")), ["recording_id"], ["_at", "line_no"], "_n")
    named = numbered.select("recording_id", "line_no", F.concat_ws("-", F.lit("subject"), "recording_id", "_n").alias("subject_id"))
    return groups.join(named, ["recording_id", "line_no"]).select("recording_id", "subject_id", "label", "block_id")


def fallback_members(blocks: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Consecutive personal or work blocks as subjects, for recordings without a usable answer.

    A block is personal when any of its applications is a personal one. One without a start counts from 0.
    """
    personal = F.exists("apps", lambda a: a.isin(vocab.PERSONAL_APPS))
    rows = blocks.select("recording_id", "id", F.coalesce("from_ts", F.lit(0)).alias("from_ts"), F.coalesce(personal, F.lit(False)).alias("is_personal"))
    marked = ordered.islands(
        rows, ["recording_id"], ["from_ts", "id"], lambda a, b: a["is_personal"] != b["is_personal"], ["is_personal"], alias="first", width=width
    )
    heads = marked.where("first_id = id").select("recording_id", "first_ts", "first_id")
    numbered = ordered.row_index(heads, ["recording_id"], ["first_ts", "first_id"], "_n", width=width)
    named = numbered.select("recording_id", "first_id", F.concat_ws("-", F.lit("subject"), "recording_id", "_n").alias("subject_id"))
    label = F.when(F.col("is_personal"), F.lit("Personal")).otherwise(F.lit("Work Session"))
    return marked.join(named, ["recording_id", "first_id"]).select(
        "recording_id", "subject_id", label.alias("label"), F.col("id").alias("block_id")
    )


def fallback_subjects(blocks: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Subjects without a model answer."""
    return build_subjects(fallback_members(blocks, width=width), blocks, personal=F.col("label") == "Personal")


def personal_work_split(subjects: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    seconds, personal = F.col("duration"), F.col("is_personal")
    return subjects.groupBy(*keys).agg(
        F.sum(F.when(personal, seconds).otherwise(0.0)).alias("personal_seconds"),
        F.sum(F.when(~personal, seconds).otherwise(0.0)).alias("work_seconds"),
    )


def context_names(segments: DataFrame) -> DataFrame:
    """Applications and topics of segments as ``(segment, type, name)`` rows."""
    app = segments.select("recording_id", "id", F.lit("app").alias("type"), F.explode("apps").alias("name"))
    topic = segments.select("recording_id", "id", F.lit("topic").alias("type"), F.explode("topics").alias("name"))
    return app.unionByName(topic)


def upsert_contexts(segments: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing contexts and one new row per unseen type and name; the id is a hash of both."""
    seen = context_names(segments).select("type", "name").distinct()
    fresh = seen.join(existing.select("type", "name"), ["type", "name"], "left_anti")
    return existing.select("id", "type", "name").unionByName(fresh.select(F.xxhash64("type", "name").alias("id"), "type", "name"))


def segment_contexts(segments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context ids of every segment, one row per link."""
    return context_names(segments).join(contexts.select(F.col("id").alias("context_id"), "type", "name"), ["type", "name"]).select(
        "recording_id", F.col("id").alias("segment_id"), "context_id"
    )


def topic_blocks(segments: DataFrame, alignment: DataFrame) -> DataFrame:
    """Segments as block rows with a nested classification; transcript lines stay in their own table."""
    counts = alignment.select("recording_id", F.col("segment_id").alias("id"), "transcripts")
    rows = segments.join(counts, ["recording_id", "id"], "left").na.fill(0, ["transcripts"])
    classification = F.struct(
        F.col("activity").alias("activity_type"), "key_description", "start_time", "end_time", "duration", "apps", "topics",
        F.col("transcripts").alias("transcript_count"), (F.col("transcripts") > 0).alias("has_transcript"),
    )
    return rows.select(
        "recording_id", "id", F.col("start_time").alias("from_ts"), F.col("end_time").alias("to_ts"), "duration", classification.alias("classification")
    )


def alignment_stats(counts: DataFrame) -> DataFrame:
    """Totals over segments with their transcript counts; mean is zero without segments."""
    return counts.agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("transcripts") > 0).alias("with_audio"),
        F.coalesce(F.sum("transcripts"), F.lit(0)).alias("transcripts"),
        F.coalesce(F.sum("mic"), F.lit(0)).alias("mic"),
        F.coalesce(F.sum("system"), F.lit(0)).alias("system"),
        F.coalesce(F.avg("transcripts"), F.lit(0.0)).alias("avg_per_segment"),
    )


def aggregate_classification(rows: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Weighted mean of every score, rounded; zero without weight."""
    mean = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))
    return rows.groupBy(*keys).agg(*[F.coalesce(half_up(mean(c)), F.lit(0)).alias(c) for c in vocab.SCORES])


def _score_entries() -> Column:
    return F.array(*[F.struct((-F.col(c)).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("type")) for i, c in enumerate(vocab.SCORES)])


def primary_type(threshold: float = 25) -> Column:
    """Highest score, the first declared one on a tie; null below the threshold."""
    top = F.get(F.array_sort(_score_entries()), 0)
    return F.when(-top["n"] >= threshold, top["type"])


def has_type(name: str, threshold: float = 50) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) >= threshold


def significant_types(threshold: float = 25, *, by_score: bool = False) -> Column:
    """Types at or above the threshold, in declared order or highest first."""
    entries = F.array_sort(_score_entries()) if by_score else _score_entries()
    return F.transform(F.filter(entries, lambda e: -e["n"] >= threshold), lambda e: e["type"])


def activity_counts(blocks: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    return blocks.where(F.col("activity_type") != "").groupBy(*keys, "activity_type").agg(
        F.count("*").alias("n"), F.min("from_ts").alias("first_ts")
    )


def top_activities(blocks: DataFrame, n: int | None = 3, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Capitalised activities by frequency, the one seen first on a tie."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_ts", "activity_type")))
    names = F.transform(entries, lambda e: capitalise(e["activity_type"]))
    return activity_counts(blocks, keys).groupBy(*keys).agg((names if n is None else F.slice(names, 1, n)).alias("activities"))


def cluster_metadata(frames: DataFrame, keys: Sequence[str] = ("recording_id", "cluster_id")) -> DataFrame:
    """Representative (middle) frame, size, time range, mean text length and media tags of every cluster."""
    keys = list(keys)
    placed = ordered.row_index(frames, keys, ["timestamp", "id"], "_n")
    sizes = frames.groupBy(*keys).agg(F.count("*").alias("frame_count"))
    middle = F.col("_n") == F.floor(F.col("frame_count") / 2)
    text = F.coalesce("ocr_text", F.lit(""))
    return placed.join(sizes, keys).groupBy(*keys, "frame_count").agg(
        F.max(F.when(middle, F.col("id"))).alias("representative_id"),
        F.min("timestamp").alias("from_ts"),
        F.max("timestamp").alias("to_ts"),
        F.avg(F.length(text)).alias("avg_ocr_characters"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(media_indicators(text))))).alias("media_indicators"),
    )


def entity_rollup(entities: DataFrame, kind: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Observations and mean confidence per entity."""
    rows = entities.where(F.col("confidence") >= min_confidence)
    if kind is not None:
        rows = rows.where(F.col("entity_kind") == kind)
    return rows.groupBy("entity_kind", "entity_value").agg(
        F.count("*").alias("mentions"), F.count_distinct("observation_id").alias("observations"), F.avg("confidence").alias("avg_confidence")
    )


def group_rollup(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Seconds and the three most frequent activities (by observations) of every group."""
    rows = members.select("group_id", F.col("block_id").alias("id")).join(blocks, "id")
    parts = rows.groupBy("group_id", _activity_or_other().alias("activity")).agg(
        F.sum("duration").alias("seconds"), F.sum("observation_count").alias("n"), F.count("*").alias("blocks")
    )
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "activity"))), 1, 3)
    return parts.groupBy("group_id").agg(
        F.sum("blocks").alias("blocks"),
        F.sum("seconds").alias("seconds"),
        F.array_join(F.transform(top, lambda e: F.concat(e["activity"], F.lit("("), -e["n"], F.lit(")"))), ", ").alias("activities"),
    )


def unassigned_blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    return blocks.join(members.select(F.col("block_id").alias("id")), "id", "left_anti")


def recording_frame_counts(recordings: DataFrame, obs: DataFrame) -> DataFrame:
    """Processed recordings with their number of visual rows that have an image."""
    shots = obs.where("type = 'visual' and image_path is not null").groupBy(F.col("recording_id").alias("id")).agg(F.count("*").alias("frames"))
    return recordings.where("status = 'processed'").join(shots, "id", "left").na.fill(0, ["frames"])
