"""Joins between observations, frames, blocks, subjects, transcripts and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.functions.clock import overlap_seconds
from dayweave.functions.text import trim_blank
from dayweave.plans.ordered import row_index
from dayweave.plans.ranges import ancestors, binned_pairs, cover, top_level
from dayweave.session import ensure_checkpoint_dir


def align_transcripts(
    segments: DataFrame, audio: DataFrame, *, min_overlap: float = 1.0, default_len: float = 5.0
) -> DataFrame:
    """One row per segment and transcript that overlap by at least ``min_overlap`` seconds.

    A transcript without an end lasts ``default_len`` seconds; blank texts are left out; a transcript
    may belong to several segments. Segments without a transcript are found by an anti join (see
    :func:`alignment_counts`). A minimum of zero still asks for a real overlap.
    """
    speech = audio.where((F.col("type") == "audio") & (F.length(trim_blank(F.col("text"))) > 0)).select(
        "recording_id",
        F.col("id").alias("transcript_id"),
        F.col("audio_source").alias("source"),
        "text",
        F.col("timestamp").alias("transcript_start"),
        F.coalesce("end_timestamp", F.col("timestamp") + default_len).alias("transcript_end"),
    )
    spans = segments.select("recording_id", F.col("id").alias("segment_id"), "start_time", "end_time")
    shared = overlap_seconds(
        F.col("start_time"), F.col("end_time"), F.col("transcript_start"), F.col("transcript_end")
    )
    touching = (F.col("start_time") < F.col("transcript_end")) & (F.col("transcript_start") < F.col("end_time"))
    return binned_pairs(
        spans,
        speech,
        ["recording_id"],
        ("start_time", "end_time"),
        ("transcript_start", "transcript_end"),
        touching & (shared >= min_overlap),
    )


def transcript_lines(pairs: DataFrame) -> DataFrame:
    """``[MIC] text`` / ``[SYSTEM] text`` lines of every segment, to be read by start time and id."""
    return pairs.select(
        "recording_id",
        "segment_id",
        "transcript_start",
        "transcript_id",
        F.concat(F.lit("["), F.upper("source"), F.lit("] "), F.col("text")).alias("line"),
    )


def alignment_counts(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every segment with its number of microphone and system transcripts."""
    counts = pairs.groupBy("recording_id", "segment_id").agg(
        F.count("*").alias("transcripts"),
        F.count_if(F.col("source") == "mic").alias("mic"),
        F.count_if(F.col("source") == "system").alias("system"),
    )
    return (
        segments.select("recording_id", F.col("id").alias("segment_id"))
        .join(counts, ["recording_id", "segment_id"], "left")
        .na.fill(0, ["transcripts", "mic", "system"])
    )


def frame_to_block(frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """The earliest-created block whose closed range holds the frame.

    A missing or zero start counts as zero, a missing or zero end as open; both ends are cut to the
    frames of the recording so that open ranges still fall into few bins.
    """
    last = frames.groupBy("recording_id").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    spans = blocks.join(last, "recording_id").select(
        "recording_id",
        F.col("id").alias("block_id"),
        "created_at",
        F.greatest(F.coalesce("from_ts", F.lit(0.0)), F.col("_first")).alias("_from"),
        F.when(F.col("to_ts") != 0, F.least("to_ts", "_last")).otherwise(F.col("_last")).alias("_to"),
    )
    points = frames.select("recording_id", F.col("id").alias("frame_id"), "timestamp")
    hits = binned_pairs(
        points,
        spans,
        ["recording_id"],
        ("timestamp", "timestamp"),
        ("_from", "_to"),
        F.col("timestamp").between(F.col("_from"), F.col("_to")),
        width=900.0,
    )
    return hits.groupBy("recording_id", "frame_id", "timestamp").agg(
        F.min_by("block_id", F.struct("created_at", "block_id")).alias("block_id")
    )


def frames_by_subject(frames: DataFrame, blocks: DataFrame, bridge: DataFrame) -> DataFrame:
    """Frames whose block belongs to the subject."""
    links = bridge.select("subject_id", F.col("topic_block_id").alias("block_id"))
    return frame_to_block(frames, blocks).join(links, "block_id")


def contained_blocks(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("recording_id",), *, width: float = 900.0) -> DataFrame:
    """Pairs where the inner block lies completely inside the outer one, ends included."""
    a = inner.select(*keys, F.col("id").alias("inner_id"), F.col("from_ts").alias("inner_from"), F.col("to_ts").alias("inner_to"))
    b = outer.select(*keys, F.col("id").alias("outer_id"), F.col("from_ts").alias("outer_from"), F.col("to_ts").alias("outer_to"))
    inside = (F.col("inner_from") >= F.col("outer_from")) & (F.col("inner_to") <= F.col("outer_to"))
    # An inner block only has to be found through the bin of its start.
    return binned_pairs(a, b, keys, ("inner_from", "inner_from"), ("outer_from", "outer_to"), inside, width=width)


def orphan_blocks(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("recording_id",), *, width: float = 900.0) -> DataFrame:
    """Inner blocks that no outer block contains."""
    homes = contained_blocks(inner, outer, keys, width=width).select(*keys, F.col("inner_id").alias("id"))
    return inner.join(homes, [*keys, "id"], "left_anti")


def run_for_artifact(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest completed run that was active when the artifact was written; null without one.

    Starts, artifacts and ends of a recording are numbered on one line; a run is then a range of numbers, cut
    into nodes of a binary tree. A node keeps only its latest run, and an artifact asks the nodes above its
    number, so artifacts never meet all runs of a recording. A run without an end is active to the end.
    """
    done = runs.where((F.col("status") == "completed") & F.col("started_at").isNotNull())
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    run, art = F.col("id").alias("run_id"), none(artifacts, "id").alias("art_id")
    begun = done.select("recording_id", F.col("started_at").cast("double").alias("ts"), F.lit(0).alias("kind"), run, art, "started_at")
    ended = done.where("completed_at is not null").select("recording_id", F.col("completed_at").cast("double").alias("ts"), F.lit(2).alias("kind"), run, art, "started_at")
    written = artifacts.where("created_at is not null").select("recording_id", F.col("created_at").cast("double").alias("ts"), F.lit(1).alias("kind"), none(runs, "id").alias("run_id"), F.col("id").alias("art_id"), none(runs, "started_at").alias("started_at"))
    # Rows of one time and kind may be numbered either way: what lies between two kinds stays between them.
    ensure_checkpoint_dir(artifacts.sparkSession)
    line = row_index(begun.unionByName(ended).unionByName(written), ["recording_id"], ["ts", "kind"], "pos").checkpoint()
    spans = line.where("kind <> 1").groupBy("recording_id", "run_id", "started_at").agg(F.min(F.when(F.col("kind") == 0, F.col("pos"))).alias("low"), F.max(F.when(F.col("kind") == 2, F.col("pos"))).alias("high"))
    sizes = line.groupBy("recording_id").agg(F.count("*").alias("_size"))
    spans = spans.join(sizes, "recording_id").withColumn("_at", F.explode(cover(F.col("low"), F.coalesce("high", "_size"))))
    node = ["recording_id", "_level", "_node"]
    nodes = spans.groupBy("recording_id", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")).agg(F.max(F.struct("started_at", "run_id")).alias("_latest"))
    asked = line.where("kind = 1").join(sizes, "recording_id").select("recording_id", "art_id", F.explode(ancestors(F.col("pos"), top_level(F.col("_size") + 1))).alias("_at"))
    asked = asked.select("recording_id", "art_id", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node"))
    latest = asked.join(nodes, node).groupBy(F.col("art_id").alias("id")).agg(F.max("_latest").alias("_latest")).select("id", F.col("_latest.run_id").alias("run_id"))
    return artifacts.join(latest, "id", "left")


def observations_by_context(obs: DataFrame, links: DataFrame, contexts: DataFrame) -> DataFrame:
    """Observations with the contexts linked to them."""
    linked = links.select(F.col("observation_id").alias("id"), "context_id", "confidence")
    names = contexts.select(F.col("id").alias("context_id"), F.col("type").alias("context_type"), F.col("name").alias("context_name"))
    return obs.join(linked, "id").join(names, "context_id")


def blocks_by_subject(blocks: DataFrame, bridge: DataFrame) -> DataFrame:
    return bridge.select("subject_id", F.col("topic_block_id").alias("id")).join(blocks, "id")


def rows_by_member(df: DataFrame, array_column: str, alias: str) -> DataFrame:
    """One row per id in an id array: exact membership for blocks by context or artifacts by block."""
    return df.withColumn(alias, F.explode(F.array_distinct(array_column)))


def effective_ts(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """Capture time of the frame behind the observation, else its own time."""
    shots = frames.select(F.col("id").alias("frame_id"), F.col("captured_ts"))
    return obs.join(shots, "frame_id", "left").withColumn("effective_ts", F.coalesce("captured_ts", "timestamp"))


def latest_completed_runs(runs: DataFrame) -> DataFrame:
    """Largest completed run id of every recording; ids sort by time."""
    return runs.where(F.col("status") == "completed").groupBy("recording_id").agg(F.max("id").alias("run_id"))


def in_latest_runs(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Phase rows of the latest completed run of every recording."""
    return stats.join(latest_completed_runs(runs).select("run_id"), "run_id", "left_semi")


def unprocessed_frames(frames: DataFrame, described: DataFrame) -> DataFrame:
    """Frames without a usable description at the same time of the same recording."""
    return frames.join(described.select("recording_id", "timestamp"), ["recording_id", "timestamp"], "left_anti")


def valid_members(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Group members ``(recording_id, block_id)`` that exist as blocks."""
    known = blocks.select("recording_id", F.col("id").alias("block_id"))
    return groups.join(known, ["recording_id", "block_id"], "left_semi")


def slice_transcript(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Transcript segments that share time with a range, one row per range and segment."""
    spans = ranges.select("recording_id", "range_id", "range_start", "range_end")
    cut = (F.col("start") < F.col("range_end")) & (F.col("end") > F.col("range_start"))
    return binned_pairs(segments, spans, ["recording_id"], ("start", "end"), ("range_start", "range_end"), cut)


def slice_stats(slices: DataFrame) -> DataFrame:
    """Segment count and duration per range and source: end of the last minus start of the first."""
    by = F.struct("start", "seg_id")
    return slices.groupBy("recording_id", "range_id", "source").agg(
        F.count("*").alias("segments"),
        F.greatest(F.max_by("end", by) - F.min("start"), F.lit(0.0)).alias("duration"),
    )


def latest_phase_rows(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """All rows of a phase that started last within the recording."""
    owned = stats.join(runs.select(F.col("id").alias("run_id"), "recording_id"), "run_id")
    good = owned.where((F.col("status") == "success") & (F.col("duration_ms") > 0))
    last = good.groupBy("recording_id", "phase").agg(F.max("started_at").alias("started_at"))
    return owned.where(F.col("status") == "success").join(last, ["recording_id", "phase", "started_at"])


def recordings_with_blocks(recordings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every recording with the number and total length of its blocks."""
    totals = blocks.groupBy(F.col("recording_id").alias("id")).agg(
        F.count("*").alias("blocks"), F.sum("duration").alias("block_seconds")
    )
    return recordings.join(totals, "id", "left").na.fill({"blocks": 0, "block_seconds": 0.0})


def interleave_transcripts(segments: DataFrame) -> DataFrame:
    """Segments of all sources as ``[mm:ss SOURCE] text`` lines, numbered by start time."""
    from dayweave.functions.clock import padded_minutes_seconds
    from dayweave.plans.ordered import row_index

    lines = row_index(segments, ["recording_id"], ["start", "seg_id"], "line_no")
    return lines.select(
        "recording_id",
        "line_no",
        F.concat(F.lit("seg-"), F.col("line_no")).alias("id"),
        "start",
        "end",
        F.concat(F.lit("["), padded_minutes_seconds(F.col("start")), F.lit(" "), F.upper("source"), F.lit("] "), F.col("text")).alias("text"),
    )
