"""Reports on processing runs and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayweave.functions.numbers import half_up, percent
from dayweave.operators.joins import in_latest_runs, latest_completed_runs, latest_phase_rows
from dayweave.session import ensure_checkpoint_dir

# Fixed value: the phase whose items are described frames.
MODEL_PHASE = "vlm-batch-inference"


def recording_counts(recordings: DataFrame) -> DataFrame:
    """Published recordings count as processed, raw and failed ones as pending."""
    status = F.col("status")
    return recordings.agg(
        F.count("*").alias("total"),
        F.count_if(status == "published").alias("processed"),
        F.count_if(status == "processing").alias("processing"),
        F.count_if(status.isin("raw", "error")).alias("pending"),
    )


def processing_totals(runs: DataFrame) -> DataFrame:
    """Total and mean time of the latest completed run of every recording."""
    latest = latest_completed_runs(runs).select(F.col("run_id").alias("id"))
    return runs.join(latest, "id", "left_semi").agg(
        half_up(F.coalesce(F.sum("total_duration_ms"), F.lit(0)) / 1000).alias("total_sec"),
        half_up(F.coalesce(F.avg("total_duration_ms"), F.lit(0.0)) / 1000).alias("avg_sec"),
        F.count("*").alias("runs"),
    )


def _model_rows(stats: DataFrame, runs: DataFrame, phase: str) -> DataFrame:
    return in_latest_runs(stats.where((F.col("phase") == phase) & (F.col("status") == "success")), runs)


def frames_processed(stats: DataFrame, runs: DataFrame, phase: str = MODEL_PHASE) -> DataFrame:
    rows = _model_rows(stats, runs, phase)
    total = F.coalesce(F.sum("items_processed"), F.lit(0))
    return rows.agg(
        total.alias("total_frames"),
        F.when(F.count("*") > 0, half_up(total / F.count("*"))).otherwise(F.lit(0)).alias("avg_per_recording"),
    )


def throughput(stats: DataFrame, runs: DataFrame, phase: str = MODEL_PHASE) -> DataFrame:
    """Items per second of the model phase; all three figures are per second."""
    rows = _model_rows(stats, runs, phase).where("duration_ms > 0 and items_processed > 0")
    rate = F.col("items_processed") / (F.col("duration_ms") / 1000.0)
    return rows.agg(
        F.round(F.avg(rate), 2).alias("avg_fps"),
        F.round(F.max(rate), 2).alias("max_fps"),
        F.round(F.min(rate), 2).alias("min_fps"),
    )


def phase_breakdown(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Time per phase in the latest runs and its share of the total."""
    rows = in_latest_runs(stats.where("status = 'success' and duration_ms > 0"), runs)
    phases = rows.groupBy("phase").agg(
        F.avg("duration_ms").alias("_avg"),
        F.sum("duration_ms").alias("_total"),
        F.count("*").alias("run_count"),
        F.avg("items_processed").alias("_items"),
    )
    # One row per phase name is left here, so the single-partition window is small.
    whole = F.sum("_total").over(Window.partitionBy(F.lit(0)))
    return phases.select(
        "phase",
        half_up(F.col("_avg") / 1000).alias("avg_duration_sec"),
        half_up(F.col("_total") / 1000).alias("total_duration_sec"),
        percent(F.col("_total"), whole).alias("pct_total"),
        "run_count",
        half_up(F.coalesce("_items", F.lit(0.0))).alias("avg_items"),
    )


RESOURCES = (
    "map<string, struct<peakMemoryMB double, avgMemoryMB double, peakCpuPercent double,"
    " avgCpuPercent double, sampleCount bigint>>"
)


def memory_profile(stats: DataFrame, resource: str, n: int = 50) -> DataFrame:
    """Peak and mean memory and processor use over the ``n`` latest phase rows that report resources."""
    latest = (
        stats.where(F.col("metadata").contains("peakMemoryMB"))
        .orderBy(F.col("started_at").desc(), F.col("id").desc())
        .limit(n)
    )
    parsed = latest.select(F.from_json("metadata", f"struct<resources {RESOURCES}>").alias("m"))
    use = parsed.select(F.element_at("m.resources", F.lit(resource)).alias("r")).where("r is not null")
    return use.agg(
        F.max("r.peakMemoryMB").alias("peak_memory_mb"),
        F.round(F.avg("r.avgMemoryMB"), 6).alias("avg_memory_mb"),
        F.max("r.peakCpuPercent").alias("peak_cpu"),
        F.round(F.avg("r.avgCpuPercent"), 6).alias("avg_cpu"),
        F.count("*").alias("samples"),
    )


def recording_overview(
    recordings: DataFrame, runs: DataFrame, stats: DataFrame, artifacts: DataFrame, *, n: int = 50, phase: str = MODEL_PHASE
) -> DataFrame:
    """One row per recording, newest activity first: last run, frames, speed, artifacts.

    The ``n`` recordings are chosen first and written; only their runs, phases and artifacts are aggregated.
    """
    ensure_checkpoint_dir(recordings.sparkSession)
    last_run = runs.groupBy("recording_id").agg(F.max("started_at").alias("last_run_at"))
    newest = (
        recordings.join(last_run, recordings.id == last_run.recording_id, "left")
        .drop("recording_id")
        .orderBy(F.coalesce("last_run_at", "captured_at").desc(), F.col("id").desc())
        .limit(n)
        .checkpoint()
    )
    # At most n rows, so they go to every task.
    chosen = F.broadcast(newest.select(F.col("id").alias("recording_id")))
    runs, artifacts = runs.join(chosen, "recording_id", "left_semi"), artifacts.join(chosen, "recording_id", "left_semi")
    stats = stats.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    done = runs.where(F.col("status") == "completed").groupBy(F.col("recording_id").alias("id")).agg(
        F.max_by(F.struct(F.col("id").alias("run_id"), "metadata"), F.struct("started_at", "id")).alias("_run")
    )
    model = stats.where((F.col("phase") == phase) & (F.col("status") == "success"))
    # A run may log the phase twice; the first row counts.
    speed = model.groupBy(F.col("run_id").alias("_run_id")).agg(
        F.min_by(F.struct("items_processed", "duration_ms"), "id").alias("_speed")
    )
    spent = latest_phase_rows(stats, runs).groupBy(F.col("recording_id").alias("id")).agg(
        F.sum("duration_ms").alias("_ms")
    )
    kind = F.col("type")
    made = artifacts.groupBy(F.col("recording_id").alias("id")).agg(
        F.count("*").alias("artifacts"),
        *[F.count_if(kind == t).alias(f"{t}_count") for t in ("summary", "card", "standup", "narrative")],
    )
    rows = newest.join(done, "id", "left").withColumn("_run_id", F.col("_run.run_id"))
    rows = rows.join(speed, "_run_id", "left").join(spent, "id", "left").join(made, "id", "left")
    seconds = F.coalesce(F.col("_ms"), F.lit(0)) / 1000
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("artifacts", "summary_count", "card_count", "standup_count", "narrative_count")]
    return rows.select(
        "id",
        "captured_at",
        "last_run_at",
        "duration",
        "status",
        F.get_json_object("_run.metadata", "$.llm_backend").alias("backend"),
        F.get_json_object("_run.metadata", "$.llm_model").alias("model"),
        F.get_json_object("source_metadata", "$.outline.url").alias("document_url"),
        F.coalesce("_speed.items_processed", F.lit(0)).alias("frames"),
        F.round(F.col("_speed.items_processed") / (F.col("_speed.duration_ms") / 1000.0), 2).alias("items_per_sec"),
        half_up(seconds).alias("processing_sec"),
        F.when((seconds > 0) & (F.col("duration") > 0), F.round(seconds / F.col("duration"), 2)).alias("real_time_factor"),
        *counts,
    )


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.avg(F.when(F.col("total_duration_ms") > 0, F.col("total_duration_ms"))), 6).alias("avg_ms"),
    )


def fold_events(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Start and end events to one row per run or phase."""
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    return events.groupBy(key).agg(
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(end, F.col("at"))).alias("completed_at"),
        F.coalesce(F.max_by(F.when(end, F.col("status")), F.when(end, F.col("at"))), F.lit("running")).alias("status"),
        F.max(F.when(end, F.col("duration_ms"))).alias("duration_ms"),
        F.max("items").alias("items"),
        F.max(F.when(end, F.col("error"))).alias("error"),
    )


def batch_report(results: DataFrame) -> DataFrame:
    """Succeeded and failed counts per output format."""
    return results.groupBy("format").agg(
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count("*").alias("total"),
    )


def resource_summary(samples: DataFrame) -> DataFrame:
    """Peak and mean memory and processor use per phase and resource."""
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    return samples.groupBy("phase", "resource").agg(
        half_up(F.max("memory_mb")).alias("peak_memory_mb"),
        half_up(F.avg("memory_mb")).alias("avg_memory_mb"),
        tenth(F.max("cpu")).alias("peak_cpu"),
        tenth(F.avg("cpu")).alias("avg_cpu"),
        F.count("*").alias("samples"),
    )
