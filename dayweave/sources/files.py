"""Readers of capture folders, transcripts, logs and manifests.

Every reader lists and reads files through Spark's file sources, so a folder of any size is split over
the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayweave.functions.clock import timestamp_text_seconds
from dayweave.functions.text import trim_blank
from dayweave.session import ensure_checkpoint_dir

CAPTURE = (
    "platform string, pretty_name string, sharing struct<id string, link string>, segments array<struct<display struct<path string>,"
    " mic struct<path string>, system_audio struct<path string>>>, status struct<status string>"
)
HASH_LOG = (
    "scenario string, frame_num int, elapsed_s double, sc_status string, phash_hex string, phash_hamming int, dhash_hex string,"
    " dhash_hamming int, vn_distance double, vn_latency_ms double, jpeg_path string"
)
VISUAL_INDEX = (
    "frames array<struct<index int, timestamp double, imagePath string, ocrText string, clusterId int, changeScore double>>,"
    " clusters array<struct<id int, heuristicLabel string, timeRange array<double>, frameCount int, representativeIdx int,"
    " avgOcrCharacters double, mediaIndicators array<string>>>, processingTime struct<ocrMs bigint, clipMs bigint, totalMs bigint>"
)
TRANSCRIPT = "transcription array<struct<offsets struct<`from` bigint, `to` bigint>, text string>>"
#: File name without folders and the extension.
_STEM = r"([^/]+?)(\.[^/.]+)?$"


def _name(path_column: str = "_metadata.file_path") -> Column:
    return F.regexp_extract(path_column, _STEM, 1)


def scan_capture_meta(spark: SparkSession, path: str, *, name: str = "recording-meta.json") -> tuple[DataFrame, DataFrame]:
    """Captures below ``path`` and the rejected metadata files with a reason.

    Every capture is a folder with a file ``name``, which may be a pattern of names. A capture needs a segment and a microphone or system track. Newest first is
    ``orderBy(captured_at.desc())``.
    """
    reader = spark.read.schema(CAPTURE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    rows = reader.json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("captured_at"))
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    first = F.get("segments", 0)
    reason = F.when(F.col("segments").isNull() | (F.size("segments") == 0), F.lit("no segments")).when(
        first["mic"]["path"].isNull() & first["system_audio"]["path"].isNull(), F.lit("no audio")
    )
    parsed = rows.select(
        F.regexp_replace(folder, r"\.cap$", "").alias("id"), "file", "captured_at", "pretty_name", first["display"]["path"].alias("video_path"),
        first["mic"]["path"].alias("audio_mic_path"), first["system_audio"]["path"].alias("audio_system_path"), reason.alias("reason"),
    )
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null").select("id", "file", "reason")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """File paths below ``path``; contents are not read because no column of them is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def scan_frame_listing(spark: SparkSession, path: str, *, form: str = r"/(\d+)_(\d+)\.(jpg|png)$") -> DataFrame:
    """Frames named ``<epochMs>_<displayId>.jpg|png``, as ``form`` reads it; other files are ignored."""
    return _listing(spark, path).where(F.col("path").rlike(form)).select(
        F.col("path").alias("image_path"), (F.regexp_extract("path", form, 1).cast("double") / 1000).alias("timestamp"), F.regexp_extract("path", form, 2).alias("display_id")
    )


def scan_frame_dir(spark: SparkSession, path: str, interval: float = 2.0, *, suffix: str = ".jpg") -> DataFrame:
    """Frames of one folder per recording, timed by their place in name order.

    Names are dealt into ranges of nearby names first and counted there, so a folder of any size is
    numbered in parallel, however its files are named.
    """
    shots = _listing(spark, path).where(F.col("path").endswith(suffix)).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("recording_id"), F.col("path").alias("image_path")
    )
    # The range a row falls in is stored with it: the counts and the rows must see the same ranges.
    ensure_checkpoint_dir(spark)
    ranged = shots.repartitionByRange("recording_id", "image_path").withColumn("_range", F.spark_partition_id()).checkpoint()
    group = ["recording_id", "_range"]
    before = Window.partitionBy("recording_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("image_path")) - 1
    place = (F.col("_base") + F.col("_in")).cast("long")
    numbered = ranged.withColumn("_in", inside).join(counts.drop("_n"), group)
    return numbered.select("recording_id", "image_path", place.alias("frame_index"), (place * F.lit(interval)).alias("timestamp"))


def scan_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """Transcript segments in seconds, one row each; the recording is the file name."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).select(_name().alias("recording_id"), "transcription")
    segs = rows.select("recording_id", F.posexplode("transcription").alias("n", "s"))
    return segs.select(
        "recording_id", F.concat(F.lit("seg-"), "n").alias("seg_id"), "n", (F.col("s.offsets.from") / 1000).alias("start"), (F.col("s.offsets.to") / 1000).alias("end"),
        trim_blank(F.col("s.text")).alias("text"),
    )


def transcript_totals(segments: DataFrame) -> DataFrame:
    """Segment count and duration (end of the last segment) per recording."""
    return segments.groupBy("recording_id").agg(F.count("*").alias("segments"), F.max_by("end", "n").alias("duration"))


def parse_transcript_log(lines: DataFrame) -> DataFrame:
    """Segments of ``(recording_id, line_no, line)`` rows of the form ``[start --> end] text``.

    A recording without such a line becomes one segment from 0 to 0 with its whole text.
    """
    form = r"\[(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})\]\s*(.*)"
    timed = lines.where(F.col("line").rlike(form)).select(
        "recording_id", "line_no", timestamp_text_seconds(F.regexp_extract("line", form, 1)).alias("start"),
        timestamp_text_seconds(F.regexp_extract("line", form, 2)).alias("end"), trim_blank(F.regexp_extract("line", form, 3)).alias("text"),
    )
    rest = lines.join(timed.select("recording_id").distinct(), "recording_id", "left_anti").where(trim_blank(F.col("line")) != "")
    whole = rest.groupBy("recording_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text")
    )
    plain = whole.select("recording_id", F.lit(0).cast("long").alias("line_no"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), trim_blank(F.col("text")).alias("text"))
    return timed.unionByName(plain)


def scan_transcript_log(spark: SparkSession, path: str) -> DataFrame:
    """Transcript logs below ``path``, one recording per file."""
    files = spark.read.text(path, wholetext=True).select(_name().alias("recording_id"), "value")
    lines = files.select("recording_id", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return parse_transcript_log(lines.select("recording_id", F.col("n").cast("long").alias("line_no"), "line"))


def scene_times(logs: DataFrame, *, zero: bool = False) -> DataFrame:
    """Scene times after zero in detector logs ``(recording_id, value)``; with ``zero`` those at zero as well."""
    found = F.regexp_extract_all("value", F.lit(r"pts_time:([\d.]+)"), F.lit(1))
    times = logs.select("recording_id", F.explode(found).alias("t"))
    return times.select("recording_id", F.col("t").cast("double").alias("timestamp")).where("timestamp >= 0" if zero else "timestamp > 0")


def scan_scene_log(spark: SparkSession, path: str) -> DataFrame:
    """Detector logs read line by line, so a long log is split like any text file."""
    return scene_times(spark.read.text(path).select(_name().alias("recording_id"), "value"))


def scan_visual_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and clusters of visual index documents."""
    rows = spark.read.schema(VISUAL_INDEX).option("multiLine", True).json(path).select("*", _name().alias("recording_id"))
    frames = rows.select("recording_id", F.explode("frames").alias("f")).select(
        "recording_id", F.col("f.index").alias("id"), "f.timestamp", F.col("f.imagePath").alias("image_path"), F.col("f.ocrText").alias("ocr_text"),
        F.col("f.clusterId").alias("cluster_id"), F.col("f.changeScore").alias("change_score"),
    )
    clusters = rows.select("recording_id", F.explode("clusters").alias("c")).select(
        "recording_id", F.col("c.id").alias("cluster_id"), F.col("c.heuristicLabel").alias("label"), F.get("c.timeRange", 0).alias("from_ts"), F.get("c.timeRange", 1).alias("to_ts"),
        F.col("c.frameCount").alias("frame_count"), F.col("c.representativeIdx").alias("representative_id"), F.col("c.avgOcrCharacters").alias("avg_ocr_characters"),
        F.col("c.mediaIndicators").alias("media_indicators"),
    )
    return frames, clusters


def scan_vad_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Speech spans of manifests; the recording is the file name."""
    rows = spark.read.schema("start double, end double, audioPath string").option("multiLine", True).json(path)
    return rows.select(_name().alias("recording_id"), "start", "end", F.col("audioPath").alias("audio_path"))


def scan_hash_csv(spark: SparkSession, path: str) -> DataFrame:
    """Frame hash logs; empty fields are null."""
    return spark.read.schema(HASH_LOG).option("header", True).option("nullValue", "").csv(path)
