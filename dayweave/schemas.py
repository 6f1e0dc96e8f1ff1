"""Schemas of the stored tables and the casts their raw columns need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.functions.text import json_or_comma_list

CLASSIFICATION = (
    "struct<activity_type string, key_description string, start_time double, end_time double, duration double, apps array<string>,"
    " topics array<string>, transcript_count int, has_transcript boolean, combined_transcript string, label string>"
)
VLM_STATS = (
    "struct<model string, prompt_tokens bigint, generation_tokens bigint, prompt_tps double, generation_tps double, inference_ms bigint, peak_memory_gb double>"
)
RESOURCES = "map<string, struct<peakMemoryMB double, avgMemoryMB double, peakCpuPercent double, avgCpuPercent double, sampleCount bigint>>"

TABLES = {
    "recordings": "id string, video_path string, audio_mic_path string, audio_system_path string, duration double, captured_at timestamp, status string,"
    " processing_step string, source_type string, source_metadata string, error_message string, created_at timestamp, updated_at timestamp",
    "frames": "id string, display_id string, captured_at timestamp, timestamp double, image_path string, phash bigint, width int, height int, analyzed int,"
    " processing_lock_id string, processing_started_at timestamp, retry_count int, failed_at timestamp, created_at timestamp",
    "observations": "id string, recording_id string, frame_id string, type string, timestamp double, end_timestamp double, image_path string, ocr_text string,"
    " vlm_description string, vlm_raw_response string, activity_type string, apps array<string>, topics array<string>, text string, audio_source string,"
    f" audio_type string, embedding array<float>, vlm_stats {VLM_STATS}, tb_id string, created_at timestamp",
    "contexts": "id string, type string, name string, metadata string, created_at timestamp",
    "observation_contexts": "observation_id string, context_id string, confidence double",
    "topic_blocks": "id string, recording_id string, context_ids array<string>, duration double, from_ts double, to_ts double, observation_count int,"
    f" compacted_at double, effort_seconds double, created_at timestamp, classification {CLASSIFICATION}",
    "subjects": "id string, recording_id string, label string, is_personal boolean, duration double, activity_breakdown map<string, double>, apps array<string>, created_at timestamp",
    "subject_topic_blocks": "subject_id string, topic_block_id string",
    "artifacts": "id string, recording_id string, type string, content string, format string, source_block_ids array<string>, source_context_ids array<string>,"
    " corrections string, created_at timestamp, updated_at timestamp",
    "artifact_subjects": "artifact_id string, subject_id string",
    "observation_entities": "entity_id string, observation_id string, entity_kind string, entity_value string, confidence double, created_at double",
    "processing_runs": "id string, recording_id string, run_type string, status string, started_at timestamp, completed_at timestamp, total_duration_ms bigint,"
    " error_message string, metadata string",
    "processing_stats": "id string, run_id string, phase string, status string, started_at timestamp, completed_at timestamp, duration_ms bigint, items_total bigint,"
    f" items_processed bigint, resources {RESOURCES}",
    "llm_debug_log": "id string, recording_id string, call_type string, prompt string, result string, metadata string, created_at timestamp",
}
# Column the rows of a table are sorted by inside its files, so that ranges skip row groups.
SORTED_BY = {"observations": "timestamp", "frames": "timestamp", "topic_blocks": "from_ts"}


def parse_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Name lists from JSON text or comma-joined text; unreadable values become null."""
    return df.withColumns({c: json_or_comma_list(F.col(c)) for c in columns})


def parse_classification(df: DataFrame, column: str = "classification") -> DataFrame:
    return df.withColumn(column, F.from_json(column, CLASSIFICATION))


def vector_from_bytes(df: DataFrame, column: str, size: int) -> DataFrame:
    """Little-endian 32-bit floats of a binary column as an array of ``size`` doubles."""
    word = lambda i: F.conv(F.concat(*[F.substring(F.hex(column), i * 8 + p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("long")

    def number(bits):
        sign = F.when(bits >= 2**31, -1.0).otherwise(1.0)
        exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255).cast("long"))
        fraction = bits.bitwiseAND(F.lit(2**23 - 1).cast("long"))
        normal = (F.lit(1.0) + fraction / 2**23) * F.pow(F.lit(2.0), exponent - 127)
        small = fraction / 2**23 * F.pow(F.lit(2.0), F.lit(-126.0))
        return sign * F.when(exponent == 0, small).otherwise(normal)

    return df.withColumn(column, F.array(*[number(word(i)) for i in range(size)]))
