"""Selections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.operators import filters, joins

#: A fixed hour range inside the event month.
T0, T1 = 1704672000.0, 1705276800.0
OBS = ["id", "recording_id", "timestamp"]


@query("find_by_status", "SELECT id, duration FROM recs WHERE status = 'raw'")
def _(t: Tables):
    return filters.find_by(t.recs(), "status", "raw").select("id", "duration")


@query("find_by_recording", "SELECT id, timestamp AS ts, activity_type FROM obs WHERE recording_id = 7")
def _(t: Tables):
    found = filters.find_by(t.obs(), "recording_id", 7, order=[F.col("timestamp"), F.col("id")])
    return found.select("id", F.col("timestamp").alias("ts"), "activity_type")


@query("find_pending", "SELECT id, status, captured_at FROM recs WHERE status IN ('raw', 'processing')")
def _(t: Tables):
    return filters.find_pending(t.recs()).select("id", "status", "captured_at")


@query(
    "filter_observations",
    f"""SELECT id, recording_id, timestamp AS ts FROM obs WHERE activity_type IN ('Writing Code', 'Reading docs')
    AND list_contains(apps, 'Slack') AND list_contains(apps, 'Zoom')
    AND (coalesce(lower(vlm_description) LIKE '%bug%', false) OR coalesce(lower(text) LIKE '%bug%', false))
    AND timestamp >= {T0} AND timestamp <= {T1} AND frame_id IS NULL""",
)
def _(t: Tables):
    rows = filters.filter_observations(
        t.obs(), types=["visual"], activities=["Writing Code", "Reading docs"], apps=["Slack", "Zoom"],
        search="Bug", start=T0, end=T1, source="batch",
    )
    return rows.select("id", "recording_id", F.col("timestamp").alias("ts"))


@query("paginate", "SELECT id, timestamp AS ts FROM obs ORDER BY timestamp DESC, id DESC LIMIT 200 OFFSET 40")
def _(t: Tables):
    return filters.paginate(t.obs(), 500, 40).select("id", F.col("timestamp").alias("ts"))


@query("blocks_overlapping", f"SELECT id, from_ts, to_ts FROM blocks WHERE from_ts < {T1} AND to_ts > {T0}")
def _(t: Tables):
    return filters.blocks_overlapping(t.blocks(), T0, T1).select("id", "from_ts", "to_ts")


@query("blocks_within", f"SELECT id, from_ts, to_ts FROM blocks WHERE from_ts >= {T0} AND to_ts <= {T1}")
def _(t: Tables):
    return filters.blocks_within(t.blocks(), T0, T1).select("id", "from_ts", "to_ts")


@query(
    "observations_between",
    f"SELECT id, timestamp AS ts FROM obs WHERE frame_id IS NOT NULL AND timestamp BETWEEN {T0} AND {T1}",
)
def _(t: Tables):
    return filters.observations_between(t.obs(), T0, T1).select("id", F.col("timestamp").alias("ts"))


@query("substantial_blocks", "SELECT id, observation_count FROM blocks WHERE observation_count >= 5 AND to_ts - from_ts >= 60")
def _(t: Tables):
    return filters.substantial_blocks(t.blocks()).select("id", "observation_count")


VIEWS["subjects"] = (
    "SELECT recording_id * 10 + id % 3 AS id, recording_id, bool_or(list_contains(apps, 'WhatsApp') AND id % 4 = 0) AS is_personal,"
    " sum(CAST(floor(duration) AS BIGINT)) AS seconds FROM blocks GROUP BY recording_id * 10 + id % 3, recording_id"
)
VIEWS["bridge"] = "SELECT recording_id * 10 + id % 3 AS subject_id, id AS topic_block_id FROM blocks WHERE id % 11 > 0"


def bridge(t: Tables):
    return t.blocks().where(F.col("id") % 11 > 0).select(
        (F.col("recording_id") * 10 + F.col("id") % 3).alias("subject_id"), F.col("id").alias("topic_block_id")
    )


def subjects(t: Tables):
    flag = F.array_contains("apps", "WhatsApp") & (F.col("id") % 4 == 0)
    return t.blocks().groupBy((F.col("recording_id") * 10 + F.col("id") % 3).alias("id"), "recording_id").agg(
        F.bool_or(flag).alias("is_personal"), F.sum(F.floor("duration")).alias("seconds")
    )


@query(
    "drop_personal",
    """SELECT id FROM blocks WHERE id NOT IN (SELECT topic_block_id FROM (SELECT topic_block_id,
    arg_min(s.is_personal, b.subject_id) AS p FROM bridge b JOIN subjects s ON s.id = b.subject_id GROUP BY 1) WHERE p)""",
)
def _(t: Tables):
    return filters.drop_personal(t.blocks(), subjects(t), bridge(t)).select("id")


@query(
    "usable_visual",
    "SELECT id FROM obs WHERE type = 'visual' AND vlm_description <> '' AND NOT starts_with(vlm_description, 'No description')"
    " AND NOT starts_with(vlm_description, 'Parse error')",
)
def _(t: Tables):
    return filters.usable_visual(t.obs(), resume=True).select("id")


@query(
    "observation_facets",
    """SELECT DISTINCT 'activity' AS facet, activity_type AS value FROM obs WHERE activity_type IS NOT NULL
    UNION ALL SELECT DISTINCT 'app', value FROM (SELECT unnest(apps) AS value FROM obs)""",
)
def _(t: Tables):
    return filters.observation_facets(t.obs())


@query("latest_n", "SELECT id, started_at FROM runs ORDER BY started_at DESC, id DESC LIMIT 100")
def _(t: Tables):
    return filters.latest_n(t.runs(), "started_at", 100).select("id", "started_at")


@query(
    "sub_batches",
    """SELECT id, CAST(floor((row_number() OVER (ORDER BY timestamp, id) - 1) / 100) AS BIGINT) AS batch_no FROM obs""",
)
def _(t: Tables):
    return filters.sub_batches(t.obs().select("id", "timestamp")).select("id", "batch_no")


ALIGNED = """SELECT w.recording_id, w.segment_id, a.id AS transcript_id, a.audio_source AS source, a.text, a.s AS transcript_start
    FROM windows w JOIN (SELECT *, timestamp AS s, coalesce(end_timestamp, timestamp + 5) AS e FROM audio
    WHERE length(trim(text)) > 0) a ON a.recording_id = w.recording_id AND w.start_time < a.e AND a.s < w.end_time
    AND least(w.end_time, a.e) - greatest(w.start_time, a.s) >= 1"""


@query("align_transcripts", f"SELECT recording_id, segment_id, transcript_id, source FROM ({ALIGNED})")
def _(t: Tables):
    pairs = joins.align_transcripts(t.windows(), t.audio())
    return pairs.select("recording_id", "segment_id", "transcript_id", "source")


@query(
    "combined_transcript",
    f"SELECT segment_id, transcript_start, transcript_id, '[' || upper(source) || '] ' || text AS line FROM ({ALIGNED})",
)
def _(t: Tables):
    lines = joins.transcript_lines(joins.align_transcripts(t.windows(), t.audio()))
    return lines.select("segment_id", "transcript_start", "transcript_id", "line")


@query(
    "alignment_counts",
    f"""SELECT w.segment_id, count(p.transcript_id) AS transcripts, count(*) FILTER (p.source = 'mic') AS mic,
    count(*) FILTER (p.source = 'system') AS system FROM windows w LEFT JOIN ({ALIGNED}) p
    ON p.segment_id = w.segment_id AND p.recording_id = w.recording_id GROUP BY w.segment_id""",
)
def _(t: Tables):
    pairs = joins.align_transcripts(t.windows(), t.audio())
    return joins.alignment_counts(t.windows(), pairs).select("segment_id", "transcripts", "mic", "system")


VIEWS["open_blocks"] = (
    "SELECT id, recording_id, created_at, CASE WHEN id % 50 = 0 THEN NULL ELSE from_ts END AS from_ts,"
    " CASE WHEN id % 40 = 0 THEN 0 WHEN id % 41 = 0 THEN NULL ELSE to_ts END AS to_ts FROM blocks"
)
FRAME_BLOCK = """SELECT f.recording_id, f.id AS frame_id, arg_min(b.id, {'c': b.created_at, 'i': b.id}) AS block_id
    FROM frames f JOIN open_blocks b ON b.recording_id = f.recording_id AND f.timestamp >= coalesce(b.from_ts, 0)
    AND f.timestamp <= CASE WHEN b.to_ts <> 0 THEN b.to_ts ELSE 1e300 END GROUP BY 1, 2"""


def open_blocks(t: Tables):
    n = F.col("id")
    return t.blocks().select(
        "id", "recording_id", "created_at",
        F.when(n % 50 != 0, F.col("from_ts")).alias("from_ts"),
        F.when(n % 40 == 0, F.lit(0.0)).when(n % 41 != 0, F.col("to_ts")).alias("to_ts"),
    )


@query("frame_to_block", FRAME_BLOCK)
def _(t: Tables):
    return joins.frame_to_block(t.frames(), open_blocks(t)).select("recording_id", "frame_id", "block_id")


@query(
    "frames_by_subject",
    f"SELECT b.subject_id, f.frame_id, f.block_id FROM ({FRAME_BLOCK}) f JOIN bridge b ON b.topic_block_id = f.block_id",
)
def _(t: Tables):
    return joins.frames_by_subject(t.frames(), open_blocks(t), bridge(t)).select("subject_id", "frame_id", "block_id")


VIEWS["outer_blocks"] = (
    "SELECT id, recording_id, CASE WHEN id % 2 = 0 THEN from_ts + 1 ELSE from_ts - 30000 END AS from_ts, to_ts + 60000 AS to_ts FROM blocks"
)


def outer_blocks(t: Tables):
    return t.blocks().select(
        "id", "recording_id", F.when(F.col("id") % 2 == 0, F.col("from_ts") + 1).otherwise(F.col("from_ts") - 30000).alias("from_ts"), (F.col("to_ts") + 60000).alias("to_ts")
    )


CONTAINED = """SELECT i.recording_id, i.id AS inner_id, o.id AS outer_id FROM blocks i JOIN outer_blocks o
    ON o.recording_id = i.recording_id AND i.from_ts >= o.from_ts AND i.to_ts <= o.to_ts"""


@query("contained_blocks", CONTAINED)
def _(t: Tables):
    pairs = joins.contained_blocks(t.blocks(), outer_blocks(t), ["recording_id"], width=14400.0)
    return pairs.select("recording_id", "inner_id", "outer_id")


@query("orphan_blocks", f"SELECT id FROM blocks WHERE id NOT IN (SELECT inner_id FROM ({CONTAINED}))")
def _(t: Tables):
    return joins.orphan_blocks(t.blocks(), outer_blocks(t), ["recording_id"], width=14400.0).select("id")


@query(
    "run_for_artifact",
    """SELECT a.id, r.run_id FROM arts a LEFT JOIN (SELECT a.id, arg_max(r.id, {'s': r.started_at, 'i': r.id}) AS run_id
    FROM arts a JOIN runs r ON r.recording_id = a.recording_id AND r.status = 'completed' AND r.started_at <= a.created_at
    AND (r.completed_at IS NULL OR r.completed_at >= a.created_at) GROUP BY a.id) r ON r.id = a.id""",
)
def _(t: Tables):
    return joins.run_for_artifact(t.arts(), t.runs()).select("id", "run_id")


VIEWS["contexts"] = "SELECT DISTINCT k % 7 AS id, 'topic' AS type, 'topic ' || (k % 7) AS name FROM obs0"
VIEWS["links"] = "SELECT id AS observation_id, k % 7 AS context_id, k / 100.0 AS confidence FROM obs0"


def contexts(t: Tables):
    return t.obs0().select((F.col("k") % 7).alias("id"), F.lit("topic").alias("type"), F.concat(F.lit("topic "), F.col("k") % 7).alias("name")).distinct()


def links(t: Tables):
    return t.obs0().select(F.col("id").alias("observation_id"), (F.col("k") % 7).alias("context_id"), (F.col("k") / 100.0).alias("confidence"))


@query(
    "observations_by_context",
    """SELECT o.id, c.name AS context_name, l.confidence FROM obs o JOIN links l ON l.observation_id = o.id
    JOIN contexts c ON c.id = l.context_id""",
)
def _(t: Tables):
    return joins.observations_by_context(t.obs(), links(t), contexts(t)).select("id", "context_name", "confidence")


@query("blocks_by_subject", "SELECT b.subject_id, k.id, k.duration FROM bridge b JOIN blocks k ON k.id = b.topic_block_id")
def _(t: Tables):
    return joins.blocks_by_subject(t.blocks(), bridge(t)).select("subject_id", "id", "duration")


@query("rows_by_member", "SELECT id, app FROM (SELECT id, unnest(list_distinct(apps)) AS app FROM blocks)")
def _(t: Tables):
    return joins.rows_by_member(t.blocks(), "apps", "app").select("id", "app")


@query(
    "effective_ts",
    "SELECT o.id, coalesce(f.captured_ts, o.timestamp) AS effective_ts FROM obs o LEFT JOIN frames f ON f.id = o.frame_id",
)
def _(t: Tables):
    return joins.effective_ts(t.obs(), t.frames()).select("id", "effective_ts")


VIEWS["latest_runs"] = "SELECT recording_id, max(id) AS run_id FROM runs WHERE status = 'completed' GROUP BY recording_id"


@query("in_latest_runs", "SELECT run_id, phase, items_processed FROM stats WHERE run_id IN (SELECT run_id FROM latest_runs)")
def _(t: Tables):
    return joins.in_latest_runs(t.stats(), t.runs()).select("run_id", "phase", "items_processed")


@query(
    "unprocessed_frames",
    "SELECT id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.vlm_description <> '' AND"
    " o.recording_id = f.recording_id AND o.timestamp = f.timestamp)",
)
def _(t: Tables):
    return joins.unprocessed_frames(t.frames(), filters.usable_visual(t.obs(), resume=True)).select("id")


@query(
    "valid_members",
    """SELECT recording_id, block_id FROM (SELECT recording_id, id + id % 2 * 7 AS block_id FROM obs0) g WHERE EXISTS
    (SELECT 1 FROM blocks b WHERE b.recording_id = g.recording_id AND b.id = g.block_id)""",
)
def _(t: Tables):
    groups = t.obs0().select("recording_id", (F.col("id") + F.col("id") % 2 * 7).alias("block_id"))
    return joins.valid_members(groups, t.blocks())


VIEWS["slices"] = (
    "SELECT DISTINCT recording_id, floor(timestamp / 30) AS range_id, floor(timestamp / 30) * 30 AS range_start,"
    " floor(timestamp / 30) * 30 + 30 AS range_end FROM audio"
)
SLICED = """SELECT s.*, r.range_id FROM segs s JOIN slices r ON r.recording_id = s.recording_id
    AND s.start < r.range_end AND s."end" > r.range_start"""


def slices(t: Tables):
    n = F.floor(F.col("timestamp") / 30).cast("double")
    return t.audio().select("recording_id", n.alias("range_id"), (n * 30).alias("range_start"), (n * 30 + 30).alias("range_end")).distinct()


@query("slice_transcript", f"SELECT recording_id, range_id, seg_id, text FROM ({SLICED})")
def _(t: Tables):
    return joins.slice_transcript(t.segs(), slices(t)).select("recording_id", "range_id", "seg_id", "text")


@query(
    "slice_stats",
    f"""SELECT recording_id, range_id, source, count(*) AS segments,
    greatest(arg_max("end", {{'s': start, 'i': seg_id}}) - min(start), 0) AS duration FROM ({SLICED}) GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return joins.slice_stats(joins.slice_transcript(t.segs(), slices(t)))


VIEWS["owned"] = "SELECT s.*, r.recording_id FROM stats s JOIN runs r ON r.id = s.run_id WHERE s.status = 'success'"
VIEWS["latest_phases"] = (
    "SELECT o.* FROM owned o JOIN (SELECT recording_id, phase, max(started_at) AS m FROM owned WHERE duration_ms > 0"
    " GROUP BY 1, 2) l ON l.recording_id = o.recording_id AND l.phase = o.phase AND l.m = o.started_at"
)


@query("latest_phase_rows", "SELECT recording_id, phase, started_at, duration_ms FROM latest_phases")
def _(t: Tables):
    return joins.latest_phase_rows(t.stats(), t.runs()).select("recording_id", "phase", "started_at", "duration_ms")


@query(
    "recordings_with_blocks",
    """SELECT r.id, coalesce(b.n, 0) AS blocks, round(coalesce(b.d, 0), 4) AS block_seconds FROM recs r LEFT JOIN
    (SELECT recording_id, count(*) AS n, sum(duration) AS d FROM blocks GROUP BY 1) b ON b.recording_id = r.id""",
)
def _(t: Tables):
    return joins.recordings_with_blocks(t.recs(), t.blocks()).select("id", "blocks", F.round("block_seconds", 4).alias("block_seconds"))


@query(
    "interleave_transcripts",
    """SELECT recording_id, n AS line_no, 'seg-' || n AS id, printf('[%02d:%02d ', CAST(floor(start / 60) AS BIGINT),
    CAST(floor(start % 60) AS BIGINT)) || upper(source) || '] ' || text AS text FROM (SELECT *,
    row_number() OVER (PARTITION BY recording_id ORDER BY start, seg_id) - 1 AS n FROM segs)""",
)
def _(t: Tables):
    return joins.interleave_transcripts(t.segs()).select("recording_id", "line_no", "id", "text")
