"""Run telemetry and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.operators import maintenance, telemetry

HALF = "CAST(floor({} + 0.5) AS BIGINT)".format
LATEST = "run_id IN (SELECT run_id FROM latest_runs)"
MODEL = f"phase = 'vlm-batch-inference' AND status = 'success' AND {LATEST}"


@query(
    "recording_counts",
    """SELECT count(*) AS total, count(*) FILTER (status = 'published') AS processed,
    count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status IN ('raw', 'error')) AS pending FROM recs""",
)
def _(t: Tables):
    return telemetry.recording_counts(t.recs())


@query(
    "processing_totals",
    f"""SELECT {HALF('coalesce(sum(total_duration_ms), 0) / 1000')} AS total_sec,
    {HALF('coalesce(avg(total_duration_ms), 0) / 1000')} AS avg_sec, count(*) AS runs
    FROM runs WHERE id IN (SELECT run_id FROM latest_runs)""",
)
def _(t: Tables):
    return telemetry.processing_totals(t.runs())


@query(
    "frames_processed",
    f"""SELECT CAST(coalesce(sum(items_processed), 0) AS BIGINT) AS total_frames,
    {HALF('sum(items_processed) / count(*)')} AS avg_per_recording FROM stats WHERE {MODEL}""",
)
def _(t: Tables):
    return telemetry.frames_processed(t.stats(), t.runs())


@query(
    "throughput",
    f"""SELECT round(avg(r), 2) AS avg_fps, round(max(r), 2) AS max_fps, round(min(r), 2) AS min_fps FROM
    (SELECT items_processed / (duration_ms / 1000) AS r FROM stats WHERE {MODEL} AND duration_ms > 0 AND items_processed > 0)""",
)
def _(t: Tables):
    return telemetry.throughput(t.stats(), t.runs())


@query(
    "phase_breakdown",
    f"""SELECT phase, {HALF('a / 1000')} AS avg_duration_sec, {HALF('s / 1000')} AS total_duration_sec,
    {HALF('s / sum(s) OVER () * 100')} AS pct_total, run_count, {HALF('i')} AS avg_items FROM
    (SELECT phase, avg(duration_ms) AS a, sum(duration_ms) AS s, count(*) AS run_count, avg(items_processed) AS i
    FROM stats WHERE status = 'success' AND duration_ms > 0 AND {LATEST} GROUP BY phase)""",
)
def _(t: Tables):
    return telemetry.phase_breakdown(t.stats(), t.runs())


VIEWS["profiled"] = (
    "SELECT id, started_at, duration_ms, items_processed FROM stats WHERE phase = 'vlm-batch-inference'"
)


@query(
    "memory_profile",
    """SELECT max(m) AS peak_memory_mb, round(avg(m / 2), 6) AS avg_memory_mb, max(c) AS peak_cpu,
    round(avg(c / 4), 6) AS avg_cpu, count(*) AS samples FROM (SELECT CAST(items_processed AS DOUBLE) AS m,
    CAST(duration_ms AS DOUBLE) AS c FROM profiled ORDER BY started_at DESC, id DESC LIMIT 50)""",
)
def _(t: Tables):
    use = F.struct(
        F.col("items_processed").cast("double").alias("peakMemoryMB"),
        (F.col("items_processed") / 2).alias("avgMemoryMB"),
        F.col("duration_ms").cast("double").alias("peakCpuPercent"),
        (F.col("duration_ms") / 4).alias("avgCpuPercent"),
        F.lit(1).cast("long").alias("sampleCount"),
    )
    metadata = F.to_json(F.struct(F.create_map(F.lit("mlx"), use).alias("resources")))
    rows = t.stats().where("phase = 'vlm-batch-inference'").withColumn("metadata", metadata)
    return telemetry.memory_profile(rows, "mlx")


@query(
    "recording_overview",
    f"""WITH newest AS (SELECT r.*, l.last_run_at FROM recs r LEFT JOIN (SELECT recording_id, max(started_at) AS last_run_at
    FROM runs GROUP BY 1) l ON l.recording_id = r.id ORDER BY coalesce(last_run_at, captured_at) DESC, r.id DESC LIMIT 50),
    done AS (SELECT recording_id, arg_max(id, {{'s': started_at, 'i': id}}) AS run_id,
    arg_max(coalesce(metadata, ''), {{'s': started_at, 'i': id}}) AS metadata FROM runs WHERE status = 'completed' GROUP BY 1),
    speed AS (SELECT run_id, arg_min(items_processed, id) AS items, arg_min(duration_ms, id) AS ms FROM stats
    WHERE phase = 'vlm-batch-inference' AND status = 'success' GROUP BY 1),
    spent AS (SELECT recording_id, sum(duration_ms) / 1000 AS sec FROM latest_phases GROUP BY 1),
    made AS (SELECT recording_id, count(*) AS artifacts, count(*) FILTER (type = 'summary') AS summary_count,
    count(*) FILTER (type = 'card') AS card_count, count(*) FILTER (type = 'standup') AS standup_count,
    count(*) FILTER (type = 'narrative') AS narrative_count FROM arts GROUP BY 1)
    SELECT n.id, n.captured_at, n.last_run_at, n.duration, n.status, nullif(regexp_extract(d.metadata, 'backend":"([^"]*)', 1), '') AS backend,
    nullif(regexp_extract(d.metadata, 'model":"([^"]*)', 1), '') AS model, 'doc/' || n.id AS document_url, coalesce(s.items, 0) AS frames,
    round(s.items / (s.ms / 1000), 2) AS items_per_sec, {HALF('coalesce(p.sec, 0)')} AS processing_sec,
    CASE WHEN p.sec > 0 AND n.duration > 0 THEN round(p.sec / n.duration, 2) END AS real_time_factor,
    coalesce(artifacts, 0) AS artifacts, coalesce(summary_count, 0) AS summary_count, coalesce(card_count, 0) AS card_count,
    coalesce(standup_count, 0) AS standup_count, coalesce(narrative_count, 0) AS narrative_count FROM newest n
    LEFT JOIN done d ON d.recording_id = n.id LEFT JOIN speed s ON s.run_id = d.run_id
    LEFT JOIN spent p ON p.recording_id = n.id LEFT JOIN made m ON m.recording_id = n.id""",
)
def _(t: Tables):
    return telemetry.recording_overview(t.recs(), t.runs(), t.stats(), t.arts())


@query(
    "run_stats",
    """SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
    round(avg(total_duration_ms) FILTER (total_duration_ms > 0), 6) AS avg_ms FROM runs""",
)
def _(t: Tables):
    return telemetry.run_stats(t.runs())


def run_events(t: Tables):
    runs = t.runs()
    start = runs.select(
        F.col("id").alias("run_id"), F.lit("start").alias("kind"), F.col("started_at").alias("at"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("duration_ms"),
        F.col("recording_id").alias("items"), F.lit(None).cast("string").alias("error"),
    )
    end = runs.where("status <> 'running'").select(
        F.col("id").alias("run_id"), F.lit("end"), F.coalesce("completed_at", F.col("started_at") + 1), "status",
        "total_duration_ms", F.lit(0).cast("long"), F.when(F.col("status") == "failed", F.lit("boom")),
    )
    return start.union(end)


@query(
    "fold_runs",
    """SELECT id AS run_id, started_at, CASE WHEN status <> 'running' THEN coalesce(completed_at, started_at + 1) END AS completed_at,
    status, CASE WHEN status <> 'running' THEN total_duration_ms END AS duration_ms, recording_id AS items,
    CASE WHEN status = 'failed' THEN 'boom' END AS error FROM runs""",
)
def _(t: Tables):
    return telemetry.fold_events(run_events(t))


@query(
    "batch_report",
    """SELECT type AS format, count(*) FILTER (id % 9 <> 0) AS succeeded, count(*) FILTER (id % 9 = 0) AS failed,
    count(*) AS total FROM arts GROUP BY type""",
)
def _(t: Tables):
    results = t.arts().select(F.col("type").alias("format"), F.when(F.col("id") % 9 == 0, F.lit("no output")).alias("error"))
    return telemetry.batch_report(results)


@query(
    "resource_summary",
    f"""SELECT phase, status AS resource, {HALF('max(items_processed / 64)')} AS peak_memory_mb,
    {HALF('avg(items_processed / 64)')} AS avg_memory_mb, floor(max(duration_ms / 700) * 10 + 0.5) / 10 AS peak_cpu,
    floor(avg(duration_ms / 700) * 10 + 0.5) / 10 AS avg_cpu, count(*) AS samples FROM stats GROUP BY 1, 2""",
)
def _(t: Tables):
    samples = t.stats().select(
        "phase", F.col("status").alias("resource"), (F.col("items_processed") / 64).alias("memory_mb"), (F.col("duration_ms") / 700).alias("cpu")
    )
    return telemetry.resource_summary(samples)


@query(
    "dedup_observations",
    "SELECT min(id) AS id FROM (SELECT id, recording_id, k, audio_source FROM obs) GROUP BY recording_id, k, audio_source",
)
def _(t: Tables):
    rows = t.obs().select("id", "recording_id", "type", F.col("k").alias("timestamp"), "audio_source")
    return maintenance.dedup_observations(rows).select("id")


@query(
    "enforce_audio_unique",
    """WITH partly AS (SELECT id, CASE WHEN id % 11 > 0 THEN recording_id END AS rec, CASE WHEN id % 13 > 0 THEN k END AS k, CASE WHEN id % 17 > 0 THEN event_type END AS kind,
    CASE WHEN event_type = 'view' THEN 'visual' WHEN id % 7 > 0 THEN 'audio' END AS type FROM obs0)
    SELECT min(id) AS id FROM partly WHERE type = 'audio' AND rec IS NOT NULL AND k IS NOT NULL AND kind IS NOT NULL GROUP BY rec, k, kind
    UNION ALL SELECT id FROM partly WHERE type IS DISTINCT FROM 'audio' OR rec IS NULL OR k IS NULL OR kind IS NULL""",
)
def _(t: Tables):
    unless = lambda n, c: F.when(F.col("id") % n > 0, F.col(c))
    rows = t.obs0().select(
        "id", unless(11, "recording_id").alias("recording_id"), unless(13, "k").alias("timestamp"), unless(17, "event_type").alias("audio_source"),
        F.when(F.col("event_type") == "view", "visual").when(F.col("id") % 7 > 0, "audio").alias("type"),
    )
    return maintenance.enforce_audio_unique(rows).select("id")


VIEWS["old_links"] = "SELECT id AS key, 'old' AS origin, k, 0 AS seen FROM obs0 WHERE id % 3 > 0"
# New keys come twice, and some values are cleared.
VIEWS["new_links"] = """SELECT id // 2 * 2 AS key, CASE WHEN id % 5 > 0 THEN 'new' END AS origin, k + 1 AS k, id AS seen FROM obs0"""


def old_and_new(t: Tables):
    base = t.obs0().where("id % 3 > 0").select(F.col("id").alias("key"), F.lit("old").alias("origin"), "k", F.lit(0).cast("long").alias("seen"))
    new = t.obs0().select((F.col("id") - F.col("id") % 2).alias("key"), F.when(F.col("id") % 5 > 0, "new").alias("origin"), (F.col("k") + 1).alias("k"), F.col("id").alias("seen"))
    return base, new


def one_new(last: bool) -> str:
    """SQL for the first or last new row of every key."""
    pick = "arg_max" if last else "arg_min"
    return f"(SELECT key, {pick}({{'o': origin, 'k': k, 'seen': seen}}, seen) AS r FROM new_links GROUP BY key)"


NEW_COLUMNS = "key, r.o AS origin, r.k AS k, r.seen AS seen"


@query("insert_or_ignore", f"SELECT * FROM old_links UNION ALL SELECT {NEW_COLUMNS} FROM {one_new(False)} WHERE key NOT IN (SELECT key FROM old_links)")
def _(t: Tables):
    return maintenance.insert_or_ignore(*old_and_new(t), ["key"], ["seen"])


@query("insert_or_replace", f"SELECT {NEW_COLUMNS} FROM {one_new(True)} UNION ALL SELECT * FROM old_links WHERE key NOT IN (SELECT key FROM new_links)")
def _(t: Tables):
    return maintenance.insert_or_replace(*old_and_new(t), ["key"], ["seen"])


@query(
    "update_by_key",
    """SELECT o.key, CASE WHEN n.key IS NULL THEN o.origin ELSE n.origin END AS origin, coalesce(n.k, o.k) AS k
    FROM old_links o LEFT JOIN (SELECT * FROM new_links WHERE seen = key) n USING (key)""",
)
def _(t: Tables):
    base, new = old_and_new(t)
    return maintenance.update_by_key(base, new.where("seen = key").drop("seen"), ["key"]).drop("seen")


@query("update_by_key_kept", "SELECT o.key, coalesce(n.origin, o.origin) AS origin FROM old_links o LEFT JOIN (SELECT * FROM new_links WHERE seen = key) n USING (key)")
def _(t: Tables):
    base, new = old_and_new(t)
    return maintenance.update_by_key(base, new.where("seen = key").drop("seen"), ["key"], keep_on_null=True).select("key", "origin")


VIEWS["gone"] = "SELECT DISTINCT recording_id FROM obs0 WHERE k = 42"


@query(
    "delete_cascade",
    """SELECT 'observations' AS part, count(*) AS n FROM obs WHERE recording_id NOT IN (SELECT recording_id FROM gone)
    UNION ALL SELECT 'topic_blocks', count(*) FROM blocks WHERE recording_id NOT IN (SELECT recording_id FROM gone)
    UNION ALL SELECT 'subjects', count(*) FROM subjects WHERE recording_id NOT IN (SELECT recording_id FROM gone)
    UNION ALL SELECT 'subject_topic_blocks', count(*) FROM bridge WHERE topic_block_id NOT IN
    (SELECT id FROM blocks WHERE recording_id IN (SELECT recording_id FROM gone))""",
)
def _(t: Tables):
    from dayweave.catalog.relational import bridge, subjects

    gone = t.obs0().where("k = 42").select(F.col("recording_id").alias("id")).distinct()
    tables = {"observations": t.obs(), "topic_blocks": t.blocks(), "subjects": subjects(t), "subject_topic_blocks": bridge(t)}
    left = maintenance.delete_cascade(tables, gone)
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in left.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "backfill_metadata",
    """SELECT id, CASE WHEN metadata IS NULL THEN '{"llm_model":"unknown"}' ELSE metadata END AS metadata FROM runs""",
)
def _(t: Tables):
    return maintenance.backfill_metadata(t.runs(), "llm_model", "unknown").select("id", "metadata")


@query(
    "patch_format_links",
    """SELECT id, CASE WHEN type = 'card' THEN 'standup:s,card:new' WHEN type = 'summary' THEN 'card:new'
    ELSE type || ':old,card:new' END AS links FROM arts""",
)
def _(t: Tables):
    def entry(fmt, url):
        return F.struct(fmt.alias("format"), F.lit(url).alias("url"), F.lit("h").alias("contentHash"))

    kind = F.col("type")
    links = (
        F.when(kind == "card", F.array(entry(F.lit("card"), "old"), entry(F.lit("standup"), "s")))
        .when(kind != "summary", F.array(entry(kind, "old")))
    )
    patched = maintenance.patch_format_links(links, entry(F.lit("card"), "new"))
    text = F.array_join(F.transform(patched, lambda x: F.concat(x["format"], F.lit(":"), x["url"])), ",")
    return t.arts().select("id", text.alias("links"))


@query(
    "changed_documents",
    """WITH docs AS (SELECT doc_id, lang, md5(text) AS h FROM documents),
    pub AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE lang END AS format,
    CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE h END AS h FROM docs WHERE doc_id % 4 > 0)
    SELECT d.doc_id AS recording_id, d.lang AS format FROM docs d LEFT JOIN pub p ON p.doc_id = d.doc_id
    AND (p.format = d.lang OR p.format IS NULL) WHERE p.h IS DISTINCT FROM d.h""",
)
def _(t: Tables):
    key = F.col("doc_id")
    docs = t.raw("documents").select(key.alias("recording_id"), F.col("lang").alias("format"), F.col("text").alias("content"))
    published = t.raw("documents").where("doc_id % 4 > 0").select(
        key.alias("recording_id"),
        F.when(key % 4 != 1, F.col("lang")).alias("format"),
        F.when(key % 3 == 0, F.lit("stale")).otherwise(F.md5("text")).alias("content_hash"),
    )
    return maintenance.changed_documents(docs, published).select("recording_id", "format")


@query(
    "attempt_ledger",
    """SELECT recording_id * 10 + k % 10 AS frame_id, count(*) FILTER (value < 180) AS failures, max(timestamp) AS last_at,
    CAST(CASE WHEN bool_or(value >= 180) THEN 1 WHEN count(*) FILTER (value < 180) > 3 THEN 2 ELSE 0 END AS INTEGER) AS state
    FROM obs0 GROUP BY 1""",
)
def _(t: Tables):
    attempts = t.obs0().select(
        (F.col("recording_id") * 10 + F.col("k") % 10).alias("frame_id"), (F.col("value") >= 180).alias("ok"), F.col("timestamp").alias("at")
    )
    return maintenance.attempt_ledger(attempts)


@query("pending_backlog", "SELECT count(*) AS pending, min(timestamp) AS oldest_ts, max(timestamp) AS newest_ts FROM frames WHERE analyzed = 0")
def _(t: Tables):
    return maintenance.pending_backlog(t.frames())


@query("oldest_pending", "SELECT id, timestamp AS ts FROM frames WHERE analyzed = 0 ORDER BY timestamp, id LIMIT 10")
def _(t: Tables):
    return maintenance.oldest_pending(t.frames()).select("id", F.col("timestamp").alias("ts"))


@query("unclaimed", "SELECT id FROM obs WHERE tb_id IS NULL AND vlm_description IS NOT NULL ORDER BY timestamp, id LIMIT 500")
def _(t: Tables):
    return maintenance.unclaimed(t.obs()).select("id")


@query(
    "retention",
    """SELECT id FROM (SELECT id, sum(bytes) OVER (ORDER BY timestamp DESC, id DESC) AS kept, sum(bytes) OVER () AS whole
    FROM frames) WHERE whole > 200000000 AND kept > 100000000""",
)
def _(t: Tables):
    return maintenance.retention(t.frames(), 200_000_000, 100_000_000).select("id")
