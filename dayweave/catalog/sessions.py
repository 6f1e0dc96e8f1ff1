"""Activity segments and gap blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.functions import vocab
from dayweave.operators import filters, joins, segments


def case_contains(text: str, rules: list[tuple[str, list[str]]], test: str) -> str:
    return " ".join(
        f"WHEN {' OR '.join(test.format(text, n) for n in needles)} THEN '{label}'" for label, needles in rules
    )


def activity_sql(text: str) -> str:
    """Oracle form of the description label."""
    low = f"trim(lower({text}))"
    word = f"regexp_extract({low}, '^([^ ,.]*)', 1)"
    return (
        f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'other' "
        + case_contains(low, vocab.DESCRIPTION_LABELS, "contains({}, '{}')")
        + " "
        + case_contains(word, vocab.FIRST_WORD_LABELS, "{} = '{}'")
        + " ELSE 'other' END"
    )


def canonical_sql(label: str) -> str:
    """Oracle form of the canonical activity."""
    low = f"trim(lower({label}))"
    exact = " ".join(f"WHEN {low} = '{s}' THEN '{v}'" for s, v in vocab.ACTIVITY_SYNONYMS)
    part = " ".join(f"WHEN contains({low}, '{s}') THEN '{v}'" for s, v in vocab.ACTIVITY_SYNONYMS)
    return f"CASE WHEN {label} IS NULL THEN NULL {exact} {part} ELSE regexp_replace({low}, '\\s+', '_', 'g') END"


def clean_list_sql(column: str, *, apps: bool) -> str:
    noise = " AND ".join(f"NOT regexp_matches(trim(x), '{p}')" for p in vocab.APP_NOISE_PATTERNS) if apps else "true"
    return f"[trim(x) FOR x IN {column} IF length(trim(x)) BETWEEN 2 AND 50 AND {noise}]"


VIEWS["labelled"] = (
    f"SELECT *, {canonical_sql('raw_label')} AS activity FROM (SELECT *, coalesce(nullif(activity_type, ''),"
    f" {activity_sql('vlm_description')}) AS raw_label FROM obs WHERE vlm_description <> '')"
)
VIEWS["marked"] = (
    "SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY timestamp, id) AS run_no FROM (SELECT *, CASE WHEN"
    " lag(activity) OVER (PARTITION BY recording_id ORDER BY timestamp, id) = activity THEN 0 ELSE 1 END AS fresh FROM labelled)"
)
VIEWS["actruns"] = (
    "SELECT recording_id, run_no, activity, arg_min(id, {'t': timestamp, 'i': id}) AS run_id, min(timestamp) AS start_time,"
    " max(timestamp) AS end_time, count(*) AS observations, arg_min(vlm_description, {'t': timestamp, 'i': id}) AS key_description"
    " FROM marked GROUP BY 1, 2, 3"
)
MIN = 40000
VIEWS["numbered"] = (
    "SELECT recording_id, row_number() OVER w AS i, run_id, activity, start_time AS s, end_time AS e,"
    " lead(end_time - start_time) OVER w AS nx FROM actruns WINDOW w AS (PARTITION BY recording_id ORDER BY start_time, run_id)"
)
# Steps through the runs of all recordings at once. The row of step i holds what was decided for run i
# (k keep, p join previous, n join next), the last kept run and the span pushed forward.
MERGED = f"""WITH RECURSIVE steps AS (
    SELECT recording_id, 0 AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS ps, CAST(NULL AS DOUBLE) AS pe,
    CAST(NULL AS DOUBLE) AS cs, CAST(NULL AS DOUBLE) AS ce, '' AS d FROM numbered WHERE i = 1
    UNION ALL
    SELECT recording_id, i, CASE d WHEN 'k' THEN run_id ELSE a END, CASE d WHEN 'k' THEN cs WHEN 'p' THEN least(ps, cs) ELSE ps END,
    CASE d WHEN 'k' THEN ce WHEN 'p' THEN greatest(pe, ce) ELSE pe END, CASE WHEN d = 'n' THEN cs END, CASE WHEN d = 'n' THEN ce END, d
    FROM (SELECT *, CASE WHEN ce - cs >= {MIN} OR (a IS NULL AND nx IS NULL) THEN 'k' WHEN a IS NULL THEN 'n'
    WHEN nx IS NULL OR pe - ps >= nx THEN 'p' ELSE 'n' END AS d FROM (SELECT n.recording_id, n.i, n.run_id, n.nx, t.a, t.ps, t.pe,
    least(n.s, t.cs) AS cs, greatest(n.e, t.ce) AS ce FROM steps t JOIN numbered n ON n.recording_id = t.recording_id AND n.i = t.i + 1))),
    homes AS (SELECT n.*, h.a AS anchor_id FROM numbered n JOIN LATERAL (SELECT arg_min(t.a, t.i) AS a FROM steps t
    WHERE t.recording_id = n.recording_id AND t.i >= n.i AND t.d IN ('k', 'p')) h ON true)"""


@query("activity_runs", "SELECT recording_id, run_id, activity, start_time, end_time, observations, key_description FROM actruns")
def _(t: Tables):
    return segments.activity_runs(t.obs()).select(
        "recording_id", "run_id", "activity", "start_time", "end_time", "observations", "key_description"
    )


@query("merge_short_segments", f"{MERGED} SELECT recording_id, run_id, anchor_id FROM homes")
def _(t: Tables):
    home = segments.merge_short_segments(segments.activity_runs(t.obs()), MIN)
    return home.select("recording_id", "run_id", "anchor_id")


SEGMENTS = f"""{MERGED}, segs0 AS (SELECT recording_id, anchor_id, max(activity) FILTER (run_id = anchor_id) AS activity,
    min(s) AS start_time, max(e) AS end_time FROM homes GROUP BY 1, 2)"""


@query(
    "segments",
    f"""{SEGMENTS} SELECT s.recording_id, 'seg-' || (row_number() OVER (PARTITION BY s.recording_id ORDER BY r.start_time, r.run_id) - 1) AS id,
    s.activity, s.start_time, s.end_time, s.end_time - s.start_time AS duration, o.n AS observations, r.key_description,
    o.apps, o.topics FROM segs0 s JOIN actruns r ON r.recording_id = s.recording_id AND r.run_id = s.anchor_id
    JOIN (SELECT h.recording_id, h.anchor_id, count(*) AS n,
    array_to_string(list_sort(list_distinct(flatten(list({clean_list_sql('m.apps', apps=True)})))), '|') AS apps,
    array_to_string(list_sort(list_distinct(flatten(list({clean_list_sql('m.topics', apps=False)})))), '|') AS topics
    FROM marked m JOIN actruns a ON a.recording_id = m.recording_id AND a.run_no = m.run_no
    JOIN homes h ON h.recording_id = a.recording_id AND h.run_id = a.run_id GROUP BY 1, 2) o
    ON o.recording_id = s.recording_id AND o.anchor_id = s.anchor_id""",
)
def _(t: Tables):
    return segments.segments(t.obs(), MIN).select(
        "recording_id", "id", "activity", "start_time", "end_time", "duration", "observations", "key_description",
        F.array_join("apps", "|").alias("apps"), F.array_join("topics", "|").alias("topics"),
    )


@query(
    "segment_members",
    f"""{MERGED} SELECT m.recording_id, m.id AS observation_id, h.anchor_id FROM marked m JOIN actruns a
    ON a.recording_id = m.recording_id AND a.run_no = m.run_no JOIN homes h ON h.recording_id = a.recording_id AND h.run_id = a.run_id""",
)
def _(t: Tables):
    return segments.segment_members(t.obs(), MIN).select("recording_id", "observation_id", "anchor_id")


@query(
    "segment_context",
    f"""SELECT recording_id, run_id, array_to_string(list_sort(list_distinct(flatten(list({clean_list_sql('apps', apps=True)})))), '|') AS apps,
    array_to_string(list_sort(list_distinct(flatten(list({clean_list_sql('topics', apps=False)})))), '|') AS topics FROM
    (SELECT m.*, a.run_id FROM marked m JOIN actruns a ON a.recording_id = m.recording_id AND a.run_no = m.run_no) GROUP BY 1, 2""",
)
def _(t: Tables):
    members = segments.mark_runs(t.obs()).select("recording_id", "run_id", F.col("id").alias("observation_id"))
    out = segments.segment_context(members, t.obs(), ["recording_id", "run_id"])
    return out.select("recording_id", "run_id", F.array_join("apps", "|").alias("apps"), F.array_join("topics", "|").alias("topics"))


@query(
    "segment_stats",
    f"""{SEGMENTS} SELECT activity, count(*) AS segments, round(sum(end_time - start_time), 3) AS total_duration,
    round(avg(end_time - start_time), 3) AS avg_duration FROM segs0 GROUP BY activity""",
)
def _(t: Tables):
    stats = segments.segment_stats(segments.segments(t.obs(), MIN))
    return stats.select("activity", "segments", F.round("total_duration", 3).alias("total_duration"), F.round("avg_duration", 3).alias("avg_duration"))


def islands_sql(source: str, key: str, gap: float, ts: str = "timestamp") -> str:
    part = f"PARTITION BY {key} " if key else ""
    return (
        f"SELECT *, sum(fresh) OVER ({part}ORDER BY {ts}, id) AS block_no FROM (SELECT *, CASE WHEN {ts} - lag({ts}) OVER"
        f" ({part}ORDER BY {ts}, id) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source})"
    )


VIEWS["user_rows"] = islands_sql("obs", "recording_id", 21600.0)
VIEWS["user_blocks"] = (
    "SELECT recording_id, block_no, arg_min(id, {'t': timestamp, 'i': id}) AS block_id, min(timestamp) AS from_ts,"
    " max(timestamp) AS to_ts, max(timestamp) - min(timestamp) AS duration, count(*) AS observation_count FROM user_rows GROUP BY 1, 2"
)
VIEWS["stream_rows"] = islands_sql("obs", "", 300.0)
VIEWS["stream_blocks"] = (
    "SELECT block_no, arg_min(id, {'t': timestamp, 'i': id}) AS block_id, min(timestamp) AS from_ts,"
    " max(timestamp) AS to_ts, max(timestamp) - min(timestamp) AS duration, count(*) AS observation_count FROM stream_rows GROUP BY 1"
)
GAP = 21600.0


@query("gap_blocks", "SELECT recording_id, block_id, from_ts, to_ts, duration, observation_count FROM user_blocks")
def _(t: Tables):
    return segments.gap_blocks(t.obs(), GAP).drop("block_ts")


@query("gap_blocks_stream", "SELECT block_id, from_ts, to_ts, duration, observation_count FROM stream_blocks")
def _(t: Tables):
    return segments.gap_blocks(t.obs(), 300.0, []).drop("block_ts")


@query(
    "gap_windows",
    f"""SELECT recording_id, min(effective_ts) AS from_ts, max(effective_ts) AS to_ts, count(*) AS observation_count FROM
    ({islands_sql("(SELECT o.id, o.recording_id, coalesce(f.captured_ts, o.timestamp) AS effective_ts FROM obs o LEFT JOIN frames f ON f.id = o.frame_id)",
                  "recording_id", 43200.0, "effective_ts")}) GROUP BY recording_id, block_no HAVING count(*) >= 5""",
)
def _(t: Tables):
    timed = joins.effective_ts(t.obs(), t.frames().select("id", "captured_ts"))
    found = segments.gap_blocks(timed, 43200.0, ts="effective_ts", min_observations=5)
    return found.select("recording_id", "from_ts", "to_ts", "observation_count")


@query(
    "block_activity_counts",
    """SELECT r.recording_id, b.block_id, r.activity_type, count(*) AS n FROM user_rows r JOIN user_blocks b USING (recording_id, block_no)
    WHERE r.activity_type IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return segments.block_activity_counts(segments.mark_blocks(t.obs(), GAP)).drop("block_ts")


TOP_APPS = """SELECT recording_id, block_id, array_to_string(list(app || '(' || n || ')' ORDER BY n DESC, app)[1:2], ', ') AS top
    FROM (SELECT r.recording_id, b.block_id, r.app, count(*) AS n FROM (SELECT recording_id, block_no, unnest(apps) AS app FROM user_rows) r
    JOIN user_blocks b USING (recording_id, block_no) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("top_entries", TOP_APPS)
def _(t: Tables):
    counts = segments.block_app_counts(segments.mark_blocks(t.obs(), GAP))
    return segments.top_entries(counts, ["recording_id", "block_id"], "app", 2)


def stats_sql(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {lead}count(*) AS blocks, round(avg(duration), 4) AS avg_duration, round(avg(CASE WHEN duration < 30 THEN 100.0 ELSE 0 END), 4)"
        f" AS under_30s_percent, round(avg(CASE WHEN observation_count < 3 THEN 100.0 ELSE 0 END), 4) AS under_3_percent,"
        f" round(avg(observation_count), 4) AS avg_observations FROM {source}{tail}"
    )


def rounded(df):
    names = {"avg_duration", "under_30s_percent", "under_3_percent", "avg_observations"}
    return df.select(*[F.round(c, 4).alias(c) if c in names else F.col(c) for c in df.columns])


@query("block_stats", stats_sql("user_blocks"))
def _(t: Tables):
    return rounded(segments.block_stats(segments.gap_blocks(t.obs(), GAP)))


SWEEP = " UNION ALL ".join(
    f"SELECT CAST({g} AS DOUBLE) AS gap, max(timestamp) - min(timestamp) AS duration, count(*) AS observation_count FROM ({islands_sql('obs', '', g)}) GROUP BY block_no"
    for g in (60.0, 120.0, 300.0)
)


@query(
    "gap_sweep",
    f"""SELECT *, gap = first_value(gap) OVER (ORDER BY avg_duration * avg_observations / blocks DESC, gap) AS best
    FROM ({stats_sql(f'({SWEEP})', 'gap')})""",
)
def _(t: Tables):
    return rounded(segments.gap_sweep(t.obs()))


@query(
    "block_summary",
    """SELECT r.recording_id, b.block_id, b.from_ts, b.to_ts, b.observation_count,
    array_to_string(list_sort(list_distinct(flatten(list(r.apps)))), '|') AS apps,
    array_to_string(list_sort(list_distinct(flatten(list(r.topics)))), '|') AS topics,
    arg_min(array_to_string(r.apps, ', '), {'t': r.timestamp, 'i': r.id}) AS title, arg_min(coalesce(r.vlm_description, ''), {'t': r.timestamp, 'i': r.id}) AS summary,
    max(m.activity) AS activity, max(d.key_description) AS key_description FROM user_rows r JOIN user_blocks b USING (recording_id, block_no)
    LEFT JOIN (SELECT recording_id, block_no, arg_min(activity_type, {'n': -n, 'a': activity_type}) AS activity FROM (SELECT recording_id, block_no, activity_type,
    count(*) AS n FROM user_rows WHERE activity_type IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (recording_id, block_no)
    LEFT JOIN (SELECT recording_id, block_no, string_agg(vlm_description, '; ' ORDER BY n) FILTER (c <= 6 OR n <= 5 OR n = c) AS key_description FROM
    (SELECT *, row_number() OVER (PARTITION BY recording_id, block_no ORDER BY timestamp, id) AS n, count(*) OVER (PARTITION BY recording_id, block_no) AS c
    FROM user_rows WHERE vlm_description IS NOT NULL) GROUP BY 1, 2) d USING (recording_id, block_no) GROUP BY 1, 2, 3, 4, 5""",
)
def _(t: Tables):
    found = segments.block_summary(t.obs(), GAP)
    return found.select(
        "recording_id", "block_id", "from_ts", "to_ts", "observation_count", F.array_join("apps", "|").alias("apps"),
        F.array_join("topics", "|").alias("topics"), "title", F.coalesce("summary", F.lit("")).alias("summary"), "activity", "key_description",
    )


@query(
    "rebuild_blocks",
    "SELECT r.id, b.block_id, r.timestamp = b.from_ts AS opens FROM user_rows r JOIN user_blocks b USING (recording_id, block_no)",
)
def _(t: Tables):
    rows = segments.rebuild_blocks(t.obs(), GAP)
    return rows.select("id", "block_id", (F.col("timestamp") == F.col("block_ts")).alias("opens"))


@query(
    "compact_blocks",
    """SELECT recording_id * 10 + id % 4 AS group_id, min(from_ts) AS from_ts, max(to_ts) AS to_ts,
    round(sum(CASE WHEN id % 5 = 0 THEN 7.0 ELSE to_ts - from_ts END), 3) AS effort_seconds, count(*) AS members FROM blocks GROUP BY 1""",
)
def _(t: Tables):
    blocks = t.blocks().withColumn("effort_seconds", F.when(F.col("id") % 5 == 0, F.lit(7.0)))
    groups = t.blocks().select(F.col("id").alias("block_id"), (F.col("recording_id") * 10 + F.col("id") % 4).alias("group_id"))
    return segments.compact_blocks(blocks, groups).withColumn("effort_seconds", F.round("effort_seconds", 3))


@query(
    "fragmentation",
    """SELECT o.recording_id, o.id AS outer_id, count(*) AS inner_blocks FROM blocks i JOIN outer_blocks o
    ON o.recording_id = i.recording_id AND i.from_ts >= o.from_ts AND i.to_ts <= o.to_ts GROUP BY 1, 2""",
)
def _(t: Tables):
    from dayweave.catalog.relational import outer_blocks

    return segments.fragmentation(t.blocks(), outer_blocks(t), ["recording_id"], width=14400.0)


VIEWS["orphans"] = (
    "SELECT * FROM blocks i WHERE NOT EXISTS (SELECT 1 FROM outer_blocks o WHERE o.recording_id = i.recording_id"
    " AND i.from_ts >= o.from_ts AND i.to_ts <= o.to_ts)"
)


@query(
    "orphan_breakdown",
    """SELECT activity_type, CASE WHEN observation_count < 3 THEN 'few' WHEN to_ts - from_ts < 30 THEN 'short' ELSE 'other' END AS cause,
    count(*) AS blocks, round(sum(to_ts - from_ts), 3) AS seconds, CAST(sum(observation_count) AS BIGINT) AS observations FROM orphans GROUP BY 1, 2""",
)
def _(t: Tables):
    from dayweave.catalog.relational import outer_blocks

    lost = joins.orphan_blocks(t.blocks(), outer_blocks(t), ["recording_id"], width=14400.0)
    return segments.orphan_breakdown(lost).withColumn("seconds", F.round("seconds", 3))


@query(
    "block_diff",
    """SELECT *, round(inner_blocks / outer_blocks, 6) AS compression, CASE WHEN inner_blocks / outer_blocks > 3 AND eliminated / inner_blocks < 0.3 THEN 'promising'
    WHEN inner_blocks / outer_blocks > 2 AND eliminated / inner_blocks < 0.5 THEN 'moderate' ELSE 'aggressive' END AS verdict FROM
    (SELECT count(*) AS eliminated, count(*) FILTER (to_ts - from_ts < 30) AS too_short, count(*) FILTER (to_ts - from_ts >= 30 AND observation_count < 3) AS too_few,
    count(*) FILTER (to_ts - from_ts >= 30 AND observation_count >= 3) AS in_gap, count(*) FILTER (observation_count >= 5 AND to_ts - from_ts >= 60) AS significant,
    (SELECT count(*) FROM blocks) AS inner_blocks, (SELECT count(*) FROM outer_blocks) AS outer_blocks FROM orphans)""",
)
def _(t: Tables):
    from dayweave.catalog.relational import outer_blocks

    return segments.block_diff(t.blocks(), outer_blocks(t), ["recording_id"], width=14400.0).withColumn("compression", F.round("compression", 6))


@query(
    "activity_since",
    f"""SELECT activity, count(*) AS observations, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM
    (SELECT timestamp, {canonical_sql('activity_type')} AS activity FROM obs WHERE timestamp >= 1704672000.0) GROUP BY activity""",
)
def _(t: Tables):
    return filters.activity_since(t.obs(), 1704672000.0)


@query(
    "digest_since",
    f"""SELECT 'activity' AS kind, {canonical_sql('activity_type')} AS name, count(*) AS n FROM obs WHERE timestamp >= 1704672000.0 GROUP BY 2
    UNION ALL SELECT 'app', name, count(*) FROM (SELECT unnest(list_distinct(apps)) AS name FROM obs WHERE timestamp >= 1704672000.0) GROUP BY 2
    UNION ALL SELECT 'blocks', 'all', count(*) FROM blocks WHERE to_ts >= 1704672000.0""",
)
def _(t: Tables):
    return filters.digest_since(t.obs(), t.blocks(), filters.since_seconds("2d", 1704672000.0 + 2 * 86400))
