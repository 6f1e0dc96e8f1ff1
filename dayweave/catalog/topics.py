"""Subjects, contexts, classification scores, clusters and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.functions import text as tx
from dayweave.functions import vocab
from dayweave.operators import joins, subjects

PERSONAL = "(" + ", ".join(f"'{a}'" for a in vocab.PERSONAL_APPS) + ")"
PERSONAL_LIST = PERSONAL.replace("(", "[").replace(")", "]")
JOINED = "array_to_string({}, '|')".format


def joined(column, alias=None):
    return F.array_join(column, "|").alias(alias or column)


VIEWS["members"] = (
    "SELECT recording_id, 'subject-' || recording_id || '-' || (id % 3) AS subject_id, 'Topic ' || (id % 3) AS label, id AS block_id FROM blocks WHERE id % 7 > 0"
)


def members(t: Tables):
    n = F.col("id") % 3
    return t.blocks().where("id % 7 > 0").select(
        "recording_id", F.concat_ws("-", F.lit("subject"), "recording_id", n).alias("subject_id"), F.concat(F.lit("Topic "), n).alias("label"), F.col("id").alias("block_id")
    )


def subjects_sql(source: str, personal: str) -> str:
    return (
        f"SELECT p.recording_id, p.subject_id, p.label, round(sum(p.seconds), 3) AS duration, CAST(sum(p.n) AS BIGINT) AS blocks,"
        f" string_agg(p.activity || '=' || CAST(floor(p.seconds + 0.05) AS BIGINT), '|' ORDER BY p.activity) AS breakdown, any_value(a.apps) AS apps,"
        f" any_value({personal}) AS is_personal FROM (SELECT recording_id, subject_id, label, coalesce(nullif(activity_type, ''), 'other') AS activity,"
        f" sum(duration) AS seconds, count(*) AS n FROM {source} GROUP BY 1, 2, 3, 4) p JOIN (SELECT recording_id, subject_id,"
        f" {JOINED('list_sort(list_distinct(flatten(list(apps))))')} AS apps, list_distinct(flatten(list(apps))) AS names FROM {source} GROUP BY 1, 2) a"
        f" USING (recording_id, subject_id) GROUP BY 1, 2, 3"
    )


def shown(df):
    breakdown = F.transform(F.array_sort(F.map_entries("activity_breakdown")), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] + 0.05)))
    return df.select(
        "recording_id", "subject_id", "label", F.round("duration", 3).alias("duration"), "blocks", joined(breakdown, "breakdown"), joined("apps"), "is_personal"
    )


VIEWS["grouped"] = "SELECT m.subject_id, m.label, b.* FROM members m JOIN blocks b ON b.id = m.block_id"
SHARE = f"len(list_intersect(names, {PERSONAL_LIST})) / len(names) >= 0.5"


@query("build_subjects", subjects_sql("grouped", SHARE))
def _(t: Tables):
    return shown(subjects.build_subjects(members(t), t.blocks()))


VIEWS["flagged"] = f"SELECT *, len(list_intersect(apps, {PERSONAL_LIST})) > 0 AS p FROM blocks"
VIEWS["flag_runs"] = (
    "SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY from_ts, id) - 1 AS n FROM (SELECT *, CASE WHEN p = lag(p) OVER"
    " (PARTITION BY recording_id ORDER BY from_ts, id) THEN 0 ELSE 1 END AS fresh FROM flagged)"
)
VIEWS["fallback"] = (
    "SELECT *, 'subject-' || recording_id || '-' || n AS subject_id, CASE WHEN p THEN 'Personal' ELSE 'Work Session' END AS label FROM flag_runs"
)


@query("fallback_subjects", subjects_sql("fallback", "p.label = 'Personal'"))
def _(t: Tables):
    return shown(subjects.fallback_subjects(t.blocks(), width=7 * 86400.0))


@query(
    "grouped_members",
    "SELECT recording_id, 'subject-' || recording_id || '-' || (dense_rank() OVER (PARTITION BY recording_id ORDER BY id % 2) - 1) AS subject_id, id AS block_id FROM blocks",
)
def _(t: Tables):
    groups = t.blocks().select("recording_id", (F.col("id") % 2 * 4 + 1).alias("line_no"), F.lit("x").alias("label"), F.col("id").alias("block_id"))
    return subjects.grouped_members(groups).select("recording_id", "subject_id", "block_id")


@query("detect_personal", f"SELECT id, len(list_intersect(list_distinct(apps), {PERSONAL_LIST})) / len(list_distinct(apps)) >= 0.5 AS personal FROM blocks")
def _(t: Tables):
    return t.blocks().select("id", tx.personal_share_flag(F.col("apps")).alias("personal"))


@query(
    "personal_work_split",
    f"""SELECT recording_id, round(sum(CASE WHEN is_personal THEN duration ELSE 0 END), 2) AS personal_seconds,
    round(sum(CASE WHEN is_personal THEN 0 ELSE duration END), 2) AS work_seconds FROM ({subjects_sql('fallback', "p.label = 'Personal'")}) GROUP BY 1""",
)
def _(t: Tables):
    split = subjects.personal_work_split(subjects.fallback_subjects(t.blocks(), width=7 * 86400.0))
    return split.select("recording_id", F.round("personal_seconds", 2).alias("personal_seconds"), F.round("work_seconds", 2).alias("work_seconds"))


@query(
    "upsert_contexts",
    """WITH named AS (SELECT 'app' AS type, unnest(apps) AS name FROM blocks UNION SELECT 'topic', unnest(topics) FROM blocks)
    SELECT n.type, n.name, c.id IS NOT NULL AS known FROM named n LEFT JOIN contexts c ON c.type = n.type AND c.name = n.name""",
)
def _(t: Tables):
    from dayweave.catalog.relational import contexts

    rows = subjects.upsert_contexts(t.blocks(), contexts(t))
    return rows.select("type", "name", (F.col("id") == F.col("id") % 7).alias("known"))


@query(
    "segment_contexts",
    "SELECT b.recording_id, b.id AS segment_id, c.id AS context_id FROM (SELECT recording_id, id, unnest(list_distinct(topics)) AS name FROM blocks) b JOIN contexts c USING (name)",
)
def _(t: Tables):
    from dayweave.catalog.relational import contexts

    return subjects.segment_contexts(t.blocks(), contexts(t))


VIEWS["talks"] = (
    "SELECT w.segment_id, w.start_time, w.end_time, count(a.id) AS transcripts, count(*) FILTER (a.audio_source = 'mic') AS mic,"
    " count(*) FILTER (a.audio_source = 'system') AS system FROM windows w LEFT JOIN (SELECT *, timestamp AS s, coalesce(end_timestamp, timestamp + 5) AS e"
    " FROM audio WHERE length(trim(text)) > 0) a ON a.recording_id = w.recording_id AND w.start_time < a.e AND a.s < w.end_time"
    " AND least(w.end_time, a.e) - greatest(w.start_time, a.s) >= 1 GROUP BY 1, 2, 3"
)


@query(
    "alignment_stats",
    """SELECT count(*) AS segments, count(*) FILTER (transcripts > 0) AS with_audio, CAST(sum(transcripts) AS BIGINT) AS transcripts, CAST(sum(mic) AS BIGINT) AS mic,
    CAST(sum(system) AS BIGINT) AS system, round(avg(transcripts), 6) AS avg_per_segment FROM talks""",
)
def _(t: Tables):
    counts = joins.alignment_counts(t.windows(), joins.align_transcripts(t.windows(), t.audio()))
    return subjects.alignment_stats(counts).withColumn("avg_per_segment", F.round("avg_per_segment", 6))


@query(
    "topic_blocks",
    "SELECT segment_id AS id, start_time AS from_ts, end_time AS to_ts, end_time - start_time AS duration, transcripts AS transcript_count, transcripts > 0 AS has_transcript FROM talks",
)
def _(t: Tables):
    segs = t.windows().select(
        "*", F.lit("talk").alias("activity"), F.lit("").alias("key_description"), (F.col("end_time") - F.col("start_time")).alias("duration"),
        F.array(F.lit("Zoom")).alias("apps"), F.array(F.lit("x")).alias("topics"),
    )
    rows = subjects.topic_blocks(segs, joins.alignment_counts(t.windows(), joins.align_transcripts(t.windows(), t.audio())))
    return rows.select("id", "from_ts", "to_ts", "duration", "classification.transcript_count", "classification.has_transcript")


VIEWS["scored"] = (
    "SELECT l_orderkey AS session_id, l_suppkey % 101 AS meeting, l_partkey % 97 AS debugging, CAST(l_discount * 1000 AS BIGINT) AS tutorial,"
    " CAST(l_tax * 1000 AS BIGINT) AS learning, l_linenumber * 14 AS working, l_quantity AS weight FROM lineitem"
)


def scored(t: Tables):
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_suppkey") % 101).alias("meeting"), (F.col("l_partkey") % 97).alias("debugging"),
        F.round(F.col("l_discount") * 1000).cast("long").alias("tutorial"), F.round(F.col("l_tax") * 1000).cast("long").alias("learning"),
        (F.col("l_linenumber") * 14).alias("working"), F.col("l_quantity").alias("weight"),
    )


AVERAGED = ", ".join(f"CAST(floor(sum({c} * weight) / sum(weight) + 0.5) AS BIGINT) AS {c}" for c in vocab.SCORES)
VIEWS["averaged"] = f"SELECT session_id, {AVERAGED} FROM scored GROUP BY 1"


@query("aggregate_classification", "SELECT * FROM averaged")
def _(t: Tables):
    return subjects.aggregate_classification(scored(t), ["session_id"], "weight")


@query(
    "primary_type",
    f"""SELECT session_id, CASE WHEN top >= 25 THEN CASE top {' '.join(f"WHEN {c} THEN '{c}'" for c in vocab.SCORES)} END END AS primary_type, debugging >= 50 AS is_debugging,
    concat_ws('|', {', '.join(f"CASE WHEN {c} >= 25 THEN '{c}' END" for c in vocab.SCORES)}) AS significant FROM
    (SELECT *, greatest({', '.join(vocab.SCORES)}) AS top FROM averaged)""",
)
def _(t: Tables):
    rows = subjects.aggregate_classification(scored(t), ["session_id"], "weight")
    return rows.select("session_id", subjects.primary_type().alias("primary_type"), subjects.has_type("debugging").alias("is_debugging"), joined(subjects.significant_types(), "significant"))


@query(
    "top_activities",
    """SELECT recording_id, array_to_string(list(upper(a[1]) || a[2:] ORDER BY n DESC, f, a)[1:3], '|') AS activities FROM (SELECT recording_id, activity_type AS a,
    count(*) AS n, min(from_ts) AS f FROM blocks WHERE activity_type <> '' GROUP BY 1, 2) GROUP BY 1""",
)
def _(t: Tables):
    return subjects.top_activities(t.blocks(), 3).select("recording_id", joined("activities"))


@query(
    "cluster_metadata",
    """SELECT recording_id, cluster_id, any_value(c) AS frame_count, max(id) FILTER (n = c // 2) AS representative_id, min(timestamp) AS from_ts, max(timestamp) AS to_ts,
    round(avg(length(txt)), 6) AS avg_ocr_characters, concat_ws('|', CASE WHEN bool_or(k % 6 = 0) THEN 'image-file' END, CASE WHEN bool_or(k % 10 = 3) THEN 'youtube' END) AS tags FROM
    (SELECT *, k % 4 AS cluster_id, 'seen ' || k || CASE WHEN k % 6 = 0 THEN ' a.png' WHEN k % 10 = 3 THEN ' YouTube' ELSE '' END AS txt,
    row_number() OVER (PARTITION BY recording_id, k % 4 ORDER BY timestamp, id) - 1 AS n, count(*) OVER (PARTITION BY recording_id, k % 4) AS c FROM obs0) GROUP BY 1, 2""",
)
def _(t: Tables):
    k = F.col("k")
    tail = F.when(k % 6 == 0, F.lit(" a.png")).when(k % 10 == 3, F.lit(" YouTube")).otherwise(F.lit(""))
    rows = t.obs0().select("recording_id", (k % 4).alias("cluster_id"), "id", "timestamp", F.concat(F.lit("seen "), k, tail).alias("ocr_text"))
    return subjects.cluster_metadata(rows).select(
        "recording_id", "cluster_id", "frame_count", "representative_id", "from_ts", "to_ts", F.round("avg_ocr_characters", 6).alias("avg_ocr_characters"), joined("media_indicators", "tags")
    )


@query(
    "entity_rollup",
    """SELECT 'app' AS entity_kind, app AS entity_value, count(*) AS mentions, count(DISTINCT id) AS observations, round(avg(k / 100), 6) AS avg_confidence
    FROM (SELECT id, k, unnest(apps) AS app FROM obs) WHERE k / 100 >= 0.25 GROUP BY 2""",
)
def _(t: Tables):
    entities = t.obs().select(
        F.col("id").alias("observation_id"), F.lit("app").alias("entity_kind"), F.explode("apps").alias("entity_value"), (F.col("k") / 100).alias("confidence")
    )
    return subjects.entity_rollup(entities, "app", 0.25).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "group_rollup",
    """SELECT group_id, CAST(sum(b) AS BIGINT) AS blocks, round(sum(s), 3) AS seconds, array_to_string(list(a || '(' || n || ')' ORDER BY n DESC, a)[1:3], ', ') AS activities FROM
    (SELECT recording_id % 10 AS group_id, coalesce(activity_type, 'other') AS a, count(*) AS b, sum(duration) AS s, CAST(sum(observation_count) AS BIGINT) AS n FROM blocks WHERE id % 7 > 0 GROUP BY 1, 2) GROUP BY 1""",
)
def _(t: Tables):
    groups = members(t).select((F.col("recording_id") % 10).alias("group_id"), "block_id")
    return subjects.group_rollup(groups, t.blocks()).withColumn("seconds", F.round("seconds", 3))


@query("unassigned_blocks", "SELECT id FROM blocks WHERE id % 7 = 0")
def _(t: Tables):
    return subjects.unassigned_blocks(members(t), t.blocks()).select("id")


@query(
    "recording_frame_counts",
    """SELECT r.id, coalesce(n, 0) AS frames FROM recs r LEFT JOIN (SELECT recording_id, count(*) AS n FROM obs WHERE frame_id IS NOT NULL GROUP BY 1) o ON o.recording_id = r.id
    WHERE r.status = 'processed'""",
)
def _(t: Tables):
    rows = t.obs().withColumn("image_path", F.concat(F.lit("f/"), "frame_id"))
    return subjects.recording_frame_counts(t.recs(), rows).select("id", "frames")
