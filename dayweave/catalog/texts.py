"""Text jobs over answers, descriptions, names and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.catalog.sessions import activity_sql, canonical_sql
from dayweave.functions import text as tx
from dayweave.functions import vocab
from dayweave.operators import responses

JOINED = "array_to_string({}, '|')".format


def joined(column, alias=None):
    return F.array_join(column, "|").alias(alias or column)


VIEWS["described"] = "SELECT * FROM obs WHERE vlm_description IS NOT NULL AND activity_type IS NOT NULL"


def described(t: Tables):
    return t.obs().where("vlm_description is not null and activity_type is not null")


def frame_text(n: int):
    return F.concat(
        F.lit(f"Frame {n}: description: "), F.col("vlm_description"), F.lit(" | activity: "), F.col("activity_type"), F.lit(" | apps: ["),
        F.array_join("apps", ", "), F.lit("] | topics: "), F.array_join("topics", ", "), F.lit("\n"),
    )


@query(
    "parse_frame_batches",
    f"""SELECT id, frame_no, CASE WHEN frame_no = 1 OR id % 3 = 0 THEN vlm_description ELSE 'Failed to parse Frame 2' END AS description,
    CASE WHEN frame_no = 1 OR id % 3 = 0 THEN trim(activity_type) ELSE 'unknown' END AS activity,
    CASE WHEN frame_no = 1 OR id % 3 = 0 THEN {JOINED('apps')} ELSE '' END AS apps,
    CASE WHEN frame_no = 1 OR id % 3 = 0 THEN {JOINED('topics')} ELSE '' END AS topics FROM described, (SELECT unnest([1, 2]) AS frame_no)""",
)
def _(t: Tables):
    shot = lambda n: F.struct(F.lit(n).alias("index"), F.col("timestamp"), F.lit("x.jpg").alias("image_path"))
    answers = described(t).select(
        "id",
        F.concat(frame_text(1), F.when(F.col("id") % 3 == 0, frame_text(2)).otherwise("")).alias("text"),
        F.array(shot(0), shot(1)).alias("batch"),
    )
    rows = responses.parse_frame_batches(answers)
    return rows.select("id", "frame_no", "description", "activity", joined("apps"), joined("topics"))


@query(
    "parse_frame_single",
    f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'no form ' || id WHEN id % 4 = 1 THEN '' ELSE vlm_description END AS description,
    CASE WHEN id % 4 < 2 THEN 'unknown' ELSE activity_type END AS activity, CASE WHEN id % 4 < 2 THEN '' ELSE {JOINED('apps')} END AS apps,
    CASE WHEN id % 4 < 2 THEN '' ELSE {JOINED('topics')} END AS topics FROM described""",
)
def _(t: Tables):
    form = F.regexp_replace(frame_text(1), "^Frame 1: ", "")
    body = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" no form "), "id")).when(F.col("id") % 4 == 1, F.lit("  ")).otherwise(form)
    rows = responses.parse_frame_single(described(t).select("id", body.alias("text")))
    return rows.select("id", "description", "activity", joined("apps"), joined("topics"))


@query(
    "parse_activity_ranges",
    f"""SELECT id, n AS range_no, CAST(n * 3 AS INTEGER) AS start_frame, CAST(n * 3 + 2 AS INTEGER) AS end_frame, 'coding' AS activity, {JOINED('apps')} || ']' AS apps,
    {JOINED('topics')} AS topics, vlm_description AS description FROM described, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS n) WHERE n <= id % 3""",
)
def _(t: Tables):
    record = lambda i: F.concat(
        F.lit(f"Range {i + 1}: frames: [{i * 3}-{i * 3 + 2}] | activity: coding | apps: ["), F.array_join("apps", ", "), F.lit("] | topics: "),
        F.array_join("topics", ", "), F.lit(" | description: "), F.col("vlm_description"), F.lit(" \n"),
    )
    body = F.concat(F.lit("Sure.\n"), record(0), F.when(F.col("id") % 3 > 0, record(1)).otherwise(""), F.when(F.col("id") % 3 > 1, record(2)).otherwise(""))
    rows = responses.parse_activity_ranges(described(t).select("id", body.alias("text")))
    return rows.select("id", "range_no", "start_frame", "end_frame", "activity", joined("apps"), joined("topics"), "description")


def thinking(t: Tables):
    k, body = F.col("k") % 4, F.concat(F.lit("answer "), F.col("id"))
    wrapped = (
        F.when(k == 0, F.concat(F.lit("<think>plan\nmore</think>\n"), body))
        .when(k == 1, F.concat(F.lit("loose plan</think> "), body, F.lit("</think> tail")))
        .when(k == 2, F.concat(F.lit("Thinking Process: 1. look\n# "), body))
        .otherwise(body)
    )
    return t.obs0().select("id", wrapped.alias("text"))


@query(
    "strip_thinking",
    """SELECT id, CASE k % 4 WHEN 1 THEN 'tail' WHEN 2 THEN 'Thinking Process: 1. look' || chr(10) || '# answer ' || id ELSE 'answer ' || id END AS last_part,
    CASE k % 4 WHEN 2 THEN 'Thinking Process: 1. look' || chr(10) || '# answer ' || id ELSE 'answer ' || id END AS second_part,
    CASE k % 4 WHEN 2 THEN '# answer ' || id ELSE 'answer ' || id END AS clean FROM obs0""",
)
def _(t: Tables):
    body = F.col("text")
    return thinking(t).select(
        "id", tx.strip_thinking(body).alias("last_part"), tx.strip_thinking(body, keep="second").alias("second_part"), responses.clean_answer(body).alias("clean")
    )


@query(
    "parse_groups",
    """SELECT recording_id, id AS block_id, CASE WHEN id % 2 = 0 THEN 'Even work' ELSE 'Odd work' END AS label FROM blocks WHERE id % 5 > 0""",
)
def _(t: Tables):
    # One answer per block row: a line with its id, an unknown id and a missing one.
    label = F.when(F.col("id") % 2 == 0, F.lit("Even work")).otherwise(F.lit("Odd work"))
    line = F.concat(F.lit("<think>x</think>\nnoise\ngroup 1: label:  "), label, F.lit(' | blockIds: ["'), F.col("id"), F.lit("\", 'b-9', -4]"))
    answers = t.blocks().select("recording_id", F.when(F.col("id") % 5 > 0, line).otherwise(F.lit("no groups here")).alias("text"))
    return responses.parse_groups(answers, t.blocks()).select("recording_id", "block_id", "label")


@query(
    "parse_groups_by_number",
    """SELECT recording_id, id AS block_id, n AS block_no FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY from_ts, id) AS n FROM blocks)
    WHERE n IN (1, 3)""",
)
def _(t: Tables):
    answers = t.blocks().select("recording_id").distinct().withColumn("text", F.lit("Group 1: label: Main | blocks: [1, 3, x, 0, 99999]"))
    return responses.parse_groups_by_number(answers, t.blocks()).select("recording_id", "block_id", "block_no")


@query(
    "json_from_text",
    """SELECT id, CASE k % 3 WHEN 0 THEN '{"k":' || k || '}' WHEN 1 THEN '{"id":' || id || '}' END AS found FROM obs0""",
)
def _(t: Tables):
    k = F.col("k") % 3
    body = (
        F.when(k == 0, F.concat(F.lit('see {"a": } ```json\n{"k": '), F.col("k"), F.lit("}\n``` end")))
        .when(k == 1, F.concat(F.lit('broken {"x": oops} then {"id": '), F.col("id"), F.lit("} done")))
        .otherwise(F.lit("nothing {here}"))
    )
    return t.obs0().select("id", responses.json_from_text(body).alias("found"))


VIEWS["role_text"] = "SELECT conv_id * 1000 + turn AS id, text, turn % 11 AS n FROM conversations"
PHRASES = ["Fix the build", "reading guide for Spark", "in Zoom with team", "writing tests", "Browsing docs", "stack trace shown", "clicking around", "running npm",
           "code review of parser", "debug session", "quiet"]


@query(
    "extract_activity",
    f"SELECT id, {activity_sql('d')} AS label, {canonical_sql('d')} AS canonical FROM (SELECT id, {PHRASES}[n + 1] || ' ' || text AS d FROM role_text)",
)
def _(t: Tables):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("turn") % 11 + 1).cast("int"))
    rows = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(phrase, F.lit(" "), F.col("text")).alias("d"))
    return rows.select("id", tx.activity_from_description(F.col("d")).alias("label"), tx.canonical_activity(F.col("d")).alias("canonical"))


@query(
    "normalize_activity",
    f"SELECT raw_label, {canonical_sql('raw_label')} AS activity, count(*) AS n FROM labelled GROUP BY 1, 2",
)
def _(t: Tables):
    raw = F.coalesce("activity_type", tx.activity_from_description(F.col("vlm_description"))).alias("raw_label")
    labels = t.obs().where("vlm_description <> ''").groupBy(raw).agg(F.count("*").alias("n"))
    return labels.select("raw_label", tx.canonical_activity(F.col("raw_label")).alias("activity"), "n")


@query(
    "clean_apps",
    f"""SELECT id, {JOINED("[trim(x) FOR x IN apps IF length(trim(x)) BETWEEN 2 AND 50 AND NOT regexp_matches(trim(x), '(?i)^(and|a|the)[ ]')]")} AS apps FROM obs""",
)
def _(t: Tables):
    cleaned = F.filter(F.transform("apps", tx.clean_app), lambda x: x.isNotNull())
    return t.obs().select("id", joined(cleaned, "apps"))


@query(
    "normalize_apps",
    f"""SELECT id, {JOINED("list_sort(list_distinct([CASE x WHEN 'chrome' THEN 'Google Chrome' WHEN 'Ghosty' THEN 'Ghostty' ELSE x END FOR x IN apps IF x <> 'a']))")} AS apps FROM obs""",
)
def _(t: Tables):
    return t.obs().select("id", joined(tx.canonical_apps(F.col("apps")), "apps"))


PERSONAL = "|".join(a.lower() for a in vocab.PERSONAL_APPS)


@query(
    "personal_apps",
    f"""SELECT app, regexp_matches(lower(trim(app)), '{PERSONAL}') AS loose, app IN {tuple(vocab.PERSONAL_APPS)} AS exact, count(*) AS n
    FROM (SELECT unnest(apps) AS app FROM obs) GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    names = t.obs().select(F.explode("apps").alias("app")).groupBy("app").agg(F.count("*").alias("n"))
    return names.select("app", tx.is_personal_app(F.col("app")).alias("loose"), F.col("app").isin(vocab.PERSONAL_APPS).alias("exact"), "n")


HINT = "list_distinct([x FOR x IN [{}] IF x <> ''])".format


@query(
    "app_topic_hints",
    f"""SELECT id, {JOINED(f"list_sort([regexp_replace(x, ' ', '_') FOR x IN {HINT(', '.join(f'regexp_extract(lower(d), {chr(39)}{p}{chr(39)}, 1)' for p in vocab.APP_HINTS))}])")} AS apps,
    {JOINED(f"list_sort({HINT(', '.join(f'regexp_extract(lower(d), {chr(39)}{p}{chr(39)}, 1)' for p in vocab.TOPIC_HINTS))})")} AS topics FROM
    (SELECT id, vlm_description || CASE WHEN k % 2 = 0 THEN ', working on the parser, using Terminal' ELSE ' for the Atlas project in VS Code' END AS d FROM obs WHERE vlm_description <> '')""",
)
def _(t: Tables):
    d = F.concat("vlm_description", F.when(F.col("k") % 2 == 0, F.lit(", working on the parser, using Terminal")).otherwise(F.lit(" for the Atlas project in VS Code")))
    rows = t.obs().where("vlm_description <> ''").select("id", d.alias("d"))
    return rows.select("id", joined(F.array_sort(tx.app_hints(F.col("d"))), "apps"), joined(F.array_sort(tx.topic_hints(F.col("d"))), "topics"))


@query(
    "extract_urls",
    r"""SELECT page_id, array_to_string(list_sort(list_distinct([regexp_replace(u, '[.,;:!?)\]]+$', '') FOR u IN
    regexp_extract_all(url || ' ' || html || ' (' || url || ').', '(?i)(https?://[^\s<>"{}|\\^`\[\]]+)', 1)])), '|') AS urls FROM pages""",
)
def _(t: Tables):
    whole = F.concat("url", F.lit(" "), "html", F.lit(" ("), "url", F.lit(")."))
    return t.raw("pages").select("page_id", joined(tx.urls(whole), "urls"))


@query(
    "web_addresses",
    r"""SELECT DISTINCT page_id % 10 AS site, regexp_replace(u, '[.,;:!?)\]]+$', '') AS url FROM (SELECT page_id,
    unnest(list_concat(regexp_extract_all(url, '(?i)(https?://[^\s<>"{}|\\^`\[\]]+)', 1), regexp_extract_all(html, '(?i)(https?://[^\s<>"{}|\\^`\[\]]+)', 1))) AS u FROM pages)""",
)
def _(t: Tables):
    return responses.web_addresses(t.raw("pages").withColumn("site", F.col("page_id") % 10), ["site"], "url", "html")


@query(
    "media_indicators",
    """SELECT page_id, concat_ws('|', CASE WHEN contains(h, 'youtube') THEN 'youtube' END, CASE WHEN contains(h, 'vimeo') THEN 'vimeo' END,
    CASE WHEN contains(h, 'netflix') THEN 'netflix' END, CASE WHEN regexp_matches(h, '[.](png|jpg|jpeg|gif|webp)') THEN 'image-file' END) AS tags FROM
    (SELECT page_id, lower(html || CASE page_id % 4 WHEN 0 THEN ' YouTube' WHEN 1 THEN ' a.JPEG vimeo' ELSE '' END) AS h FROM pages)""",
)
def _(t: Tables):
    extra = F.when(F.col("page_id") % 4 == 0, F.lit(" YouTube")).when(F.col("page_id") % 4 == 1, F.lit(" a.JPEG vimeo")).otherwise(F.lit(""))
    return t.raw("pages").select("page_id", joined(tx.media_indicators(F.concat("html", extra)), "tags"))


@query(
    "clean_transcripts",
    """SELECT id, text FROM (SELECT id, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN trim(body || '  Please subscribe') WHEN 2 THEN 'kept' ELSE body END AS text
    FROM (SELECT conv_id * 1000 + turn AS id, turn, regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g') AS body FROM conversations)) WHERE text <> ''""",
)
def _(t: Tables):
    n = F.col("turn") % 4
    body = (
        F.when(n == 0, F.lit(" Thanks for watching "))
        .when(n == 1, F.concat("text", F.lit(" Please SUBSCRIBE Please subscribe")))
        .when(n == 2, F.lit("kept" + "this unit has twenty+ signs." * 6))
        .otherwise(F.col("text"))
    )
    rows = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("text"))
    return responses.clean_transcripts(rows)


@query(
    "normalize_ids",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url || ' (x)  [y].cap', '\s+', '-', 'g'), '[()\[\]{}]', '', 'g'),
    '-+', '-', 'g'), '^-|-$', '', 'g'), '(?i)\.cap$', '') AS session_id,
    substr(regexp_replace(regexp_replace(lower(regexp_replace(url, '\.[^/.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS file_id FROM pages""",
)
def _(t: Tables):
    return t.raw("pages").select(
        "page_id", tx.session_id(F.concat("url", F.lit(" (x)  [y].cap"))).alias("session_id"), tx.file_id(F.col("url")).alias("file_id")
    )


@query("content_hash", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t: Tables):
    return t.raw("documents").select("doc_id", tx.content_hash(F.col("text")).alias("digest"))


@query(
    "topic_samples",
    """SELECT recording_id, id, sample_no, sample FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp, id) - 1 AS sample_no,
    coalesce(nullif(vlm_description, ''), 'seen ' || k) AS sample FROM obs) WHERE sample_no < 20 AND length(sample) > 10""",
)
def _(t: Tables):
    rows = t.obs().withColumn("ocr_text", F.concat(F.lit("seen "), "k"))
    return responses.topic_samples(rows, ["recording_id"]).select("recording_id", "id", "sample_no", "sample")


@query(
    "description_stats",
    f"""SELECT recording_id, activity, count(*) AS frames, {JOINED('list_sort(list_distinct(flatten(list(apps))))')} AS apps,
    {JOINED('list_sort(list_distinct(flatten(list(topics))))')} AS topics FROM (SELECT *, {canonical_sql('activity_type')} AS activity FROM described) GROUP BY 1, 2""",
)
def _(t: Tables):
    stats = responses.description_stats(described(t), ["recording_id"])
    return stats.select("recording_id", "activity", "frames", joined("apps"), joined("topics"))


@query(
    "description_names",
    f"""WITH named AS (SELECT *, {canonical_sql('activity_type')} AS activity FROM described)
    SELECT DISTINCT recording_id, activity, 'app' AS kind, unnest(apps) AS name FROM named UNION ALL SELECT DISTINCT recording_id, activity, 'topic', unnest(topics) FROM named""",
)
def _(t: Tables):
    return responses.description_names(described(t), ["recording_id"])


@query(
    "duration_texts",
    """SELECT id, printf('%d:%02d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT)) AS clock,
    CASE WHEN s >= 3600 THEN floor(s / 3600)::BIGINT || 'h ' || floor(s % 3600 / 60)::BIGINT || 'm' WHEN s >= 60 THEN floor(s / 60)::BIGINT || 'm' ELSE floor(s)::BIGINT || 's' END AS cut,
    CASE WHEN r < 60 THEN r || 'm' WHEN r % 60 = 0 THEN (r // 60) || 'h' ELSE (r // 60) || 'h ' || (r % 60) || 'm' END AS rounded,
    CASE WHEN s >= 3600 THEN floor(s / 3600)::BIGINT || 'h ' || floor(s % 3600 / 60)::BIGINT || 'm' WHEN s >= 60 THEN floor(s / 60)::BIGINT || 'm ' || floor(s % 60)::BIGINT || 's'
    ELSE floor(s)::BIGINT || 's' END AS exact FROM (SELECT id, duration AS s, CAST(floor(duration / 60 + 0.5) AS BIGINT) AS r FROM blocks)""",
)
def _(t: Tables):
    from dayweave.functions import clock

    s = F.col("duration")
    return t.blocks().select(
        "id", clock.minutes_seconds(s).alias("clock"), clock.duration_floor(s).alias("cut"), clock.duration_rounded(s).alias("rounded"), clock.duration_exact(s).alias("exact")
    )
