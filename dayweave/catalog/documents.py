"""Reports and requests as line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.catalog.topics import members
from dayweave.functions import vocab
from dayweave.operators import reports, subjects

CUT = (
    "CASE WHEN {0} >= 3600 THEN floor({0} / 3600)::BIGINT || 'h ' || floor({0} % 3600 / 60)::BIGINT || 'm' WHEN {0} >= 60 THEN floor({0} / 60)::BIGINT || 'm'"
    " ELSE floor({0})::BIGINT || 's' END"
).format
ROUNDED = (
    "CASE WHEN {0} < 60 THEN {0} || 'm' WHEN {0} % 60 = 0 THEN ({0} // 60) || 'h' ELSE ({0} // 60) || 'h ' || ({0} % 60) || 'm' END"
).format
CLOCK = "printf('%d:%02d', CAST(floor({0} / 60) AS BIGINT), CAST(floor({0} % 60) AS BIGINT))".format
LIST = "array_to_string({}, ', ')".format

# Blocks with whole-second lengths and times from the start of the month, so that texts agree exactly.
VIEWS["plain"] = (
    "SELECT * REPLACE (floor(from_ts) - 1704067200 AS from_ts, floor(from_ts) - 1704067200 + floor(duration) AS to_ts, floor(duration) AS duration) FROM blocks"
)
VIEWS["sessions"] = (
    "SELECT recording_id AS id, sum(floor(duration)) AS duration, CAST(1704067200 + recording_id % 400 * 90000 AS DOUBLE) AS captured_at FROM blocks GROUP BY 1"
)
VIEWS["sub_parts"] = (
    "SELECT m.recording_id, id % 3 AS subject_no, m.label, coalesce(nullif(activity_type, ''), 'other') AS activity, sum(duration) AS seconds"
    " FROM members m JOIN plain b ON b.id = m.block_id GROUP BY 1, 2, 3, 4"
)
PERSONAL = "[" + ", ".join(f"'{a}'" for a in vocab.PERSONAL_APPS) + "]"
VIEWS["subs"] = (
    "SELECT p.*, a.apps, len(list_intersect(a.apps, " + PERSONAL + ")) / len(a.apps) >= 0.5 AS is_personal FROM (SELECT recording_id, subject_no, label, sum(seconds) AS duration,"
    " list({'a': activity, 's': seconds} ORDER BY seconds DESC, activity) AS acts FROM sub_parts GROUP BY 1, 2, 3) p JOIN"
    " (SELECT m.recording_id, b.id % 3 AS subject_no, list_sort(list_distinct(flatten(list(b.apps)))) AS apps FROM members m JOIN plain b ON b.id = m.block_id GROUP BY 1, 2) a"
    " USING (recording_id, subject_no)"
)
VIEWS["sess"] = (
    "SELECT s.id AS recording_id, s.duration AS length, strftime(make_timestamp(CAST(s.captured_at * 1000000 AS BIGINT)), '%A, %B %-d, %Y') AS day, t.subjects, t.personal FROM sessions s"
    " JOIN (SELECT recording_id, count(*) AS subjects, sum(CASE WHEN is_personal THEN duration ELSE 0 END) AS personal FROM subs GROUP BY 1) t ON t.recording_id = s.id"
)


def plain(t: Tables):
    start, length = F.floor("from_ts").cast("double") - 1704067200, F.floor("duration").cast("double")
    return t.blocks().withColumns({"from_ts": start, "to_ts": start + length, "duration": length})


def sessions(t: Tables):
    return t.blocks().groupBy(F.col("recording_id").alias("id")).agg(F.sum(F.floor("duration")).cast("double").alias("duration")).withColumn(
        "captured_at", (F.lit(1704067200) + F.col("id") % 400 * 90000).cast("double")
    )


def subs(t: Tables):
    return subjects.build_subjects(members(t), plain(t)).withColumn("subject_no", F.substring_index("subject_id", "-", -1).cast("long"))


FIRST = "'Worked with ' || array_to_string(apps[1:3], ', ')"
SECOND = f"'Primary activity: ' || acts[1].a || ' (' || {CUT('acts[1].s')} || ')'"


def rows_sql(source: str, key: str, part: int, lines: list[str], n: str = "0", k: int = 0) -> str:
    shown = ", ".join(f"{{'k': {i}, 'line': {x}}}" for i, x in enumerate(lines))
    return f"SELECT {key}, {part} AS part, {n} AS n, k + {k} AS k, line FROM (SELECT *, unnest([{shown}], recursive := true) FROM {source}) WHERE line IS NOT NULL"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines(df, key: str = "recording_id"):
    return df.select(key, F.col("part").cast("int").alias("part"), F.col("n").cast("long").alias("n"), F.col("k").cast("int").alias("k"), "line")


def typed(*parts: str, key: str = "recording_id") -> str:
    return f"SELECT {key}, CAST(part AS INTEGER) AS part, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, line FROM ({' UNION ALL '.join(parts)})"


TOP3 = f"array_to_string([x.a || ' ' || {CUT('x.s')} FOR x IN acts[1:3]], ', ')"


@query(
    "card",
    typed(
        rows_sql("sess", "recording_id", 0, ["'# Session Card - ' || day", "''", f"'**Total Duration:** ' || {CUT('length')}", "'**Subjects:** ' || subjects", "''"]),
        rows_sql("subs", "recording_id", 1, ["'## ' || label", f"'**' || {CUT('duration')} || '** | ' || {TOP3}", "''", f"'- ' || {FIRST}", f"'- ' || {SECOND}", "''"], "subject_no"),
        rows_sql("(SELECT * FROM sess WHERE personal > 0)", "recording_id", 2, ["'---'", f"'*Personal time: ' || {CUT('personal')} || ' (filtered)*'"]),
    ),
)
def _(t: Tables):
    return lines(reports.card_lines(subs(t), sessions(t)))


@query(
    "standup",
    typed(
        rows_sql("sess", "recording_id", 0, ["'## Standup - ' || day", "''", "'**What I did:**'"]),
        f"""SELECT recording_id, 1 AS part, subject_no AS n, k, '- ' || line AS line FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY subject_no, k) AS r
        FROM (SELECT recording_id, subject_no, unnest([{{'k': 0, 'line': {FIRST}}}, {{'k': 1, 'line': {SECOND}}}], recursive := true) FROM subs)) WHERE r <= 5""",
        rows_sql("sess", "recording_id", 2, [q(x) for x in ("", "**Key outcomes:**", "- [Add key outcomes from session]", "- [Add key outcomes from session]", "", "**Next:**", "- [Add next steps]")]),
    ),
)
def _(t: Tables):
    return lines(reports.standup_lines(subs(t), sessions(t)))


@query(
    "narrative",
    typed(
        rows_sql("sess", "recording_id", 0, ["'# Session Summary - ' || day", "''", f"'**Duration:** ' || {CUT('length')}", "''", "'## Overview'", "''",
                                             "'This session covered ' || subjects || ' main subjects.'", "''"]),
        rows_sql("subs", "recording_id", 1, ["'## ' || label", "''", f"'Spent ' || {CUT('duration')} || ' on ' || lower(label) || '.'", "''", f"'- ' || {FIRST}", f"'- ' || {SECOND}", "''"], "subject_no"),
    ),
)
def _(t: Tables):
    return lines(reports.narrative_lines(subs(t), sessions(t)))


@query("accomplishments", f"SELECT recording_id, subject_no, {FIRST} || '|' || {SECOND} AS bullets FROM subs")
def _(t: Tables):
    return subs(t).select("recording_id", "subject_no", F.array_join(reports.accomplishments(), "|").alias("bullets"))


MINUTES = "CAST(floor({} / 60 + 0.5) AS BIGINT)".format
TIMELINE = f"'- **' || {CLOCK('from_ts')} || '** (' || {ROUNDED(MINUTES('(to_ts - from_ts)'))} || '): ' || coalesce(activity_type, 'unknown') || ' — ' || {LIST('apps')}"


@query("timeline", f"SELECT recording_id, from_ts AS at, id AS block_id, {TIMELINE} AS line FROM plain")
def _(t: Tables):
    return reports.timeline_lines(plain(t)).select("recording_id", "at", "block_id", "line")


VIEWS["top_acts"] = (
    "SELECT recording_id, list(upper(a[1]) || a[2:] ORDER BY n DESC, f, a) AS acts FROM (SELECT recording_id, activity_type AS a, count(*) AS n, min(from_ts) AS f"
    " FROM plain WHERE activity_type <> '' GROUP BY 1, 2) GROUP BY 1"
)
STAMP = "make_timestamp(CAST(captured_at * 1000000 AS BIGINT))"


@query(
    "document_titles",
    f"""SELECT id AS recording_id, '[' || strftime({STAMP}, '%Y-%m-%d %H:%M') || '] ' || coalesce(acts[1], 'Session') || ' (' || {ROUNDED(MINUTES('duration'))} || ')'
    || CASE WHEN id % 2 = 0 THEN ' [card]' ELSE '' END AS title FROM sessions s LEFT JOIN top_acts a ON a.recording_id = s.id""",
)
def _(t: Tables):
    fmt = F.when(F.col("id") % 2 == 0, F.lit("card"))
    return reports.document_titles(sessions(t), plain(t), fmt).select("recording_id", "title")


HEADER = rows_sql(
    "(SELECT s.id AS recording_id, s.*, a.acts FROM sessions s LEFT JOIN top_acts a ON a.recording_id = s.id)", "recording_id", 0,
    ["'---'", f"'**Date:** ' || strftime({STAMP}, '%Y-%m-%d %H:%M:%S')", "''", f"'**Duration:** ' || {ROUNDED(MINUTES('duration'))}", "''",
     f"'**Activities:** ' || coalesce({LIST('acts')}, 'Unknown')", "''", "'**Recording ID:** `' || recording_id || '`'", "''", "'---'", "''"],
)


@query("document_header", typed(HEADER))
def _(t: Tables):
    return lines(reports.header_lines(sessions(t), plain(t)))


@query(
    "document",
    f"""SELECT recording_id, CAST(part AS INTEGER) AS part, line FROM (SELECT recording_id, part, line FROM ({HEADER}) UNION ALL
    SELECT id, 1, unnest(['## Timeline', '']) FROM sessions UNION ALL SELECT recording_id, 1, {TIMELINE} FROM plain UNION ALL
    SELECT id, 2, unnest(['', '---', '']) FROM sessions UNION ALL SELECT id, 3, unnest(['# Session Summary', '']) FROM sessions UNION ALL
    SELECT recording_id, 4, label FROM subs)""",
)
def _(t: Tables):
    summary = subs(t).select("recording_id", F.col("subject_no").alias("n"), F.col("label").alias("line"))
    return reports.document_lines(sessions(t), plain(t), summary).select("recording_id", "part", "line")


VIEWS["published"] = (
    "SELECT *, strftime(t, '%B %Y') AS month, -(year(t) * 12 + month(t)) AS month_no FROM (SELECT s.*, a.acts,"
    f" {STAMP} AS t FROM (SELECT *, id AS recording_id FROM sessions WHERE id % 3 > 0) s LEFT JOIN top_acts a ON a.recording_id = s.id)"
)


@query(
    "month_index",
    f"""SELECT CAST(month_no AS BIGINT) AS month_no, CAST(part AS INTEGER) AS part, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, line FROM (
    {rows_sql("(SELECT -1000000000 AS month_no)", "month_no", 0, ["'# Sessions'", "''"])} UNION ALL
    {rows_sql("(SELECT DISTINCT month, month_no FROM published)", "month_no", 1, ["'## ' || month", "''", "'| Date | Activities | Duration | Links |'", "'|------|------------|----------|-------|'"])} UNION ALL
    SELECT month_no, 2, id, 0, '| ' || strftime(t, '%-m/%-d/%Y') || ' | ' || coalesce({LIST('acts[1:3]')}, 'Unknown') || ' | ' || {ROUNDED(MINUTES('duration'))} || ' | ' ||
    CASE WHEN id % 2 = 0 THEN '[card](u' || id || ') · [standup](v' || id || ')' ELSE '—' END || ' |' FROM published UNION ALL
    {rows_sql("(SELECT DISTINCT month_no FROM published)", "month_no", 3, ["''"])} UNION ALL
    {rows_sql("(SELECT 1000000000 AS month_no, count(*) AS c, sum(duration) AS s FROM published)", "month_no", 4,
              ["'---'", "''", "'## Statistics'", "''", "'- **Total sessions:** ' || c", f"'- **Total duration:** ' || {ROUNDED(MINUTES('s'))}"])})""",
)
def _(t: Tables):
    rows = sessions(t).withColumn("status", F.when(F.col("id") % 3 > 0, F.lit("published")).otherwise(F.lit("raw")))
    even = rows.where("id % 2 = 0").select(F.col("id").alias("recording_id"))
    links = even.select("recording_id", F.lit("standup").alias("format"), F.concat(F.lit("v"), "recording_id").alias("url")).unionByName(
        even.select("recording_id", F.lit("card").alias("format"), F.concat(F.lit("u"), "recording_id").alias("url"))
    )
    return lines(reports.month_index_lines(rows, plain(t), "Sessions", links), "month_no")


GRADES = ", ".join(f"{{'n': -{c}, 'i': {i}, 't': '{c}'}}" for i, c in enumerate(vocab.SCORES))
PEOPLE = "(SELECT DISTINCT l_orderkey AS session_id FROM lineitem)"


def placed_sql(source: str, part: int, shown: list[str], n: str = "0", at: str = "0") -> str:
    """Lines of a session page with all their place columns."""
    entries = ", ".join(f"{{'k': {i}, 'line': {x}}}" for i, x in enumerate(shown))
    return f"SELECT session_id, {part} AS part, {n} AS n, k, {at} AS place, line FROM (SELECT *, unnest([{entries}], recursive := true) FROM {source})"


@query(
    "session_document",
    "SELECT session_id, CAST(part AS INTEGER) AS part, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, CAST(place AS DOUBLE) AS place, line FROM (" + " UNION ALL ".join([
        placed_sql(
            f"(SELECT *, array_to_string([x.t || ' (' || (-x.n) || '%)' FOR x IN list_sort([{GRADES}]) IF x.n <= -25], ' | ') AS shown FROM averaged)", 0,
            ["'# Session: ' || session_id", "''", "'**Date:** ' || strftime(make_timestamp((1704067200 + session_id) * 1000000), '%Y-%m-%d %H:%M:%S')", "'**Classification:** ' || shown", "''"],
        ),
        placed_sql("(SELECT DISTINCT id AS session_id FROM arts)", 1, ["'## Artifacts'", "''"], "-1", "-1e18"),
        placed_sql("(SELECT id AS session_id, type FROM arts)", 1, ["'- Meeting ' || upper(substr(type, 1, 1)) || substr(type, 2)"]),
        placed_sql("(SELECT DISTINCT id AS session_id FROM arts)", 2, ["''"]),
        placed_sql(PEOPLE, 3, ["'## Metadata'", "''"]),
        placed_sql(PEOPLE, 4, ["'### Speakers'"], "-1", "-1e18"),
        placed_sql("(SELECT *, l_orderkey AS session_id FROM lineitem)", 4, ["'- Speaker ' || l_linenumber || CASE WHEN l_linenumber > 3 THEN ' (host)' ELSE '' END"], "l_linenumber"),
        placed_sql(PEOPLE, 5, ["''"]),
        placed_sql(PEOPLE, 6, ["'### Key Moments'"], "-1", "-1e18"),
        placed_sql("(SELECT *, l_orderkey AS session_id FROM lineitem)", 6, [f"'- [' || {CLOCK('(l_quantity * 60)')} || '] moment'"], "l_linenumber", "l_quantity * 60"),
        placed_sql(PEOPLE, 7, ["''"]),
    ]) + ")",
)
def _(t: Tables):
    from dayweave.catalog.topics import scored

    scores = subjects.aggregate_classification(scored(t), ["session_id"], "weight")
    head = scores.withColumn("created_at", F.lit(1704067200.0) + F.col("session_id"))
    arts = t.arts().select(F.col("id").alias("session_id"), F.concat(F.lit("meeting-"), "type").alias("type"), F.lit(0).alias("n"))
    people = t.raw("lineitem").select(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("Speaker "), "l_linenumber").alias("name"), F.when(F.col("l_linenumber") > 3, F.lit("host")).otherwise(F.lit("")).alias("role"), F.col("l_linenumber").alias("n"))
    moments = t.raw("lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_quantity") * 60).alias("timestamp"), F.lit("moment").alias("description"), F.col("l_linenumber").alias("n"))
    return reports.session_document_lines(head, arts, people, moments).select("session_id", "part", "n", "k", F.col("at").alias("place"), "line")


VIEWS["heard_blocks"] = "SELECT recording_id, id, text AS said FROM obs WHERE text IS NOT NULL AND trim(text) <> ''"
VIEWS["summary_blocks"] = (
    "SELECT p.*, h.said, row_number() OVER (PARTITION BY p.recording_id ORDER BY p.from_ts, p.id) - 1 AS pos FROM plain p"
    " LEFT JOIN heard_blocks h ON h.recording_id = p.recording_id AND h.id = p.id"
)
VIEWS["summary_heads"] = (
    "SELECT recording_id, CAST(floor(s.duration / 60 + 0.5) AS BIGINT) AS minutes, c, audio, names FROM sessions s JOIN (SELECT recording_id, count(*) AS c, count(said) AS audio,"
    " array_to_string(list_sort(list_distinct(flatten(list(apps)))), ', ') AS names FROM summary_blocks GROUP BY 1) n ON n.recording_id = s.id"
)
VIEWS["summary_pages"] = (
    "SELECT DISTINCT recording_id, regexp_replace(u, '[.,;:!?)]+$', '') AS url FROM (SELECT recording_id, unnest(regexp_extract_all(x, 'https?://[^ ]+')) AS u FROM"
    " (SELECT recording_id, key_description AS x FROM plain UNION ALL SELECT recording_id, said FROM heard_blocks))"
)
NONE = "'None detected'"


@query(
    "session_summary",
    typed(
        rows_sql(
            "summary_heads", "recording_id", 0,
            ["'# Work Session Summary'", "''", "'**Recording ID:** ' || recording_id || '  '", "'**Session Duration:** ' || minutes || ' minutes  '", "'**Activities Identified:** ' || c", "''", "'## Overview'", "''",
             "'This work session consisted of ' || c || ' distinct activities over ' || minutes || ' minutes.'", "''", "'## Apps & Pages Used'", "''", "'### Applications'", f"coalesce(nullif(names, ''), {NONE})", "''", "'### Websites Visited'"],
        ),
        rows_sql("summary_pages", "recording_id", 1, ["'- ' || url"]),
        rows_sql("(SELECT * FROM summary_heads WHERE recording_id NOT IN (SELECT recording_id FROM summary_pages))", "recording_id", 1, [NONE]),
        rows_sql("summary_heads", "recording_id", 2, ["''", "'## Activities'", "''"]),
        # A line that is left out takes no number.
        f"""SELECT recording_id, 3, pos, i - 1, ls[i] FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT recording_id, pos, list_filter([
        '### ' || (pos + 1) || '. ' || upper(substr(coalesce(nullif(activity_type, ''), 'unknown'), 1, 1)) || substr(coalesce(nullif(activity_type, ''), 'unknown'), 2), '',
        '- **Time:** ' || CAST(floor(from_ts / 60 + 0.5) AS BIGINT) || ' minutes into session', '- **Duration:** ' || CAST(floor(duration / 60 + 0.5) AS BIGINT) || ' minutes',
        '- **Apps:** ' || coalesce(nullif({LIST('apps')}, ''), {NONE}), '- **Topics:** ' || coalesce(nullif({LIST('topics')}, ''), {NONE}), '', '**What was happening:**',
        coalesce(nullif(key_description, ''), '*No visual description available*'), '', CASE WHEN said IS NOT NULL THEN '**Audio transcript:**' END, CASE WHEN said IS NOT NULL THEN '```' END],
        lambda x: x IS NOT NULL) AS ls FROM summary_blocks))""",
        rows_sql("(SELECT * FROM summary_blocks WHERE said IS NOT NULL)", "recording_id", 3, ["said"], "pos", 20),
        rows_sql("(SELECT * FROM summary_blocks WHERE said IS NOT NULL)", "recording_id", 3, ["'```'", "''"], "pos", 30),
        rows_sql("summary_blocks", "recording_id", 3, ["'---'", "''"], "pos", 40),
        rows_sql("summary_heads", "recording_id", 4, ["'## Summary Statistics'", "''", "'- Total activities: ' || c", "'- Total duration: ' || minutes || ' minutes'", "'- Activities with audio: ' || audio"]),
    ),
)
def _(t: Tables):
    spoken = t.obs().where("text is not null").select("recording_id", F.col("id").alias("block_id"), F.lit(1.0).alias("transcript_start"), F.col("text").alias("line"))
    return lines(reports.session_summary_lines(plain(t), sessions(t), spoken, width=7 * 86400.0))


@query(
    "grouping_requests",
    typed(
        rows_sql("(SELECT recording_id, count(*) AS c FROM plain GROUP BY 1)", "recording_id", 0, ["c || ' work segments follow. Sort them into one to six subjects.'"]),
        rows_sql(
            "(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY from_ts, id) - 1 AS pos FROM plain)", "recording_id", 1,
            ["'BLOCK ' || (pos + 1) || ':'", f"'Time: ' || {CLOCK('from_ts')} || ' - ' || {CLOCK('to_ts')} || ' (' || {CUT('duration')} || ')'",
             "'Activity: ' || coalesce(activity_type, 'other')", "'Description: ' || coalesce(key_description, '')", f"'Apps: ' || {LIST('apps')}", f"'Topics: ' || {LIST('topics')}", "'ID: ' || id", "''"],
            "pos",
        ),
        rows_sql("(SELECT DISTINCT recording_id FROM plain)", "recording_id", 9, ["'Answer with one line per subject, using every ID once:'", "'Group 1: label: [name] | blockIds: [id, id]'"]),
    ),
)
def _(t: Tables):
    return lines(reports.grouping_requests(plain(t), width=7 * 86400.0))


@query(
    "artifact_requests",
    typed(
        rows_sql("sess", "recording_id", 0, [f"'Write a report on a work session of ' || {CUT('length')} || ' on ' || day || ' with ' || subjects || ' subjects.'"]),
        rows_sql(
            "subs", "recording_id", 1,
            ["'### Subject: ' || label", f"'**Duration:** ' || {CUT('duration')}", f"'**Activities:** ' || array_to_string([x.a || ': ' || {CUT('x.s')} FOR x IN acts], ', ')",
             f"'**Apps:** ' || {LIST('apps')}", "'**isPersonal:** ' || is_personal", "''", "'**Block Descriptions:**'"],
            "subject_no",
        ),
        f"""SELECT recording_id, 1, id % 3, 20, '- Block ' || row_number() OVER (PARTITION BY recording_id, id % 3 ORDER BY from_ts, id) || ' (' ||
        CASE WHEN duration = 0 THEN 'unknown' ELSE {CUT('duration')} END || '): ' || coalesce(key_description, '') FROM plain WHERE id % 7 > 0""",
        rows_sql("sess", "recording_id", 9, ["'Keep to the facts above.'"]),
    ),
)
def _(t: Tables):
    return lines(reports.artifact_requests(subs(t), members(t), plain(t), sessions(t), width=7 * 86400.0))


@query(
    "classification_requests",
    f"""SELECT segment_id, CAST(part AS INTEGER) AS part, line FROM (
    SELECT segment_id, 0 AS part, unnest(['Classify the segment ' || {CLOCK('a')} || ' → ' || {CLOCK('b')} || '.', 'Contexts: ' || names]) AS line FROM
    (SELECT recording_id * 4 + k % 4 AS segment_id, min(floor(timestamp) - 1704067200) AS a, max(floor(timestamp) - 1704067200) AS b,
    array_to_string(list_sort(list_distinct(list('topic: topic ' || (k % 7)))), ', ') AS names FROM obs0 GROUP BY 1)
    UNION ALL SELECT recording_id * 4 + k % 4, 1, '[' || {CLOCK('(floor(timestamp) - 1704067200)')} || '] ' || coalesce(vlm_description, 'seen ' || k) FROM obs
    UNION ALL SELECT DISTINCT recording_id * 4 + k % 4, 9, 'Give a score from 0 to 100 for meeting, debugging, tutorial, learning and working.' FROM obs)""",
)
def _(t: Tables):
    seg = (F.col("recording_id") * 4 + F.col("k") % 4).alias("segment_id")
    rows = t.obs().select("recording_id", seg, (F.floor("timestamp") - 1704067200).cast("double").alias("timestamp"), "type", "vlm_description", "text", "k", F.concat(F.lit("seen "), "k").alias("ocr_text"))
    spans = rows.groupBy("recording_id", "segment_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    names = rows.select("segment_id", F.lit("topic").alias("type"), F.concat(F.lit("topic "), F.col("k") % 7).alias("name"))
    return reports.classification_requests(spans, rows, names).select("segment_id", F.col("part").cast("int").alias("part"), "line")


@query("assemble", f"SELECT recording_id, CAST(0 AS BIGINT) AS part_no, string_agg(line, chr(10) ORDER BY k) AS content FROM ({HEADER}) GROUP BY 1")
def _(t: Tables):
    return reports.assemble(reports.header_lines(sessions(t), plain(t)))


@query(
    "request_sizes",
    f"""SELECT recording_id, chars, CAST(CASE WHEN ceil(chars / 4) + 1024 <= 4096 THEN 4096 WHEN ceil(chars / 4) + 1024 <= 8192 THEN 8192 WHEN ceil(chars / 4) + 1024 <= 16384 THEN 16384
    ELSE 32768 END AS BIGINT) AS request_size FROM (SELECT recording_id, CAST(sum(length({TIMELINE}) + 1) AS BIGINT) AS chars FROM plain GROUP BY 1)""",
)
def _(t: Tables):
    return reports.line_sizes(reports.timeline_lines(plain(t)))


@query(
    "timeline_requests",
    f"""WITH placed_blocks AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY from_ts, id) - 1 AS pos FROM plain),
    said_lines AS (SELECT recording_id, id, text AS line FROM obs WHERE text IS NOT NULL AND trim(text) <> '' AND id IN (SELECT id FROM plain)),
    body_lines AS (SELECT p.recording_id, unnest([CASE WHEN pos > 0 THEN '---' END, CASE WHEN pos > 0 THEN '' END, '### Segment ' || (pos + 1) || ': ' || coalesce(nullif(activity_type, ''), 'unknown') || ' ('
      || {CLOCK('from_ts')} || ' - ' || {CLOCK('to_ts')} || ', ' || CAST(floor(duration / 60 + 0.5) AS BIGINT) || ' minutes)', '', '**Description:**', coalesce(nullif(key_description, ''), 'No description available'), '',
      '**Apps:** ' || coalesce(nullif({LIST('apps')}, ''), 'None detected'), '**Topics:** ' || coalesce(nullif({LIST('topics')}, ''), 'None detected'), '',
      CASE WHEN s.id IS NULL THEN '*No audio transcript*' ELSE '**Audio Transcript:**' END, s.line, '']) AS line FROM placed_blocks p LEFT JOIN said_lines s ON s.id = p.id AND s.recording_id = p.recording_id),
    all_texts AS (SELECT recording_id, coalesce(key_description, '') AS x FROM plain UNION ALL SELECT recording_id, line FROM said_lines),
    page_lines AS (SELECT DISTINCT recording_id, '- ' || regexp_replace(unnest(regexp_extract_all(x, 'https?://[^\\s,)"]+')), '[.,;:!?)\\]]+$', '') AS line FROM all_texts),
    head_lines AS (SELECT s.id AS recording_id, s.duration, strftime(make_timestamp(CAST(s.captured_at * 1000000 AS BIGINT)), '%A, %B %-d, %Y') AS day, c FROM sessions s
      JOIN (SELECT recording_id, count(*) AS c FROM plain GROUP BY 1) n ON n.recording_id = s.id),
    app_lines AS (SELECT DISTINCT recording_id, '- ' || unnest(apps) AS line FROM plain)
    SELECT recording_id, CAST(part AS INTEGER) AS part, line FROM (
    SELECT recording_id, 0 AS part, unnest(['A work session of ' || CAST(floor(duration / 60 + 0.5) AS BIGINT) || ' minutes on ' || day || ' with ' || c || ' activities.', '']) AS line FROM head_lines
    UNION ALL SELECT recording_id, 1, line FROM body_lines WHERE line IS NOT NULL
    UNION ALL SELECT recording_id, 2, unnest(['', 'Applications:']) FROM head_lines
    UNION ALL SELECT recording_id, 3, line FROM app_lines
    UNION ALL SELECT recording_id, 3, 'None detected' FROM head_lines WHERE recording_id NOT IN (SELECT recording_id FROM app_lines)
    UNION ALL SELECT recording_id, 4, unnest(['', 'Pages:']) FROM head_lines
    UNION ALL SELECT recording_id, 5, line FROM page_lines
    UNION ALL SELECT recording_id, 5, 'None detected' FROM head_lines WHERE recording_id NOT IN (SELECT recording_id FROM page_lines)
    UNION ALL SELECT recording_id, 6, unnest(['', 'Summarise the session from the facts above.']) FROM head_lines)""",
)
def _(t: Tables):
    spoken = t.obs().where("text is not null").select("recording_id", F.col("id").alias("block_id"), F.lit(1.0).alias("transcript_start"), F.col("text").alias("line"))
    return reports.timeline_requests(plain(t), sessions(t), spoken).select("recording_id", F.col("part").cast("int").alias("part"), "line")


# One session per recording, graded by its number.
VIEWS["graded"] = (
    "SELECT DISTINCT recording_id AS session_id, recording_id % 100 AS meeting, recording_id * 7 % 100 AS debugging, 10 AS tutorial, 30 AS learning, 0 AS working,"
    " CASE WHEN recording_id % 2 = 0 THEN 'de' END AS language, CASE WHEN recording_id % 3 = 0 THEN '{\"speakers\":[]}' END AS metadata FROM obs0"
)
SCORED = "concat_ws(', ', CASE WHEN meeting >= 25 THEN 'meeting: ' || meeting || '%' END, CASE WHEN debugging >= 25 THEN 'debugging: ' || debugging || '%' END, 'learning: 30%')"
SEGMENT_LINES = "SELECT recording_id AS session_id, 1 AS part, '[' || id || 's - ' || (id + 5) || 's] ' || coalesce(activity_type, '') AS line FROM obs WHERE k % 2 = 0"


def graded(t: Tables):
    r = F.col("recording_id")
    return t.obs0().select("recording_id").distinct().select(
        r.alias("session_id"), (r % 100).alias("meeting"), (r * 7 % 100).alias("debugging"), F.lit(10).alias("tutorial"), F.lit(30).alias("learning"), F.lit(0).alias("working"),
        F.when(r % 2 == 0, "de").alias("language"), F.when(r % 3 == 0, '{"speakers":[]}').alias("metadata"),
    )


def session_rows(t: Tables):
    rows = t.obs().withColumn("session_id", F.col("recording_id"))
    said = rows.where("k % 2 = 0").select("session_id", F.col("id").alias("n"), F.col("id").cast("double").alias("start"), (F.col("id") + 5).cast("double").alias("end"), F.col("activity_type").alias("text"))
    seen = rows.where("k % 2 = 1").select(
        "session_id", F.col("id").alias("n"), F.col("id").cast("double").alias("timestamp"), F.when(F.col("k") % 3 == 0, "screen").alias("label"),
        F.col("activity_type").alias("description"), F.when(F.col("k") % 5 == 0, F.repeat(F.lit("ab "), 50)).alias("ocr"),
    )
    return said, seen


def lists_sql(shown: str, head: str, tail: str) -> str:
    """A session request as (session_id, part, line)."""
    seen = f"SELECT recording_id, 3, '[' || id || 's] ' || {shown} FROM obs WHERE k % 2 = 1"
    return f"""SELECT session_id, CAST(part AS INTEGER) AS part, line FROM (SELECT session_id, 0 AS part, unnest([{head}, '', 'Transcript:']) AS line FROM graded
    UNION ALL {SEGMENT_LINES} UNION ALL SELECT session_id, 1, 'N/A' FROM graded WHERE session_id NOT IN (SELECT recording_id FROM obs WHERE k % 2 = 0)
    UNION ALL SELECT session_id, 2, unnest(['', 'On screen:']) FROM graded
    UNION ALL {seen} UNION ALL SELECT session_id, 3, 'N/A' FROM graded WHERE session_id NOT IN (SELECT recording_id FROM obs WHERE k % 2 = 1)
    UNION ALL SELECT session_id, 4, unnest(['', {tail}]) FROM graded)"""


@query(
    "metadata_requests",
    lists_sql(
        "CASE WHEN k % 3 = 0 THEN '[screen]' ELSE '' END || CASE WHEN activity_type <> '' THEN ': ' || activity_type ELSE '' END || CASE WHEN k % 5 = 0 THEN ' (OCR: ' || substr(repeat('ab ', 50), 1, 100) || ')' ELSE '' END",
        f"'A session classified as ' || {SCORED} || '.'", "'Name its speakers, key moments, action items and technical terms.'",
    ),
)
def _(t: Tables):
    return reports.metadata_requests(graded(t), *session_rows(t)).select("session_id", F.col("part").cast("int").alias("part"), "line")


@query(
    "document_requests",
    lists_sql(
        "coalesce(nullif(activity_type, ''), 'Action on screen')", f"'Write the card of a session classified as ' || {SCORED} || ' in ' || coalesce(language, 'en') || '.'",
        "'Metadata: ' || coalesce(metadata, 'N/A')",
    ),
)
def _(t: Tables):
    return reports.document_requests(graded(t), *session_rows(t), "card").select("session_id", F.col("part").cast("int").alias("part"), "line")
