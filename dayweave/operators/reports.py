"""Cards, stand-ups, narratives, timelines, indexes and model requests as tables of lines.

Every report is a table ``(keys, part, n, k, at, line)``; sorting a document by the four place columns
gives its text. Lines are produced where their row lives, so a recording with very many blocks never
has to fit into one task; :func:`assemble` joins lines to texts, a long document to several,
and ``sources.tables.write_documents`` writes documents of any size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.functions import clock
from dayweave.functions.numbers import half_up, request_size
from dayweave.functions.text import capitalise, title_words, urls
from dayweave.operators.subjects import significant_types, top_activities
from dayweave.plans import ordered

PLACE = ["part", "n", "k", "at"]
REC = ["recording_id"]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _lines(df: DataFrame, keys: Sequence[str], part: int, lines: Sequence, *, n: Column | None = None, at: Column | None = None, k: int = 0) -> DataFrame:
    """Explode ``lines`` (columns or strings; null lines are left out) of every row."""
    shown = F.array_compact(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines]))
    rows = df.select(
        *keys,
        F.lit(part).alias("part"),
        (F.lit(0) if n is None else n).cast("long").alias("n"),
        (F.lit(0.0) if at is None else at).cast("double").alias("at"),
        F.posexplode(shown).alias("k", "line"),
    )
    return rows.withColumn("k", F.col("k") + k).select(*keys, *PLACE, "line")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def line_sizes(lines: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Characters of every document, line ends included, and its request size step."""
    return lines.groupBy(*keys).agg(F.sum(F.length("line") + 1).alias("chars")).withColumn(
        "request_size", request_size(F.col("chars"), 131072)
    )


def assemble(lines: DataFrame, keys: Sequence[str] = REC, *, part_chars: int = 4 * 131072, together: int = 1000) -> DataFrame:
    """Every document as text: ``(keys, part_no, content)``.

    A document of up to ``part_chars`` characters (what the largest request can hold) is one part, a longer
    one several; its parts in order, joined by line feeds, are the whole document. Lines are counted in
    groups of ``together`` places first, so the lines of a long document are not ordered in one task.
    """
    keys = list(keys)
    rows = lines.withColumn("_group", F.floor(F.col("n") / together)).withColumn("_size", F.length("line") + 1)
    group = [*keys, "part", "_group"]
    sizes = rows.groupBy(*group).agg(F.sum("_size").alias("_chars"))
    before = Window.partitionBy(*keys).orderBy("part", "_group").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select(*group, F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group).orderBy(*PLACE, "line").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_end", F.sum("_size").over(inside)).join(heads, group)
    # The part a line belongs to is the one its first character lies in.
    number = F.floor((F.col("_before") + F.col("_end") - F.col("_size")) / part_chars).cast("long")
    entries = F.array_sort(F.collect_list(F.struct(*PLACE, "line")))
    parts = placed.groupBy(*keys, number.alias("_part")).agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("content"))
    # A line longer than a part leaves numbers out.
    in_order = Window.partitionBy(*keys).orderBy("_part")
    return parts.select(*keys, (F.row_number().over(in_order) - 1).cast("long").alias("part_no"), "content")


def long_date(seconds: Column) -> Column:
    """``Monday, January 1, 2024`` of epoch seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "EEEE, MMMM d, yyyy")


def ranked_activities(breakdown: Column) -> Column:
    """Entries of an activity map, longest first."""
    entries = F.transform(F.map_entries(breakdown), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("a")))
    return F.array_sort(entries)


def accomplishments() -> Column:
    """Up to two bullets of a subject: its first three applications and its longest activity."""
    apps = F.when(F.size("apps") > 0, _text("Worked with ", F.array_join(F.slice("apps", 1, 3), ", ")))
    top = F.get(ranked_activities(F.col("activity_breakdown")), 0)
    main = F.when(F.size("activity_breakdown") > 0, _text("Primary activity: ", top["a"], " (", clock.duration_floor(-top["s"]), ")"))
    return F.array_compact(F.array(apps, main))


def _numbered_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.withColumn("bullets", accomplishments()).withColumn("n", F.col("subject_no"))


def _sessions(subjects: DataFrame, recordings: DataFrame) -> DataFrame:
    totals = subjects.groupBy(*REC).agg(
        F.count("*").alias("subjects"), F.sum(F.when(F.col("is_personal"), F.col("duration")).otherwise(0.0)).alias("personal")
    )
    heads = recordings.select(F.col("id").alias("recording_id"), F.col("duration").alias("length"), "captured_at")
    return heads.join(totals, REC)


def card_lines(subjects: DataFrame, recordings: DataFrame) -> DataFrame:
    """Session card: totals, then per subject its three longest activities and bullets."""
    top = F.transform(F.slice(ranked_activities(F.col("activity_breakdown")), 1, 3), lambda e: F.concat(e["a"], F.lit(" "), clock.duration_floor(-e["s"])))
    shown = F.when(F.size("activity_breakdown") > 0, F.array_join(top, ", ")).otherwise(F.lit("various"))
    sessions = _sessions(subjects, recordings)
    bullet = lambda i: _text("- ", F.get("bullets", i))
    head = _lines(
        sessions, REC, 0,
        [_text("# Session Card - ", long_date(F.col("captured_at"))), "", _text("**Total Duration:** ", clock.duration_floor(F.col("length"))),
         _text("**Subjects:** ", F.col("subjects").cast("string")), ""],
    )
    body = _lines(
        _numbered_subjects(subjects), REC, 1,
        [_text("## ", F.col("label")), _text("**", clock.duration_floor(F.col("duration")), "** | ", shown), "", bullet(0), bullet(1), ""], n=F.col("n"),
    )
    foot = _lines(
        sessions.where("personal > 0"), REC, 2, ["---", _text("*Personal time: ", clock.duration_floor(F.col("personal")), " (filtered)*")]
    )
    return _union([head, body, foot])


def standup_lines(subjects: DataFrame, recordings: DataFrame, bullets: int = 5) -> DataFrame:
    """Stand-up: the first bullets over all subjects and the fixed sections."""
    sessions = _sessions(subjects, recordings)
    head = _lines(sessions, REC, 0, [_text("## Standup - ", long_date(F.col("captured_at"))), "", "**What I did:**"])
    every = _numbered_subjects(subjects).select(*REC, "n", F.posexplode("bullets").alias("k", "line"))
    # The limit per recording is applied before the shuffle as well, so few rows move.
    first = Window.partitionBy(*REC).orderBy("n", "k")
    did = every.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= bullets).select(
        *REC, F.lit(1).alias("part"), F.col("n").cast("long").alias("n"), "k", F.lit(0.0).alias("at"), _text("- ", F.col("line")).alias("line")
    )
    foot = _lines(
        sessions, REC, 2,
        ["", "**Key outcomes:**", "- [Add key outcomes from session]", "- [Add key outcomes from session]", "", "**Next:**", "- [Add next steps]"],
    )
    return _union([head, did, foot])


def narrative_lines(subjects: DataFrame, recordings: DataFrame) -> DataFrame:
    """Overview and a short paragraph per subject."""
    sessions = _sessions(subjects, recordings)
    head = _lines(
        sessions, REC, 0,
        [_text("# Session Summary - ", long_date(F.col("captured_at"))), "", _text("**Duration:** ", clock.duration_floor(F.col("length"))), "", "## Overview", "",
         _text("This session covered ", F.col("subjects").cast("string"), " main subjects."), ""],
    )
    bullet = lambda i: _text("- ", F.get("bullets", i))
    body = _lines(
        _numbered_subjects(subjects), REC, 1,
        [_text("## ", F.col("label")), "", _text("Spent ", clock.duration_floor(F.col("duration")), " on ", F.lower("label"), "."), "", bullet(0), bullet(1), ""],
        n=F.col("n"),
    )
    return _union([head, body])


def timeline_lines(blocks: DataFrame) -> DataFrame:
    """``- **m:ss** (duration): activity — apps`` for every block, by start."""
    activity = F.coalesce("activity_type", F.lit("unknown"))
    apps = F.array_join("apps", ", ")
    start, end = F.coalesce("from_ts", F.lit(0.0)), F.coalesce("to_ts", F.lit(0.0))
    line = _text(
        "- **", clock.minutes_seconds(start), "** (", clock.duration_rounded(end - start), "): ", activity, F.when((apps != "") & (apps != "none"), _text(" — ", apps)).otherwise(F.lit(""))
    )
    return _lines(blocks, REC, 1, [line], n=F.col("id"), at=start).select(*REC, F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), "at", F.col("n").alias("block_id"), "line")


def document_titles(recordings: DataFrame, blocks: DataFrame, fmt: Column | None = None) -> DataFrame:
    """``[date hh:mm] Primary activity (duration) [format]`` and the header lines' values."""
    first = top_activities(blocks, None)
    heads = recordings.select(F.col("id").alias("recording_id"), "duration", "captured_at", *([fmt.alias("format")] if fmt is not None else []))
    rows = heads.join(first, REC, "left")
    primary = F.coalesce(F.get("activities", 0), F.lit("Session"))
    stamp = F.date_format(F.timestamp_seconds("captured_at"), "yyyy-MM-dd HH:mm")
    suffix = F.coalesce(_text(" [", F.col("format"), "]"), F.lit("")) if fmt is not None else F.lit("")
    return rows.withColumn("title", F.concat(_text("[", stamp, "] ", primary, " (", clock.duration_rounded(F.col("duration")), ")"), suffix))


def header_lines(recordings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Metadata lines before the timeline of a published document."""
    rows = document_titles(recordings, blocks)
    names = F.coalesce(F.nullif(F.array_join("activities", ", "), F.lit("")), F.lit("Unknown"))
    return _lines(
        rows, REC, 0,
        ["---", _text("**Date:** ", F.date_format(F.timestamp_seconds("captured_at"), "yyyy-MM-dd HH:mm:ss")), "",
         _text("**Duration:** ", clock.duration_rounded(F.col("duration"))), "", _text("**Activities:** ", names), "",
         _text("**Recording ID:** `", F.col("recording_id").cast("string"), "`"), "", "---", ""],
    )


def document_lines(recordings: DataFrame, blocks: DataFrame, summary: DataFrame) -> DataFrame:
    """Whole published document: header, timeline, summary lines ``(recording_id, n, line)``."""
    owners = blocks.select(*REC).distinct()
    title = _lines(owners, REC, 1, ["## Timeline", ""]).withColumn("k", F.lit(-1))
    rule = _lines(owners, REC, 2, ["", "---", ""])
    times = timeline_lines(blocks).select(*REC, "part", F.lit(1).cast("long").alias("n"), "k", "at", "line")
    text = summary.select(*REC, F.lit(4).alias("part"), F.col("n").cast("long").alias("n"), F.lit(0).alias("k"), F.lit(0.0).alias("at"), "line")
    head = _lines(summary.select(*REC).distinct(), REC, 3, ["# Session Summary", ""])
    return _union([header_lines(recordings, blocks), title, times, rule, head, text])


def month_index_lines(recordings: DataFrame, blocks: DataFrame, title: str, links: DataFrame | None = None) -> DataFrame:
    """Index of published recordings by month, newest first, with totals.

    ``part`` counts months downwards from the newest, so the lines of different months are independent.
    ``links`` has one row per recording and format: ``(recording_id, format, url)``.
    """
    rows = recordings.where("status = 'published'").select(F.col("id").alias("recording_id"), "duration", "captured_at")
    day = F.timestamp_seconds("captured_at")
    rows = rows.join(top_activities(blocks, 3), REC, "left")
    if links is not None:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("format", "url"))), lambda e: F.concat(F.lit("["), e["format"], F.lit("]("), e["url"], F.lit(")"))), " · ")
        rows = rows.join(links.groupBy(*REC).agg(joined.alias("_links")), REC, "left")
    else:
        rows = rows.withColumn("_links", F.lit(None).cast("string"))
    names = F.coalesce(F.nullif(F.array_join("activities", ", "), F.lit("")), F.lit("Unknown"))
    month_no = -(F.year(day) * 12 + F.month(day))
    rows = rows.withColumn("month_no", month_no.cast("long")).withColumn("month", F.date_format(day, "MMMM yyyy"))
    line = _text(
        "| ", F.date_format(day, "M/d/yyyy"), " | ", names, " | ", clock.duration_rounded(F.col("duration")), " | ", F.coalesce("_links", F.lit("—")), " |"
    )
    body = rows.select("month_no", F.lit(2).alias("part"), F.col("recording_id").cast("long").alias("n"), F.lit(0).alias("k"), (-F.col("captured_at")).alias("at"), line.alias("line"))
    months = rows.select("month_no", "month").distinct()
    key = ["month_no"]
    head = _lines(months, key, 1, [_text("## ", F.col("month")), "", "| Date | Activities | Duration | Links |", "|------|------------|----------|-------|"])
    tail = _lines(months, key, 3, [""])
    totals = rows.agg(F.count("*").alias("c"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("s"))
    first = _lines(totals.withColumn("month_no", F.lit(-(10**9)).cast("long")), key, 0, [f"# {title}", ""])
    last = _lines(
        totals.withColumn("month_no", F.lit(10**9).cast("long")), key, 4,
        ["---", "", "## Statistics", "", _text("- **Total sessions:** ", F.col("c").cast("string")), _text("- **Total duration:** ", clock.duration_rounded(F.col("s")))],
    )
    return _union([first, head, body, tail, last])


def session_document_lines(sessions: DataFrame, artifacts: DataFrame, speakers: DataFrame, moments: DataFrame) -> DataFrame:
    """Session page: classification of at least 25 %, artifacts, speakers and key moments.

    ``sessions`` has ``session_id``, ``created_at`` and the score columns; the other tables have a
    ``session_id`` and ``type``, ``name``/``role`` or ``timestamp``/``description``.
    """
    key = ["session_id"]
    types = significant_types(25, by_score=True)
    scores = F.create_map(*[c for s in ("meeting", "debugging", "tutorial", "learning", "working") for c in (F.lit(s), F.col(s))])
    shown = F.array_join(F.transform(types, lambda x: F.concat(x, F.lit(" ("), F.element_at(scores, x), F.lit("%)"))), " | ")
    head = _lines(
        sessions, key, 0,
        [_text("# Session: ", F.col("session_id").cast("string")), "", _text("**Date:** ", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd HH:mm:ss")),
         _text("**Classification:** ", shown), ""],
    )

    def block(part: int, rows: DataFrame, heading: list[str], line: Column, at: Column, n: Column) -> DataFrame:
        top = _lines(rows.select(*key).distinct(), key, part, heading).withColumn("n", F.lit(-1).cast("long")).withColumn("at", F.lit(-1e18))
        return _union([top, _lines(rows, key, part, [line], n=n, at=at), _lines(rows.select(*key).distinct(), key, part + 1, [""])])

    kinds = block(1, artifacts, ["## Artifacts", ""], _text("- ", title_words(F.col("type"))), F.lit(0.0), F.col("n"))
    meta = _lines(speakers.select(*key).union(moments.select(*key)).distinct(), key, 3, ["## Metadata", ""])
    role = F.when(F.col("role") != "", _text(" (", F.col("role"), ")")).otherwise(F.lit(""))
    people = block(4, speakers, ["### Speakers"], F.concat(_text("- ", F.col("name")), role), F.lit(0.0), F.col("n"))
    times = block(6, moments, ["### Key Moments"], _text("- [", clock.minutes_seconds(F.col("timestamp")), "] ", F.col("description")), F.col("timestamp"), F.col("n"))
    return _union([head, kinds, meta, people, times])


def _started(blocks: DataFrame) -> DataFrame:
    """Blocks with 0 for a missing start, end or duration."""
    return blocks.withColumns({c: F.coalesce(c, F.lit(0).cast(blocks.schema[c].dataType)) for c in ("from_ts", "to_ts", "duration")})


def summary_sections(blocks: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Blocks numbered by start, with the values every section of a summary shows; no start counts as 0."""
    return ordered.row_index(_started(blocks), REC, ["from_ts", "id"], "section_no", width=width)


def session_summary_lines(
    blocks: DataFrame, recordings: DataFrame, transcripts: DataFrame, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Work session summary: applications, web addresses, one section per block, counts.

    ``transcripts`` holds ``(recording_id, block_id, transcript_start, line)``.
    """
    sections = summary_sections(blocks, width=width)
    spoken = transcripts.where(F.length(F.trim("line")) > 0)
    heard = spoken.select(*REC, F.col("block_id").alias("id")).distinct().withColumn("heard", F.lit(True))
    sections = sections.join(heard, [*REC, "id"], "left")
    counts = sections.groupBy(*REC).agg(F.count("*").alias("sections"), F.count_if("heard").alias("with_audio"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("apps")))).alias("names"))
    heads = recordings.select(F.col("id").alias("recording_id"), half_up(F.col("duration") / 60).cast("string").alias("minutes")).join(counts, REC)
    number = F.col("sections").cast("string")
    none = F.lit("None detected")
    head = _lines(
        heads, REC, 0,
        ["# Work Session Summary", "", _text("**Recording ID:** ", F.col("recording_id").cast("string"), "  "), _text("**Session Duration:** ", F.col("minutes"), " minutes  "),
         _text("**Activities Identified:** ", number), "", "## Overview", "",
         _text("This work session consisted of ", number, " distinct activities over ", F.col("minutes"), " minutes."), "", "## Apps & Pages Used", "", "### Applications",
         F.coalesce(F.nullif(F.array_join("names", ", "), F.lit("")), none), "", "### Websites Visited"],
    )
    texts = blocks.select(*REC, F.coalesce("key_description", F.lit("")).alias("x")).unionByName(spoken.select(*REC, F.col("line").alias("x")))
    found = texts.select(*REC, F.explode(urls(F.col("x"))).alias("url")).distinct()
    # Addresses are sorted by themselves: one line each, placed by text.
    links = found.select(*REC, F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(0.0).alias("at"), _text("- ", F.col("url")).alias("line"))
    missing = _lines(heads.join(found.select(*REC).distinct(), REC, "left_anti"), REC, 1, ["None detected"])
    gap = _lines(heads, REC, 2, ["", "## Activities", ""])
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), none)
    described = F.coalesce(F.nullif(F.col("key_description"), F.lit("")), F.lit("*No visual description available*"))
    activity = F.coalesce(F.nullif(F.col("activity_type"), F.lit("")), F.lit("unknown"))
    place = F.col("section_no")
    top = _lines(
        sections, REC, 3,
        [_text("### ", (place + 1).cast("string"), ". ", capitalise(activity)), "", _text("- **Time:** ", half_up(F.col("from_ts") / 60).cast("string"), " minutes into session"),
         _text("- **Duration:** ", half_up(F.col("duration") / 60).cast("string"), " minutes"), _text("- **Apps:** ", listed("apps")), _text("- **Topics:** ", listed("topics")), "",
         "**What was happening:**", described, "", F.when(F.col("heard"), F.lit("**Audio transcript:**")), F.when(F.col("heard"), F.lit("```"))],
        n=place,
    )
    said = spoken.join(sections.select(*REC, F.col("id").alias("block_id"), "section_no"), [*REC, "block_id"])
    speech = _lines(said, REC, 3, [F.col("line")], n=place, at=F.col("transcript_start"), k=20)
    close = _lines(sections.where("heard"), REC, 3, ["```", ""], n=place, k=30)
    rule = _lines(sections, REC, 3, ["---", ""], n=place, k=40)
    foot = _lines(
        heads, REC, 4,
        ["## Summary Statistics", "", _text("- Total activities: ", number), _text("- Total duration: ", F.col("minutes"), " minutes"),
         _text("- Activities with audio: ", F.col("with_audio").cast("string"))],
    )
    return _union([head, links, missing, gap, top, speech, close, rule, foot])


def _filled(raw: str, names: dict[str, str]) -> Column:
    """A line of a template with its placeholders replaced by columns."""
    line = F.lit(raw)
    for name, column in names.items():
        if "{{" + name + "}}" in raw:
            line = F.replace(line, F.lit("{{" + name + "}}"), F.col(column).cast("string"))
    return line


def request_lines(
    template: str, keys: Sequence[str], values: DataFrame, names: dict[str, str], items: DataFrame, items_name: str
) -> DataFrame:
    """Fill a request template for every key without putting its items into one row.

    ``{{NAME}}`` placeholders are filled from the columns of ``values`` given by ``names``; the one
    called ``items_name`` becomes the lines of ``items`` (a table with the place columns).
    """

    def filled(text: str) -> list[Column]:
        return [_filled(raw, names) for raw in text.split("\n")]

    before, _, after = template.partition("{{" + items_name + "}}")
    head = _lines(values, keys, 0, filled(before.rstrip("\n")))
    tail = _lines(values, keys, 9, filled(after.lstrip("\n"))) if after.strip() else None
    return _union([head, items.select(*keys, *PLACE, "line"), *([tail] if tail is not None else [])])


def grouping_request_items(blocks: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Numbered block descriptions of a grouping request."""
    placed = ordered.row_index(_started(blocks), REC, ["from_ts", "id"], "_n", width=width)
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    return _lines(
        placed, REC, 1,
        [_text("BLOCK ", (F.col("_n") + 1).cast("string"), ":"),
         _text("Time: ", clock.minutes_seconds(F.col("from_ts")), " - ", clock.minutes_seconds(F.col("to_ts")), " (", clock.duration_floor(F.col("duration")), ")"),
         _text("Activity: ", F.coalesce(F.nullif(F.col("activity_type"), F.lit("")), F.lit("other"))), _text("Description: ", F.coalesce("key_description", F.lit(""))),
         _text("Apps: ", listed("apps")), _text("Topics: ", listed("topics")), _text("ID: ", F.col("id").cast("string")), ""],
        n=F.col("_n"),
    )


GROUPING_TEMPLATE = """{{BLOCK_COUNT}} work segments follow. Sort them into one to six subjects.

{{BLOCK_DESCRIPTIONS}}
Answer with one line per subject, using every ID once:
Group 1: label: [name] | blockIds: [id, id]"""


def grouping_requests(blocks: DataFrame, template: str = GROUPING_TEMPLATE, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """One request per recording that asks a model to group its blocks."""
    counts = blocks.groupBy(*REC).agg(F.count("*").alias("blocks"))
    return request_lines(template, REC, counts, {"BLOCK_COUNT": "blocks"}, grouping_request_items(blocks, width=width), "BLOCK_DESCRIPTIONS")


ARTIFACT_TEMPLATE = """Write a report on a work session of {{SESSION_DURATION}} on {{SESSION_DATE}} with {{SUBJECT_COUNT}} subjects.

{{SUBJECTS_DATA}}
Keep to the facts above."""


def artifact_requests(
    subjects: DataFrame, members: DataFrame, blocks: DataFrame, recordings: DataFrame, template: str = ARTIFACT_TEMPLATE, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """One request per recording with its subjects and their block descriptions."""
    every = F.transform(ranked_activities(F.col("activity_breakdown")), lambda e: F.concat(e["a"], F.lit(": "), clock.duration_floor(-e["s"])))
    shown = F.when(F.size("activity_breakdown") > 0, F.array_join(every, ", ")).otherwise(F.lit("various"))
    head = _lines(
        subjects, REC, 1,
        [_text("### Subject: ", F.col("label")), _text("**Duration:** ", clock.duration_floor(F.col("duration"))), _text("**Activities:** ", shown),
         _text("**Apps:** ", F.coalesce(F.nullif(F.array_join("apps", ", "), F.lit("")), F.lit("none"))), _text("**isPersonal:** ", F.col("is_personal").cast("string")), "", "**Block Descriptions:**"],
        n=F.col("subject_no"),
    )
    owned = members.join(subjects.select(*REC, "subject_id", "subject_no"), [*REC, "subject_id"])
    parts = owned.join(_started(blocks).select(*REC, F.col("id").alias("block_id"), "from_ts", F.col("duration").alias("_d"), "key_description"), [*REC, "block_id"])
    placed = ordered.row_index(parts, [*REC, "subject_id"], ["from_ts", "block_id"], "_n", width=width)
    length = F.when(F.col("_d") != 0, clock.duration_floor(F.col("_d"))).otherwise(F.lit("unknown"))
    line = _text("- Block ", (F.col("_n") + 1).cast("string"), " (", length, "): ", F.coalesce("key_description", F.lit("")))
    lines = _lines(placed, REC, 1, [line], n=F.col("subject_no"), at=F.col("_n"), k=20)
    heads = _sessions(subjects, recordings).select(*REC, clock.duration_floor(F.col("length")).alias("d"), long_date(F.col("captured_at")).alias("on"), "subjects")
    names = {"SESSION_DURATION": "d", "SESSION_DATE": "on", "SUBJECT_COUNT": "subjects"}
    return request_lines(template, REC, heads, names, head.unionByName(lines), "SUBJECTS_DATA")


SEGMENT_TEMPLATE = """Classify the segment {{TIME_RANGE}}.
Contexts: {{CONTEXTS}}

{{FRAMES}}
Give a score from 0 to 100 for meeting, debugging, tutorial, learning and working."""


def classification_requests(segments: DataFrame, obs: DataFrame, contexts: DataFrame, template: str = SEGMENT_TEMPLATE) -> DataFrame:
    """One request per segment: time range, contexts and a line per frame or transcript.

    ``segments`` is ``(recording_id, segment_id, start_time, end_time)``, ``obs`` carries a
    ``segment_id``, ``contexts`` is ``(segment_id, type, name)`` with few rows per segment.
    """
    key = [*REC, "segment_id"]
    known = contexts.groupBy("segment_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("type", "name"))), lambda c: F.concat(c["type"], F.lit(": "), c["name"])), ", ").alias("contexts")
    )
    heads = segments.join(known, "segment_id", "left").select(
        *key, clock.span_text(F.col("start_time"), F.col("end_time")).alias("range"), F.coalesce("contexts", F.lit("none")).alias("contexts")
    )
    seen = _text("[", clock.minutes_seconds(F.col("timestamp")), "] ", F.coalesce("vlm_description", F.substring("ocr_text", 1, 100), F.lit("")))
    said = _text("[", clock.minutes_seconds(F.col("timestamp")), "] ", F.coalesce("text", F.lit("")))
    items = _lines(obs, key, 1, [F.when(F.col("type") == "visual", seen).otherwise(said)], at=F.col("timestamp"))
    return request_lines(template, key, heads, {"TIME_RANGE": "range", "CONTEXTS": "contexts"}, items, "FRAMES")


def request_document(template: str, keys: Sequence[str], values: DataFrame, names: dict[str, str], items: dict[str, DataFrame], absent: str) -> DataFrame:
    """Fill a template that holds several lists of items.

    ``{{NAME}}`` placeholders are filled from the columns of ``values`` as in :func:`request_lines`; those
    named in ``items`` stand alone in their line and become the lines of a table with keys, place and line.
    A key without items shows ``absent`` there. Text and lists take turns in the parts 0, 1, 2 and so on.
    """
    keys = list(keys)
    pieces = re.split(r"\n?\{\{(" + "|".join(items) + r")\}\}\n?", template)
    out = []
    for part, piece in enumerate(pieces):
        if part % 2 == 0:
            out.append(_lines(values, keys, part, [_filled(raw, names) for raw in piece.split("\n")]))
        else:
            rows = items[piece].select(*keys, F.lit(part).alias("part"), "n", "k", "at", "line")
            missing = values.join(rows.select(*keys).distinct(), keys, "left_anti")
            out += [rows, _lines(missing, keys, part, [absent])]
    return _union(out)


TIMELINE_TEMPLATE = """A work session of {{SESSION_DURATION}} minutes on {{SESSION_DATE}} with {{ACTIVITY_COUNT}} activities.

{{ACTIVITY_TIMELINE}}

Applications:
{{APPS_LIST}}

Pages:
{{URLS_LIST}}

Summarise the session from the facts above."""


def timeline_requests(
    blocks: DataFrame, recordings: DataFrame, transcripts: DataFrame, template: str = TIMELINE_TEMPLATE, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """One summary request per recording: its blocks in order with their transcripts, its applications and pages.

    ``transcripts`` holds ``(recording_id, block_id, transcript_start, line)``.
    """
    sections = summary_sections(blocks, width=width)
    spoken = transcripts.where(F.length(F.trim("line")) > 0)
    heard = spoken.select(*REC, F.col("block_id").alias("id")).distinct().withColumn("heard", F.lit(True))
    sections = sections.join(heard, [*REC, "id"], "left")
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("None detected"))
    place, later = F.col("section_no"), F.col("section_no") > 0
    activity = F.coalesce(F.nullif(F.col("activity_type"), F.lit("")), F.lit("unknown"))
    span = _text(clock.minutes_seconds(F.col("from_ts")), " - ", clock.minutes_seconds(F.col("to_ts")), ", ", half_up(F.col("duration") / 60).cast("string"), " minutes")
    body = _lines(
        sections, REC, 0,
        [F.when(later, F.lit("---")), F.when(later, F.lit("")), _text("### Segment ", (place + 1).cast("string"), ": ", activity, " (", span, ")"), "", "**Description:**",
         F.coalesce(F.nullif(F.col("key_description"), F.lit("")), F.lit("No description available")), "", _text("**Apps:** ", listed("apps")), _text("**Topics:** ", listed("topics")), "",
         F.when(F.col("heard"), F.lit("**Audio Transcript:**")).otherwise(F.lit("*No audio transcript*"))],
        n=place,
    )
    said = spoken.join(sections.select(*REC, F.col("id").alias("block_id"), "section_no"), [*REC, "block_id"])
    speech = _lines(said, REC, 0, [F.col("line")], n=place, at=F.col("transcript_start"), k=100)
    close = _lines(sections, REC, 0, [""], n=place, k=1000)
    single = lambda rows: rows.select(*REC, F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(0.0).alias("at"), _text("- ", F.col("name")).alias("line"))
    apps = single(blocks.select(*REC, F.explode("apps").alias("name")).distinct())
    texts = blocks.select(*REC, F.coalesce("key_description", F.lit("")).alias("x")).unionByName(spoken.select(*REC, F.col("line").alias("x")))
    pages = single(texts.select(*REC, F.explode(urls(F.col("x"))).alias("name")).distinct())
    counts = blocks.groupBy(*REC).agg(F.count("*").alias("activities"))
    heads = recordings.select(F.col("id").alias("recording_id"), half_up(F.col("duration") / 60).cast("string").alias("minutes"), long_date(F.col("captured_at")).alias("on")).join(counts, REC)
    items = {"ACTIVITY_TIMELINE": _union([body, speech, close]), "APPS_LIST": apps, "URLS_LIST": pages}
    return request_document(template, REC, heads, {"SESSION_DURATION": "minutes", "SESSION_DATE": "on", "ACTIVITY_COUNT": "activities"}, items, "None detected")


METADATA_TEMPLATE = """A session classified as {{CLASSIFICATION_SUMMARY}}.

Transcript:
{{TRANSCRIPT_SEGMENTS}}

On screen:
{{VISUAL_LOG}}

Name its speakers, key moments, action items and technical terms."""

DOCUMENT_TEMPLATE = """Write the {{TYPE}} of a session classified as {{CLASSIFICATION_SUMMARY}} in {{LANGUAGE}}.

Transcript:
{{TRANSCRIPT_SEGMENTS}}

On screen:
{{VISUAL_LOG}}

Metadata: {{METADATA}}"""


def _session_items(segments: DataFrame, visual: DataFrame, shown: Column) -> dict[str, DataFrame]:
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    said = _lines(segments, ["session_id"], 0, [_text("[", number("start"), "s - ", number("end"), "s] ", F.coalesce("text", F.lit("")))], at=F.col("start"), n=F.col("n"))
    seen = _lines(visual, ["session_id"], 0, [_text("[", number("timestamp"), "s] ", shown)], at=F.col("timestamp"), n=F.col("n"))
    return {"TRANSCRIPT_SEGMENTS": said, "VISUAL_LOG": seen}


def _classified(sessions: DataFrame) -> DataFrame:
    """Types of at least 25 % with their scores, in the order of the score columns."""
    types = ("meeting", "debugging", "tutorial", "learning", "working")
    shown = F.array_compact(F.array(*[F.when(F.col(t) >= 25, _text(f"{t}: ", F.col(t).cast("string"), "%")) for t in types]))
    return sessions.withColumn("summary", F.array_join(shown, ", "))


def metadata_requests(sessions: DataFrame, segments: DataFrame, visual: DataFrame, template: str = METADATA_TEMPLATE) -> DataFrame:
    """One request per session for its metadata: classification, transcript and what was on screen.

    ``segments`` is ``(session_id, n, start, end, text)``, ``visual`` ``(session_id, n, timestamp, label,
    description, ocr)``; recognised text is shown up to 100 characters, as the original does.
    """
    label = F.when(F.col("label") != "", _text("[", F.col("label"), "]")).otherwise(F.lit(""))
    described = F.when(F.col("description") != "", _text(": ", F.col("description"))).otherwise(F.lit(""))
    ocr = F.when(F.col("ocr") != "", _text(" (OCR: ", F.substring("ocr", 1, 100), ")")).otherwise(F.lit(""))
    items = _session_items(segments, visual, F.concat(label, described, ocr))
    return request_document(template, ["session_id"], _classified(sessions), {"CLASSIFICATION_SUMMARY": "summary"}, items, "N/A")


def document_requests(sessions: DataFrame, segments: DataFrame, visual: DataFrame, kind: str, template: str = DOCUMENT_TEMPLATE) -> DataFrame:
    """One request per session for a document of ``kind``; ``sessions`` also has ``language`` and ``metadata`` (JSON)."""
    heads = _classified(sessions).select(
        "session_id", "summary", F.lit(kind).alias("kind"), F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("metadata", F.lit("N/A")).alias("metadata")
    )
    items = _session_items(segments, visual, F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("Action on screen")))
    names = {"TYPE": "kind", "CLASSIFICATION_SUMMARY": "summary", "LANGUAGE": "language", "METADATA": "metadata"}
    return request_document(template, ["session_id"], heads, names, items, "N/A")
