"""Jobs over tables of model answers and recognised text: parsed rows, and rejects where a form is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.functions import text as tx
from dayweave.operators.joins import valid_members
from dayweave.plans import ordered

# The answer forms.
FRAME_FIELDS = r"description:\s*(.+?)\s*\|\s*activity:\s*(.+?)\s*\|\s*apps:\s*(\[.+?\]|[^|]+)\s*\|\s*topics:\s*"
RANGE_FORM = (
    r"(?is)Range\s+\d+:\s*frames:\s*\[(\d+)-(\d+)\]\s*\|\s*activity:\s*(\S+)\s*\|\s*apps:\s*([^\|]+)\s*"
    r"\|\s*topics:\s*([^\|]+)\s*\|\s*description:\s*(.+?)(?=Range\s+\d+:|\z)"
)
GROUP_FORM = r"(?i)^Group\s+\d+:\s*label:\s*(.+?)\s*\|\s*{ids}:\s*\[(.+?)\]$"


def parse_frame_batches(responses: DataFrame) -> DataFrame:
    """One row per requested frame of a batch answer.

    ``batch`` lists the requested frames. The answer for frame n reaches up to the next ``Frame k:``. A
    frame without an answer keeps the raw text and gets an unknown activity.
    """
    frames = responses.select("*", F.posexplode("batch").alias("_pos", "frame"))
    frames = frames.withColumn("frame_no", F.col("_pos") + 1)
    head = F.concat(F.lit("Frame "), F.col("frame_no"), F.lit(r":\s*"))
    form = F.concat(F.lit("(?is)"), head, F.lit(FRAME_FIELDS + r"(.+?)(?=Frame \d+:|\z)"))
    # The per-row pattern finds the frame's part; the fields are then cut out with one fixed pattern.
    found = frames.withColumn("_part", F.call_function("regexp_extract", F.col("text"), form, F.lit(0)))
    fields = r"(?is)^Frame \d+:\s*" + FRAME_FIELDS + r"(.+)\z"
    group = lambda i: F.regexp_extract("_part", fields, i)
    ok = F.col("_part") != ""
    empty = F.array().cast("array<string>")
    return found.select(
        *[c for c in responses.columns if c not in ("batch", "text")],
        "frame_no",
        F.coalesce("frame.index", "_pos").alias("index"),
        F.col("frame.timestamp").alias("timestamp"),
        F.col("frame.image_path").alias("image_path"),
        ok.alias("parsed"),
        F.when(ok, tx.trim_blank(group(1))).otherwise(F.concat(F.lit("Failed to parse Frame "), F.col("frame_no"))).alias("description"),
        F.when(ok, tx.trim_blank(group(2))).otherwise(F.lit("unknown")).alias("activity"),
        F.when(ok, tx.comma_list(group(3))).otherwise(empty).alias("apps"),
        F.when(ok, tx.comma_list(group(4))).otherwise(empty).alias("topics"),
        F.when(~ok, F.col("text")).alias("raw_response"),
    )


def parse_frame_single(responses: DataFrame) -> DataFrame:
    """Fields of one-frame answers; a text in another form becomes the description."""
    form = r"(?s)^" + FRAME_FIELDS + r"(.+)\z"
    whole = F.coalesce("text", F.lit(""))
    ok = whole.rlike(form)
    group = lambda i: F.regexp_extract(whole, form, i)
    empty = F.array().cast("array<string>")
    return responses.withColumns(
        {
            "description": F.when(ok, tx.trim_blank(group(1))).otherwise(tx.trim_blank(whole)),
            "activity": F.when(ok, tx.trim_blank(group(2))).otherwise(F.lit("unknown")),
            "apps": F.when(ok, tx.comma_list(group(3))).otherwise(empty),
            "topics": F.when(ok, tx.comma_list(group(4))).otherwise(empty),
        }
    )


def parse_activity_ranges(responses: DataFrame) -> DataFrame:
    """All ``Range n`` records of an answer, one row each.

    A list followed by a blank keeps its closing bracket on the last entry, as the form prescribes.
    """
    every = [F.regexp_extract_all("text", F.lit(RANGE_FORM), F.lit(i)) for i in range(1, 7)]
    rows = responses.select(
        *[c for c in responses.columns if c != "text"],
        F.posexplode(F.arrays_zip(*[e.alias(f"g{i}") for i, e in enumerate(every, 1)])).alias("range_no", "r"),
    )
    return rows.select(
        *[c for c in responses.columns if c != "text"],
        "range_no",
        F.col("r.g1").cast("int").alias("start_frame"),
        F.col("r.g2").cast("int").alias("end_frame"),
        tx.trim_blank(F.col("r.g3")).alias("activity"),
        tx.comma_list(F.col("r.g4")).alias("apps"),
        tx.comma_list(F.col("r.g5")).alias("topics"),
        tx.trim_blank(F.col("r.g6")).alias("description"),
    )


def clean_answer(answer: Column, *, groups: bool = True) -> Column:
    """Grouping or report answer without reasoning."""
    return tx.strip_reasoning_prose(tx.strip_thinking(answer, keep="second"), groups=groups)


def _group_lines(responses: DataFrame, ids: str) -> DataFrame:
    cleaned = clean_answer(F.col("text"))
    body = F.when(cleaned == "", F.col("text")).otherwise(cleaned)
    lines = responses.select("recording_id", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    form = GROUP_FORM.format(ids=ids)
    return lines.where(F.col("line").rlike(form)).select(
        "recording_id",
        "line_no",
        tx.trim_blank(F.regexp_extract("line", form, 1)).alias("label"),
        F.posexplode(F.split(F.regexp_extract("line", form, 2), ",")).alias("position", "_member"),
    ).where("label <> ''")


def parse_groups(responses: DataFrame, blocks: DataFrame, *, ids: str = "blockIds") -> DataFrame:
    """Group members named by block id; unknown ids and groups left empty by them disappear.

    ``line_no`` identifies the group inside the answer. Recordings without any row fall back to
    :func:`dayweave.operators.subjects.fallback_subjects`.
    """
    member = F.regexp_replace(tx.trim_blank(F.col("_member")), r"^[\"']|[\"']$", "")
    named = _group_lines(responses, ids).select("recording_id", "line_no", "label", "position", member.alias("block_id"))
    kind = blocks.schema["id"].dataType
    return valid_members(named.withColumn("block_id", F.col("block_id").try_cast(kind)), blocks)


def parse_groups_by_number(responses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Group members named by the position of the block in the request (from one)."""
    number = F.regexp_extract(tx.trim_blank(F.col("_member")), r"^([+-]?\d+)", 1).try_cast("long")
    named = _group_lines(responses, "blocks").select("recording_id", "line_no", "label", "position", number.alias("block_no"))
    # A block without a start counts from 0.
    placed = blocks.select("recording_id", "id", F.coalesce("from_ts", F.lit(0)).alias("from_ts"))
    order = ordered.row_index(placed, ["recording_id"], ["from_ts", "id"], "_n")
    numbered = order.select("recording_id", F.col("id").alias("block_id"), (F.col("_n") + 1).alias("block_no"))
    return named.join(numbered, ["recording_id", "block_no"])


def json_from_text(text: Column) -> Column:
    """First readable fenced JSON block, else the first readable JSON object, as text."""
    fenced = F.transform(
        F.regexp_extract_all(text, F.lit(r"```json\s*([\s\S]*?)```"), F.lit(1)), tx.trim_blank
    )
    objects = F.regexp_extract_all(text, F.lit(r"(\{[\s\S]*?\"\w+\"[\s\S]*?\})"), F.lit(1))
    readable = lambda x: F.try_parse_json(x).isNotNull()
    first = lambda found: F.get(F.filter(found, readable), 0)
    return F.to_json(F.try_parse_json(F.coalesce(first(fenced), first(objects))))


def topic_samples(obs: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows per key as short texts: description, else 200 characters of recognised text;
    500 characters of speech. Texts of up to ten characters are dropped afterwards."""
    sample = F.when(
        F.col("type") == "visual",
        F.coalesce(F.when(F.col("vlm_description") != "", F.col("vlm_description")), F.substring("ocr_text", 1, 200), F.lit("")),
    ).otherwise(F.coalesce(F.substring("text", 1, 500), F.lit("")))
    # Every task keeps n rows a key before they meet.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "id"))
    placed = obs.withColumn("sample_no", place).where(F.col("sample_no") <= n).withColumn("sample_no", (F.col("sample_no") - 1).cast("long"))
    return placed.withColumn("sample", sample).where(F.length("sample") > 10)


def clean_transcripts(segments: DataFrame) -> DataFrame:
    """Transcript segments without invented phrases; segments left blank are dropped."""
    return segments.withColumn("text", tx.without_hallucinations(F.col("text"))).where("text <> ''")


def description_names(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct applications and topics seen per canonical activity, one row each: ``kind``, ``name``."""
    named = obs.withColumn("activity", tx.canonical_activity(F.col("activity_type")))
    entry = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    return named.select(*keys, "activity", F.explode(F.concat(entry("app", "apps"), entry("topic", "topics"))).alias("e")).select(*keys, "activity", "e.*").distinct()


def description_stats(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per canonical activity and the distinct names seen, sorted; :func:`description_names` has them as rows.

    Names are made distinct before they meet, so a list is built from its own entries only.
    """
    named = obs.withColumn("activity", tx.canonical_activity(F.col("activity_type")))
    frames = named.groupBy(*keys, "activity").agg(F.count("*").alias("frames"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))
    seen = description_names(obs, keys).groupBy(*keys, "activity").agg(listed("app").alias("apps"), listed("topic").alias("topics"))
    match = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "activity"]]
    both = frames.alias("f").join(seen.alias("s"), reduce(lambda a, b: a & b, match), "left")
    names = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("apps", "topics")]
    return both.select(*[f"f.{k}" for k in keys], "f.activity", "frames", *names)


def web_addresses(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Distinct web addresses per key over several text columns, one row each."""
    found = F.flatten(F.array(*[tx.urls(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    return rows.select(*keys, F.explode(found).alias("url")).distinct()
