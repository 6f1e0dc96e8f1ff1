"""Small known cases of the operators."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from dayweave.functions import clock, numbers, text, words
from dayweave.model import apply_model, require_some_success
from dayweave.operators import filters, frames, joins, maintenance, names, responses, segments, subjects, vectors
from dayweave.schemas import vector_from_bytes

OBS = "id string, recording_id string, type string, timestamp double, end_timestamp double, vlm_description string, activity_type string, apps array<string>, topics array<string>"


def observations(spark, rows, kind="visual"):
    data = []
    for i, (ts, length, description, *rest) in enumerate(rows):
        data.append((str(i + 1), "rec", rest[0] if rest else kind, float(ts), float(ts + length), description, None, ["vscode"], ["parser"]))
    return spark.createDataFrame(data, OBS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_runs(spark):
    rows = [(60 * i, 60, "Debugging the parser") for i in range(3)] + [
        (180, 60, "Writing code in VSCode"), (240, 60, "Implementing new feature"), (300, 60, "Reading documentation in Chrome")]
    obs = observations(spark, rows)
    found = segments.segments(obs).orderBy("start_time").collect()
    assert [(r["activity"], r["observations"]) for r in found] == [("debugging", 3), ("coding", 2), ("reading", 1)]
    assert [r["id"] for r in found] == ["seg-0", "seg-1", "seg-2"]
    assert found[0]["apps"] == ["vscode"] and found[0]["topics"] == ["parser"]
    members = segments.segment_members(obs).groupBy("anchor_id").agg(F.sort_array(F.collect_list("observation_id")).alias("ids"))
    assert sorted(r["ids"] for r in members.collect()) == [["1", "2", "3"], ["4", "5"], ["6"]]


def test_short_run_is_merged(spark):
    rows = [(10 * i, 10, "Debugging it") for i in range(6)] + [(60, 10, "Writing code now"), (70, 10, "Debugging it"), (80, 10, "Debugging it")]
    found = segments.segments(observations(spark, rows)).collect()
    assert [(r["activity"], r["observations"], r["start_time"], r["end_time"]) for r in found] == [("debugging", 9, 0.0, 90.0)]


def test_no_merge_and_order(spark):
    obs = observations(spark, [(30, 10, "Debugging it"), (0, 10, "Writing new function"), (10, 10, "Reading docs")])
    found = segments.segments(obs, 0.0).orderBy("start_time").collect()
    assert [r["start_time"] for r in found] == [0.0, 10.0, 30.0]


def test_only_described_visual_rows(spark):
    obs = observations(spark, [(0, 10, "Debugging it"), (10, 10, "Debugging it", "audio"), (20, 10, None), (30, 10, "Reading docs")])
    assert segments.segments(obs, 0.0).count() == 2


@pytest.mark.parametrize(
    "description, label",
    [("Browsing Stack Overflow for answers", "research"), ("In Zoom meeting with team", "meeting"), ("Reviewing pull request #12", "review"),
     ("Some generic activity", "other"), ("Fix the thing", "debugging"), (None, "other"), ("Writing a letter", "coding")],
)
def test_description_labels(spark, description, label):
    assert value(spark, text.activity_from_description(F.lit(description).cast("string"))) == label


def test_canonical_activity(spark):
    cases = {"Clicking": "terminal", " Deep  Work ": "deep_work", "reading error": "debugging", "Watching videos": "research", "Code Review": "review"}
    for raw, label in cases.items():
        assert value(spark, text.canonical_activity(F.lit(raw))) == label


def test_segment_stats(spark):
    segs = spark.createDataFrame([("debugging", 60.0), ("coding", 120.0), ("debugging", 45.0)], "activity string, duration double")
    stats = {r["activity"]: r for r in segments.segment_stats(segs).collect()}
    assert stats["debugging"]["segments"] == 2 and stats["coding"]["segments"] == 1
    assert sum(r["total_duration"] for r in stats.values()) == 225


def shots(spark, times, rec="r"):
    return spark.createDataFrame([(rec, float(t), i) for i, t in enumerate(times)], "recording_id string, timestamp double, id long")


def test_base_samples(spark):
    got = frames.adaptive_sample(shots(spark, range(0, 62, 2))).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in got] == [0, 10, 20, 30, 40, 50, 60] and {r["reason"] for r in got} == {"base"}
    got = frames.adaptive_sample(shots(spark, [20, 0, 10])).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in got] == [0, 10, 20]


def test_gap_is_filled(spark):
    got = frames.adaptive_sample(shots(spark, [0, 2, 4, 30, 32]), 10, 15, 5).collect()
    assert len(got) > 2 and any(r["reason"] == "gap_fill" for r in got)


def test_dense_scenes(spark):
    shot = shots(spark, range(0, 3540, 2))
    scenes = shots(spark, [i * 3540 / 109 for i in range(109)])
    got = frames.sample_with_scenes(shot, scenes)
    counts = {r["reason"]: r["count"] for r in got.groupBy("reason").count().collect()}
    total = sum(counts.values())
    assert counts["scene_change"] == 109 and total < 250 and 1 - total / 1770 > 0.85
    few = frames.sample_with_scenes(shots(spark, range(0, 60, 2)), shots(spark, [10, 20, 40]))
    assert few.where("reason = 'scene_change'").count() == 3


def test_scene_samples_without_scenes(spark):
    got = frames.sample_with_scenes(shots(spark, range(0, 40, 2)), shots(spark, [5.0], rec="other"))
    assert [r["timestamp"] for r in got.orderBy("timestamp").collect()] == [10, 20, 30]


def test_planned_seconds(spark):
    recs = spark.createDataFrame([("r", 60.0)], "id string, duration double")
    got = frames.required_timestamps(recs, shots(spark, [10, 25, 45])).orderBy("second").collect()
    assert [r["second"] for r in got] == [0, 10, 20, 25, 30, 40, 45, 50, 60]


def test_interval_rules(spark):
    rule = lambda n, b: value(spark, frames.adaptive_interval(F.lit(n), F.lit(b)))
    assert [rule(n, 10) for n in (0, 5, 20, 21, 35, 50, 51, 109, 200)] == [10, 10, 10, 20, 20, 20, 30, 30, 30]
    assert rule(5, 40) == 40 and rule(100, 40) == 40


AUDIO = "id long, recording_id string, type string, audio_source string, text string, timestamp double, end_timestamp double"


def test_alignment(spark):
    segs = spark.createDataFrame([("r", "a", 0.0, 60.0), ("r", "b", 60.0, 120.0), ("r", "c", 500.0, 600.0)], "recording_id string, id string, start_time double, end_time double")
    audio = spark.createDataFrame(
        [(1, "r", "audio", "mic", "hello", 10.0, 20.0), (2, "r", "audio", "system", "both", 55.0, 65.0), (3, "r", "audio", "mic", "brief", 119.5, 130.0),
         (4, "r", "audio", "mic", "one second", 119.0, 130.0), (5, "r", "audio", "mic", "  ", 30.0, 40.0), (6, "r", "audio", "mic", "open end", 54.0, None)],
        AUDIO,
    )
    pairs = joins.align_transcripts(segs, audio)
    assert sorted((r["segment_id"], r["transcript_id"]) for r in pairs.collect()) == [("a", 1), ("a", 2), ("a", 6), ("b", 2), ("b", 4)]
    lines = joins.transcript_lines(pairs).where("segment_id = 'a'").orderBy("transcript_start").collect()
    assert [r["line"] for r in lines] == ["[MIC] hello", "[MIC] open end", "[SYSTEM] both"]
    counts = {r["segment_id"]: (r["transcripts"], r["mic"], r["system"]) for r in joins.alignment_counts(segs, pairs).collect()}
    assert counts == {"a": (3, 2, 1), "b": (2, 1, 1), "c": (0, 0, 0)}
    assert joins.align_transcripts(segs, audio, min_overlap=5.0).where("transcript_id = 4").isEmpty()
    stats = subjects.alignment_stats(joins.alignment_counts(segs, pairs)).first()
    assert (stats["segments"], stats["with_audio"], stats["transcripts"]) == (3, 2, 5)


@pytest.mark.parametrize(
    "raw, want",
    [(["vscode"], ["VSCode"]), (["ghosty"], ["Ghostty"]), (["SLACK"], ["Slack"]), (["VSCode", "vscode"], ["VSCode"]), (["the", "a", "x", "unknown"], []),
     (["visual studio code"], ["VSCode"]), (["chrome"], ["Google Chrome"]), (["Obsidian App", "Obsidian Apps"], ["Obsidian App"]), ([], []),
     (["My Terminal window"], ["Terminal"])],
)
def test_app_names(spark, raw, want):
    assert value(spark, text.canonical_apps(F.lit(raw) if raw else F.array().cast("array<string>"))) == want


def test_global_app_names(spark):
    records = spark.createDataFrame([(1, ["Obsidian Apps", "vscode"]), (2, ["Obsidian App"]), (3, ["the"]), (4, ["Obsidian Appz", "Linear"])], "id int, apps array<string>")
    got = {r["id"]: r["apps"] for r in names.normalize_apps_global(records).collect()}
    assert got == {1: ["Obsidian App", "VSCode"], 2: ["Obsidian App"], 3: [], 4: ["Linear", "Obsidian App"]}


def test_similar_names_misses_nothing(spark):
    import random

    rng = random.Random(4)
    base = ["notebook", "calendar view", "spreadsheet editor pro", "abc", "terminal emulator next generation"]

    def damage(s):
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s))
            s = rng.choice([s[:at] + s[at + 1 :], s[:at] + "q" + s[at:], s[:at] + "z" + s[at + 1 :]]) or "a"
        return s

    every = sorted({damage(b) for b in base for _ in range(25)} | set(base))
    df = spark.createDataFrame([(n,) for n in every], "name string")
    brute = df.select(F.col("name").alias("name_a")).crossJoin(df.select(F.col("name").alias("name_b"))).where("name_a <> name_b")
    want = brute.where(text.name_similarity(F.col("name_a"), F.col("name_b")) >= 0.85)
    assert {tuple(r) for r in names.similar_names(df).collect()} == {tuple(r) for r in want.collect()}


def test_personal(spark):
    for app in ("WhatsApp", "discord", "FaceTime", "Instagram DM"):
        assert value(spark, text.is_personal_app(F.lit(app)))
    for app in ("Slack", "Figma"):
        assert not value(spark, text.is_personal_app(F.lit(app)))
    assert value(spark, text.personal_share_flag(F.lit(["WhatsApp", "Slack"]))) is True
    assert value(spark, text.personal_share_flag(F.lit(["whatsapp", "Slack"]))) is False


def test_time_ranges(spark):
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    assert not value(spark, clock.overlaps(*lit(0, 10, 10, 20)))
    assert value(spark, clock.overlap_seconds(*lit(0, 10, 4, 20))) == 6
    assert value(spark, clock.span_contains(*lit(0, 10, 10))) and value(spark, clock.span_contains(*lit(0, 10, 0)))
    assert value(spark, clock.span_text(*lit(5, 65))) == "0:05 → 1:05"
    assert value(spark, clock.make_span(*lit(1, 2)))["end"] == 2
    with pytest.raises(Exception, match="invalid time range"):
        value(spark, clock.make_span(*lit(3, 2)))
    assert [value(spark, f(F.lit(3725.0))) for f in (clock.duration_floor, clock.duration_rounded, clock.duration_exact)] == ["1h 2m", "1h 2m", "1h 2m"]
    assert [value(spark, f(F.lit(90.0))) for f in (clock.duration_floor, clock.duration_rounded, clock.duration_exact)] == ["1m", "2m", "1m 30s"]
    assert value(spark, clock.timestamp_text_seconds(F.lit("01:02:03.500"))) == 3723.5


def test_answers(spark):
    two = "Frame 1: description: Editing | activity: coding | apps: [VSCode, Chrome] | topics: parser, tests\nFrame 2: description: Chat | activity: meeting | apps: Slack | topics: [plan]"
    one = "Frame 1: description: Editing | activity: coding | apps: [VSCode] | topics: parser"
    batch = "array(named_struct('index', 7, 'timestamp', 1.0D, 'image_path', 'a'), named_struct('index', 8, 'timestamp', 2.0D, 'image_path', 'b'))"
    df = spark.createDataFrame([("x", two), ("y", one)], "response_id string, text string").withColumn("batch", F.expr(batch))
    got = {(r["response_id"], r["frame_no"]): r for r in responses.parse_frame_batches(df).collect()}
    assert got[("x", 1)]["apps"] == ["VSCode", "Chrome"] and got[("x", 1)]["topics"] == ["parser", "tests"] and got[("x", 1)]["index"] == 7
    assert got[("x", 2)]["apps"] == ["Slack"] and got[("x", 2)]["topics"] == ["plan"]
    bad = got[("y", 2)]
    assert (bad["description"], bad["activity"], bad["apps"], bad["raw_response"]) == ("Failed to parse Frame 2", "unknown", [], one)


def test_groups_and_fallback(spark):
    blocks = spark.createDataFrame(
        [("r", "b1", 0.0, 10.0, "coding", ["VSCode"]), ("r", "b2", 10.0, 20.0, "chat", ["WhatsApp"]), ("r", "b3", 30.0, 5.0, None, ["VSCode"]), ("q", "b4", 0.0, 7.0, "x", ["Slack"])],
        "recording_id string, id string, from_ts double, duration double, activity_type string, apps array<string>",
    )
    answers = spark.createDataFrame(
        [("r", "<think>hm</think>Group 1: label: Work | blockIds: [b1, 'b3', nope]\nGroup 2: label: Gone | blockIds: [zzz]\ngroup 3: label: Chat | blockIds: [\"b2\"]"), ("q", "sorry")],
        "recording_id string, text string",
    )
    groups = responses.parse_groups(answers, blocks)
    built = {r["subject_id"]: r for r in subjects.build_subjects(subjects.grouped_members(groups), blocks).collect()}
    assert set(built) == {"subject-r-0", "subject-r-1"}
    assert built["subject-r-0"]["duration"] == 15 and built["subject-r-0"]["activity_breakdown"] == {"coding": 10.0, "other": 5.0}
    assert built["subject-r-1"]["is_personal"] and not built["subject-r-0"]["is_personal"]
    back = subjects.fallback_subjects(blocks.join(groups.select("recording_id").distinct(), "recording_id", "left_anti"))
    assert [(r["label"], r["duration"]) for r in back.collect()] == [("Work Session", 7.0)]
    alone = subjects.fallback_subjects(blocks.where("recording_id = 'r'")).orderBy("subject_id").collect()
    assert [r["label"] for r in alone] == ["Work Session", "Personal", "Work Session"]


def test_attempts(spark):
    rows = [("a", False, t) for t in range(3)] + [("b", False, t) for t in range(4)] + [("c", False, 0), ("c", True, 1)]
    got = {r["frame_id"]: r["state"] for r in maintenance.attempt_ledger(spark.createDataFrame(rows, "frame_id string, ok boolean, at int")).collect()}
    assert got == {"a": 0, "b": 2, "c": 1}


def test_page_bounds():
    assert [filters.page_bounds(*x) for x in ((None, None), (0, -5), (5, 3), (999, 1))] == [(50, 0), (50, 0), (10, 3), (200, 1)]


def test_cosine(spark):
    assert value(spark, numbers.cosine(F.lit([1.0, 0.0]), F.lit([0.0, 0.0]))) == 0.0
    assert abs(value(spark, numbers.cosine(F.lit([1.0, 1.0]), F.lit([2.0, 2.0]))) - 1) < 1e-12
    with pytest.raises(Exception, match="differ in length"):
        value(spark, numbers.cosine(F.lit([1.0]), F.lit([0.0, 0.0])))


def test_cosine_pairs_in_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(n % 2, n, [float(x) for x in base[n % 60] + 0.2 * rng.standard_normal(16)]) for n in range(180)]
    df = spark.createDataFrame(rows, "recording_id int, id long, vector array<double>")
    unit = {n: np.array(v) / np.linalg.norm(v) for _, n, v in rows}
    for keys in (["recording_id"], []):
        want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.85 and (not keys or a % 2 == b % 2)}
        got = [(r.id_a, r.id_b) for r in vectors.cosine_pairs(df, 0.85, keys).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_vector_bytes(spark):
    import struct

    floats = [0.0, 1.5, -2.25, 1e-3]
    df = spark.createDataFrame([(bytearray(struct.pack("<4f", *floats)),)], "v binary")
    got = vector_from_bytes(df, "v", 4).first()["v"]
    assert got == pytest.approx(floats, rel=1e-7)


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"),
     ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("goodness", "good"),
     ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("debugging", "debug"), ("running", "run")],
)
def test_stems(word, stem):
    assert words.stem_word(word) == stem


def test_hallucinations(spark):
    unit = "we will see you next time "
    cases = {
        "Hello Thanks for watching friends": "Hello  friends",
        "a " + unit * 6 + "b": "a b",
        "please subscribe and Please Subscribe": "and Please Subscribe",
        "plain text": "plain text",
        "x" * 130: "",
    }
    for raw, want in cases.items():
        assert value(spark, text.without_hallucinations(F.lit(raw))) == want


def test_model_isolates_failures(spark):
    def answer(bodies):
        if "bad" in bodies:
            raise ValueError("no")
        return [b.upper() for b in bodies]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "content string")
    got = {r["content"]: (r["answer"], r["error"]) for r in require_some_success(apply_model(df, answer)).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}
    with pytest.raises(RuntimeError):
        require_some_success(apply_model(df.where("content = 'bad'"), answer))


def test_metadata_backfill(spark):
    df = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"a":"b"}'), (4, '{"k":"old"}')], "id int, metadata string")
    got = {r["id"]: r["metadata"] for r in maintenance.backfill_metadata(df, "k", "v").collect()}
    assert got == {1: '{"k":"v"}', 2: '{"k":"v"}', 3: '{"a":"b","k":"v"}', 4: '{"k":"old"}'}


def test_recent_cutoff(spark):
    obs = observations(spark, [(0, 1, "Debugging"), (100, 1, "Debugging")]).withColumn("activity_type", F.lit("Debugging"))
    assert filters.activity_since(obs, 50.0).first()["observations"] == 1


def test_assemble_keeps_every_document(spark):
    from dayweave.operators.reports import assemble

    rows = [(1, 0, n, 0, 0.0, "x" * 100) for n in range(6000)] + [(1, 1, 0, k, float(k), f"end {k}") for k in range(3)] + [(2, 0, 0, 0, 0.0, "short")]
    lines = spark.createDataFrame(rows, "recording_id long, part int, n long, k int, at double, line string")
    found = assemble(lines, part_chars=200_000, together=700).collect()
    whole = {key: "\n".join(r.content for r in sorted(found, key=lambda r: r.part_no) if r.recording_id == key) for key in (1, 2)}
    assert whole == {1: "\n".join(["x" * 100] * 6000 + ["end 0", "end 1", "end 2"]), 2: "short"}
    assert sorted(r.part_no for r in found if r.recording_id == 1) == [0, 1, 2, 3]
    assert all(len(r.content) <= 200_100 for r in found)


def test_rows_without_a_time_come_first(spark):
    from dayweave.operators.maintenance import retention
    from dayweave.plans import ordered

    rows = spark.createDataFrame([(1, None, 5), (2, 7200.0, 5), (3, 10.0, 5), (4, None, 5)], "id long, timestamp double, bytes long")
    assert {r.id: r.n for r in ordered.row_index(rows, [], ["timestamp", "id"], "n").collect()} == {1: 0, 4: 1, 3: 2, 2: 3}
    assert sorted(r.id for r in retention(rows, 15, 10).collect()) == [1, 4]
    runs = ordered.islands(rows, [], ["timestamp", "id"], lambda a, b: b["timestamp"] - a["timestamp"] > 60, ["timestamp"])
    assert {r.id: r.run_id for r in runs.collect()} == {1: 1, 4: 1, 3: 1, 2: 2}


def test_scans_without_keys_spread_over_chunks(spark, monkeypatch):
    from dayweave.plans import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "cast(id as double) / 10 as timestamp")
    width = ordered.fitting_width(rows, [], "timestamp", ordered.CHUNK_SECONDS)
    assert ordered.with_chunk(rows, "timestamp", width).select(ordered.CHUNK).distinct().count() >= 20
    assert ordered.fitting_width(rows, ["id"], "timestamp", 3600.0) == 3600.0
    found = ordered.row_index(rows, [], ["timestamp", "id"], "n").collect()
    assert all(r.n == r.id for r in found)


def test_blocks_without_a_start_count_from_zero(spark):
    from dayweave.operators.subjects import fallback_members

    blocks = spark.createDataFrame([(1, 1, None, ["WhatsApp"]), (1, 2, 50.0, ["VSCode"]), (1, 3, 60.0, ["VSCode"])], "recording_id long, id long, from_ts double, apps array<string>")
    found = {r.block_id: (r.subject_id, r.label) for r in fallback_members(blocks).collect()}
    assert found == {1: ("subject-1-0", "Personal"), 2: ("subject-1-1", "Work Session"), 3: ("subject-1-1", "Work Session")}


def test_repeated_new_keys_and_cleared_values(spark):
    from dayweave.operators import maintenance

    base = spark.createDataFrame([(1, "old", 0), (None, "old", 0)], "key long, v string, at long")
    new = spark.createDataFrame([(2, "a", 1), (2, "b", 2), (1, "c", 1), (None, "d", 1), (None, "e", 2)], "key long, v string, at long")
    rows = lambda df: sorted(((r.key or 0), r.v) for r in df.collect())
    assert rows(maintenance.insert_or_ignore(base, new, ["key"], ["at"])) == [(0, "d"), (0, "e"), (0, "old"), (1, "old"), (2, "a")]
    assert rows(maintenance.insert_or_replace(base, new, ["key"], ["at"])) == [(0, "d"), (0, "e"), (0, "old"), (1, "c"), (2, "b")]
    patch = spark.createDataFrame([(1, None)], "key long, v string")
    assert rows(maintenance.update_by_key(base, patch, ["key"])) == [(0, "old"), (1, None)]
    assert rows(maintenance.update_by_key(base, patch, ["key"], keep_on_null=True)) == [(0, "old"), (1, "old")]
