"""Readers and writers over small generated folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dayweave.sources import files, tables
from dayweave.streaming import live


def test_capture_meta(spark, tmp_path):
    def capture(name, body):
        folder = tmp_path / f"{name}.cap"
        folder.mkdir()
        (folder / "recording-meta.json").write_text(json.dumps(body))

    track = {"path": "content/mic.ogg"}
    capture("good", {"pretty_name": "Good", "segments": [{"display": {"path": "d.mp4"}, "mic": track}]})
    capture("system", {"segments": [{"display": {"path": "d.mp4"}, "system_audio": track}]})
    capture("silent", {"segments": [{"display": {"path": "d.mp4"}}]})
    capture("empty", {"segments": []})
    capture("missing", {"platform": "x"})
    valid, rejects = files.scan_capture_meta(spark, str(tmp_path))
    assert {r["id"] for r in valid.collect()} == {"good", "system"}
    assert {(r["id"], r["reason"]) for r in rejects.collect()} == {("silent", "no audio"), ("empty", "no segments"), ("missing", "no segments")}


def test_frame_folders(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    for name in ("1700000000500_1.jpg", "1700000001000_2.png", "readme.txt"):
        (folder / name).write_bytes(b"x")
    got = files.scan_frame_listing(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["display_id"]) for r in got] == [(1700000000.5, "1"), (1700000001.0, "2")]
    other = tmp_path / "other"
    other.mkdir()
    for i in range(25):
        (other / f"frame_{i:04d}.jpg").write_bytes(b"x")
    got = files.scan_frame_dir(spark, str(other)).orderBy("image_path").collect()
    assert [r["frame_index"] for r in got] == list(range(25)) and got[3]["timestamp"] == 6.0


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"transcription": [{"offsets": {"from": 0, "to": 1500}, "text": " hi "}, {"offsets": {"from": 1500, "to": 4000}, "text": "you"}]}))
    segs = files.scan_transcript_json(spark, str(tmp_path / "a.json"))
    assert [(r["recording_id"], r["seg_id"], r["start"], r["end"], r["text"]) for r in segs.orderBy("n").collect()] == [("a", "seg-0", 0.0, 1.5, "hi"), ("a", "seg-1", 1.5, 4.0, "you")]
    assert files.transcript_totals(segs).first()["duration"] == 4.0
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "b.txt").write_text("head\n[00:00:00.000 --> 00:00:05.250]  Hello world\n\n[00:01:00.000 --> 00:01:02.000] Bye")
    (logs / "c.txt").write_text("no times\nhere\n")
    got = {(r["recording_id"], r["start"], r["end"], r["text"]) for r in files.scan_transcript_log(spark, str(logs)).collect()}
    assert got == {("b", 0.0, 5.25, "Hello world"), ("b", 60.0, 62.0, "Bye"), ("c", 0.0, 0.0, "no times\nhere")}


def test_logs_and_manifests(spark, tmp_path):
    (tmp_path / "scenes.log").write_text("n:0 pts_time:0 x\nn:1 pts_time:12.5 y pts_time:13\n")
    assert sorted(r["timestamp"] for r in files.scan_scene_log(spark, str(tmp_path / "scenes.log")).collect()) == [12.5, 13.0]
    (tmp_path / "vad.json").write_text(json.dumps([{"start": 0.5, "end": 2.0, "audioPath": "a.wav"}, {"start": 3, "end": 4, "audioPath": "b.wav"}]))
    assert files.scan_vad_manifest(spark, str(tmp_path / "vad.json")).count() == 2
    (tmp_path / "log.csv").write_text(
        "scenario,frame_num,elapsed_s,sc_status,phash_hex,phash_hamming,dhash_hex,dhash_hamming,vn_distance,vn_latency_ms,jpeg_path\n"
        "idle,1,0.5,complete,ffffffffffffffff,,00000000000000ff,,,,\n"
    )
    from dayweave.operators.frames import frame_hashes

    row = frame_hashes(files.scan_hash_csv(spark, str(tmp_path / "log.csv"))).first()
    assert row["phash"] == -1 and row["dhash"] == 255 and row["phash_hamming"] is None and row["jpeg_path"] is None
    index = {"frames": [{"index": 0, "timestamp": 1.0, "imagePath": "a", "ocrText": "t", "clusterId": 3}],
             "clusters": [{"id": 3, "heuristicLabel": "code", "timeRange": [1.0, 2.0], "frameCount": 1, "representativeIdx": 0, "avgOcrCharacters": 1.0, "mediaIndicators": []}]}
    (tmp_path / "vis.json").write_text(json.dumps(index))
    shots, clusters = files.scan_visual_index(spark, str(tmp_path / "vis.json"))
    assert shots.first()["cluster_id"] == 3 and clusters.first()["to_ts"] == 2.0


def test_tables(spark, tmp_path):
    rows = spark.range(100).select(
        F.col("id").cast("string"), F.lit("d").alias("display_id"), F.lit(None).cast("timestamp").alias("captured_at"), (100.0 - F.col("id")).alias("timestamp"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("image_path", "string"), ("phash", "long"), ("width", "int"), ("height", "int"), ("analyzed", "int"), ("processing_lock_id", "string"),
                                                    ("processing_started_at", "timestamp"), ("retry_count", "int"), ("failed_at", "timestamp"), ("created_at", "timestamp"))],
    )
    tables.write_table(rows, str(tmp_path), "frames")
    back = tables.read_table(spark, str(tmp_path), "frames").where("timestamp < 11")
    assert back.count() == 10
    assert "PushedFilters: [IsNotNull(timestamp), LessThan(timestamp,11.0)]" in back._jdf.queryExecution().toString()


def test_documents_keep_their_order(spark, tmp_path):
    lines = spark.range(500).select(
        (F.col("id") % 2).alias("recording_id"), F.lit(1).alias("part"), (500 - F.col("id")).alias("n"), F.lit(0).alias("k"), F.lit(0.0).alias("at"), F.concat(F.lit("line "), 500 - F.col("id")).alias("line")
    )
    for _ in range(2):  # the second time replaces the first
        tables.write_documents(lines, str(tmp_path), format_name="card", buckets=3)
    text = [x.split("\t") for b in range(3) for p in sorted((tmp_path / "format=card" / f"bucket={b}").glob("part-*")) for x in p.read_text().splitlines()]
    for rec in (0, 1):
        assert [x for r, x in text if r == str(rec)] == [f"line {i}" for i in range(1, 501) if (500 - i) % 2 == rec]
    rows = tables.artifact_rows(lines, 1700000000, format_name="card").collect()
    assert sorted((r.recording_id, r.file_name, r.lines) for r in rows) == [(0, "0-card-1700000000.md", 250), (1, "1-card-1700000000.md", 250)]


def test_frames_of_one_folder_with_long_common_names(spark, tmp_path):
    for n in range(120):
        (tmp_path / f"rec{n % 2}").mkdir(exist_ok=True)
        (tmp_path / f"rec{n % 2}" / f"screenshot_{n:04d}.jpg").write_bytes(b"x")
    rows = files.scan_frame_dir(spark, str(tmp_path)).collect()
    assert sorted((r.recording_id, r.frame_index, r.image_path.rsplit("_", 1)[1]) for r in rows) == sorted((f"rec{n % 2}", n // 2, f"{n:04d}.jpg") for n in range(120))


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_continues_where_it_stopped(spark, tmp_path, batches):
    schema = "recording_id int, at timestamp, timestamp double"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def add(lo, hi):
        spark.range(lo, hi).select(F.lit(1).alias("recording_id"), F.timestamp_seconds("id").alias("at"), F.col("id").cast("double").alias("timestamp")).write.mode("append").parquet(source)

    from pyspark.sql import types as T

    def run():
        rows = live.stream_rows(spark, source, T.StructType.fromDDL(schema), "at", "5 seconds")
        return live.flush(live.closed_blocks(rows, "60 seconds"), path=target)

    for n in range(batches):
        add(n * 1000, n * 1000 + 10)
        out = run()
    assert sorted(r["observation_count"] for r in out.collect()) == [10] * (batches - 1)


def test_open_blocks_take_late_rows_and_count_later_ones(spark, tmp_path):
    """Four micro-batches: an open block, its late row that joins two blocks, and a row behind the watermark."""
    import time

    from pyspark.sql import types as T

    live.use_keyed_state(spark)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    watch = live.watch_late_rows(spark)
    ids = set()

    def run(n, times):
        rows = spark.createDataFrame([(1, float(x)) for x in times], "recording_id int, timestamp double").coalesce(1)
        rows.select("recording_id", F.timestamp_seconds("timestamp").alias("at"), "timestamp").write.mode("append").parquet(source)
        stream = live.stream_rows(spark, source, T.StructType.fromDDL("recording_id int, at timestamp, timestamp double"), "at", "500 seconds")
        writer = live.open_blocks(stream, 60.0).writeStream.outputMode("update").option("checkpointLocation", f"{target}/state")
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{target}/data/version={n * 100 + i}")).trigger(availableNow=True).start()
        query.awaitTermination()
        ids.add(query)
        changes = spark.read.parquet(f"{target}/data").groupBy("from_ts").agg(F.max_by(F.struct("to_ts", "observation_count", "is_open"), "version").alias("b"))
        return sorted(tuple(r) for r in changes.where("b.observation_count > 0").select("from_ts", "b.to_ts", "b.observation_count", "b.is_open").collect())

    assert run(0, [1000, 1030]) == [(1000.0, 1030.0, 2, True)]
    assert run(1, [1130, 1150]) == [(1000.0, 1030.0, 2, False), (1130.0, 1150.0, 2, True)]
    # Within the gap of both: they are one block.
    assert run(2, [1080, 1300]) == [(1000.0, 1150.0, 5, False), (1300.0, 1300.0, 1, True)]
    assert run(3, [5000]) == [(1000.0, 1150.0, 5, False), (1300.0, 1300.0, 1, False), (5000.0, 5000.0, 1, True)]
    assert run(4, [1310, 5010])[-1] == (5000.0, 5010.0, 2, True)
    for _ in range(100):
        if sum(live.late_rows(q, watch) for q in {q.id: q for q in ids}.values()):
            break
        time.sleep(0.1)
    spark.streams.removeListener(watch)
    assert sum(live.late_rows(q, watch) for q in {q.id: q for q in ids}.values()) == 1
