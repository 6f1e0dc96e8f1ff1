from __future__ import annotations

from pathlib import Path

from dayweave.catalog import inputs
from dayweave.catalog.base import QUERIES, Tables


def test_sparse_recordings_share_files(spark, tmp_path):
    events = spark.range(1500).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "1.0 AS value", "concat('{\"k\": ', id, '}') AS props"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    spans = QUERIES["scan_vad_manifest"](spark, str(tmp_path))
    assert spans.count() == 1500 and len(spans.inputFiles()) <= 2
    folder = Path(inputs.visual_folder(Tables(spark, str(tmp_path))))
    assert len(list(folder.glob("part-*"))) <= 4
    for name in ("scan_visual_frames", "scan_visual_clusters"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 1500


def test_scene_log_keeps_every_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.004), (3, 2.5)], "user_id long, value double")
    rows.selectExpr("user_id AS event_id", "timestamp_seconds(user_id) AS ts", "user_id", "'view' AS event_type", "value", "'{\"k\": 0}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["scan_scene_log"](spark, str(tmp_path)).collect()
    assert sorted((r.recording_id, r.ts) for r in got) == [(1, 0.0), (2, 0.0), (3, 2.5)]


def test_many_tasks_write_the_files_of_one_partition(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 5 AS shelf", "concat('v', id) AS value").coalesce(1)
    folder = inputs.one_file_each(rows, f"{tmp_path}/out", "shelf")
    made = [p.name for p in Path(folder).glob("shelf=*/part-*")]
    assert len(made) == 200 and len({name.split("-")[1] for name in made}) > 8
