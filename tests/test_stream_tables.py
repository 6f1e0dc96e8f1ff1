from __future__ import annotations

from dayweave.catalog.base import Tables
from dayweave.catalog.streams import stream
from dayweave.streaming import live


def test_tables_stream_from_files_and_folders(spark, tmp_path):
    rows = spark.range(6).selectExpr("id", "timestamp_seconds(id) AS ts")
    rows.repartition(3).write.parquet(f"{tmp_path}/a/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/b")
    (tmp_path / "c").mkdir()
    next((tmp_path / "b").glob("part-*")).rename(tmp_path / "c/events.parquet")
    for folder in ("a", "c", "a/"):
        found = live.flush(stream(Tables(spark, f"{tmp_path}/{folder}"), "events", "ts"))
        assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 4, 5]
