"""Gap sweeps and runs of artifacts against plain code; the capture guard fed out of order."""

from __future__ import annotations

import random

import pytest

from dayweave.operators import frames, joins, segments
from dayweave.plans.ranges import ancestors, cover
from dayweave.streaming import live


def plain_sweep(rows, gaps):
    out = {}
    for gap in gaps:
        blocks = []
        for key in sorted({r[0] for r in rows}):
            times = sorted(t for k, t, _ in rows if k == key)
            start = times[0]
            count = 1
            for a, b in zip(times, times[1:] + [None]):
                if b is None or b - a > gap:
                    blocks.append((a - start, count))
                    start, count = b, 0
                count += 1
        n = len(blocks)
        out[gap] = (n, sum(d for d, _ in blocks) / n, 100 * sum(d < 30 for d, _ in blocks) / n, 100 * sum(c < 3 for _, c in blocks) / n, sum(c for _, c in blocks) / n)
    return out


@pytest.mark.parametrize("gaps", [[5.0], [60.0, 5.0, 12.5, 12.5], [float(g) for g in range(1, 51)]])
def test_gap_sweep_equals_plain_code(spark, gaps):
    draw = random.Random(len(gaps))
    rows, at = [], {0: 0.0, 1: 50.0}
    for i in range(600):
        key = 0 if draw.random() < 0.7 else 1
        at[key] += draw.choice([0.0, 1.0, 4.0, 5.0, 13.0, 47.0, 5000.0])
        rows.append((key, at[key], i))
    df = spark.createDataFrame(rows, "recording_id int, timestamp double, id long")
    got = segments.gap_sweep(df, gaps, ["recording_id"]).collect()
    want = plain_sweep(rows, sorted(set(gaps)))
    assert {r.gap: (r.blocks, r.avg_duration, r.under_30s_percent, r.under_3_percent, r.avg_observations) for r in got} == {g: pytest.approx(v) for g, v in want.items()}
    best = max(want, key=lambda g: (want[g][1] * want[g][4] / want[g][0], -g))
    assert [r.gap for r in got if r.best] == [best]


def test_gap_sweep_reads_rows_once(spark):
    """The rows of the table go through one scan however many gaps there are: later scans read blocks."""
    df = spark.range(3000).selectExpr("1 as recording_id", "id", "cast(id as double) as timestamp")
    got = segments.gap_sweep(df, [float(g) for g in range(1, 51)], ["recording_id"]).collect()
    assert len(got) == 50 and {r.blocks for r in got} == {1} and {r.avg_observations for r in got} == {3000.0}


def plain_runs(arts, runs):
    out = {}
    for i, rec, at in arts:
        fit = [(s, r) for r, k, s, e, status in runs if k == rec and status == "completed" and at is not None and s is not None and s <= at and (e is None or e >= at)]
        out[i] = max(fit)[1] if fit else None
    return out


def tables_of(spark, arts, runs):
    return spark.createDataFrame(arts, "id long, recording_id int, created_at double"), spark.createDataFrame(runs, "id long, recording_id int, started_at double, completed_at double, status string")


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_artifacts_equal_plain_code(spark, seed):
    draw = random.Random(seed)
    arts = [(i, draw.choice([0, 0, 0, 1, 2]), draw.choice([None, *map(float, range(60))])) for i in range(120)]
    runs = []
    for i in range(90):
        start = float(draw.randrange(60))
        runs.append((i, draw.choice([0, 0, 0, 1]), draw.choice([start] * 9 + [None]), draw.choice([None, start, start + draw.randrange(40), start - 1]), draw.choice(["completed", "completed", "failed"])))
    a, r = tables_of(spark, arts, runs)
    assert {x.id: x.run_id for x in joins.run_for_artifact(a, r).collect()} == plain_runs(arts, runs)


def test_many_overlapping_runs_make_no_product(spark):
    """Every artifact lies in every run; what meets is a few rows each, not all runs."""
    n = 10_000
    a = spark.range(n).selectExpr("id", "1 as recording_id", "cast(id as double) + 20000 as created_at")
    r = spark.range(n).selectExpr("id", "1 as recording_id", "cast(id as double) as started_at", "cast(100000 - id as double) as completed_at", "'completed' as status")
    found = joins.run_for_artifact(a, r)
    assert found.where("run_id = 9999").count() == n
    # The rows of both sides of the join grow with n log n.
    line = spark.range(3 * n).selectExpr("id as pos")
    from pyspark.sql import functions as F

    asked = line.select(F.size(ancestors(F.col("pos"), F.lit(15))).alias("n")).agg(F.max("n")).first()[0]
    cells = line.select(F.size(cover(F.col("pos"), 3 * n - F.col("pos"))).alias("n")).agg(F.max("n")).first()[0]
    assert asked == 16 and cells <= 30


FRAMES = "display_id int, id long, timestamp double, phash long"


def fed(spark, tmp_path, batches, **options):
    live.use_keyed_state(spark)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    found = []
    for n, rows in enumerate(batches):
        # A day after the epoch, where an empty stream's watermark stands.
        spark.createDataFrame([(d, i, ts + 86400, h) for d, i, ts, h in rows], FRAMES).coalesce(1).selectExpr("*", "timestamp_micros(cast(timestamp * 1e6 as bigint)) as at").write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        stream = live.stream_rows(spark, folder, schema, "at", "60 seconds")
        found = live.flush(live.capture_guard(stream, **options), path=out).collect()
    return sorted(r.id for r in found)


def test_frames_out_of_order_give_the_batch_result(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i % 2, i, i * 2.0, draw.choice([0, 1, 3, 255, 2**40 - 1, draw.getrandbits(60)])) for i in range(300)]
    # Each batch is shuffled, and neighbouring batches exchange what lies within the watermark.
    shaken = sorted(rows, key=lambda r: r[2] + draw.uniform(0, 50))
    parts = [shaken[:100], shaken[100:200], shaken[200:], [(d, 1000 + d, 100_000.0, 7) for d in (0, 1)]]
    for part in parts[:3]:
        draw.shuffle(part)
    options = {"threshold": 4, "window": 20.0, "limit": 5, "interval": 6.0}
    got = fed(spark, tmp_path, parts, **options)
    batch = frames.throttle(spark.createDataFrame(rows, FRAMES), options["interval"], 4, options["window"], options["limit"])
    assert got == sorted(r.id for r in batch.collect())


def test_idle_displays_leave_the_state(spark, tmp_path):
    parts = [[(0, 1, 0.0, 7)], [(1, 2, 1000.0, 7)], [(0, 3, 2000.0, 7)], [(1, 4, 9000.0, 7)]]
    # Display 0 was forgotten before its second frame came; with a longer memory it is a duplicate.
    assert fed(spark, tmp_path / "a", parts, idle=500.0) == [1, 2, 3]
    assert fed(spark, tmp_path / "b", parts, idle=50_000.0) == [1, 2]
