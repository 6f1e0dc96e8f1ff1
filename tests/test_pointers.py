"""Next-kept pointers against plain sequential code, with rounds that do not follow the number of chunks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from dayweave.operators import frames
from dayweave.plans import pointers

FRAMES = "display_id int, timestamp double, id long, phash long"


def bits(x):
    return (x & (2**64 - 1)).bit_count()


def plain_drop(data, threshold=4):
    kept, out = {}, set()
    for d, _, i, h in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        if d not in kept or h is None or kept[d] is None or bits(h ^ kept[d]) > threshold:
            kept[d] = h
            out.add(i)
    return out


def plain_spaced(rows, gap, first_counts=True):
    """``rows`` (ts, id, mark) of one key."""
    last, out = None, []
    for n, (ts, i, mark) in enumerate(sorted(rows)):
        if last is None or mark or ts - last >= gap:
            last = ts
            if not mark and (n or first_counts):
                out.append(i)
    return out


@pytest.fixture(autouse=True)
def narrow_chunks(monkeypatch):
    """Chunks stay as narrow as a test asks for."""
    monkeypatch.setattr(pointers, "FILL", 1)


@pytest.fixture
def rounds(monkeypatch):
    """Counts the jobs that the builder waits for."""
    count = []
    real = pointers.DataFrame.checkpoint
    monkeypatch.setattr(pointers.DataFrame, "checkpoint", lambda self, *a: count.append(1) or real(self, *a))
    return count


def flicker(n, seed=0):
    """Hashes whose kept ones depend on the first for ever: each differs from the last two in too few bits, or in just enough."""
    draw = random.Random(seed)
    base = [0, 0b111, 0b111111, 0b111111000]
    return [base[draw.randrange(4)] for _ in range(n)]


def test_a_stream_that_never_forgets_its_start(spark, rounds):
    # Two interleaved paths: hash k and k+2 differ in six bits, neighbours in three; they never meet.
    cycle = [0, 0b111, 0b111111, 0b111000]
    data = [(0, float(i), i, cycle[i % 4]) for i in range(240 * 30)]
    found = frames.drop_near_duplicates(spark.createDataFrame(data, FRAMES), 4, width=30.0)
    assert {r["id"] for r in found.collect()} == plain_drop(data)
    assert len(rounds) <= 12


@pytest.mark.parametrize("fanout", [2, 64])
def test_hashes_equal_plain_code(spark, monkeypatch, fanout):
    monkeypatch.setattr(pointers, "FANOUT", fanout)
    monkeypatch.setattr(pointers.Different, "NEAR", 3)
    draw = random.Random(fanout)
    data = []
    for d, hashes in enumerate([flicker(700, 1), [7] * 400 + [draw.getrandbits(63) for _ in range(50)] + [9] * 300 + [-1], [draw.choice([None, 0, 255, -1]) for _ in range(200)], [5]]):
        data += [(d, i * 1.5 + draw.randrange(3) / 4, 10_000 * d + i, h) for i, h in enumerate(hashes)]
    found = frames.drop_near_duplicates(spark.createDataFrame(data, FRAMES), 4, width=12.0)
    assert {r["id"] for r in found.collect()} == plain_drop(data)


def test_a_quiet_picture_is_passed_in_few_rounds(spark, rounds):
    """The kept state crosses hundreds of chunks before something differs."""
    quiet = [0b1, 0b11, 0b10]
    data = [(0, float(i), i, quiet[i % 3]) for i in range(4000)] + [(0, 4000.0, 4000, 2**40 - 1)] + [(0, 4001.0 + i, 4001 + i, 2**40 - 1 - (i % 2)) for i in range(3000)]
    found = frames.drop_near_duplicates(spark.createDataFrame(data, FRAMES), 4, width=10.0)
    assert {r["id"] for r in found.collect()} == plain_drop(data) == {0, 4000}
    assert len(rounds) <= 20


def plain_throttle(data, interval, threshold, window, limit):
    out, seen = set(), {}
    for d, ts, i, h in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        s = seen.setdefault(d, {"last": None, "moves": [], "kept": None, "held": None})
        if s["last"] is not None and bits(h ^ s["last"]) > threshold:
            s["moves"].append(ts)
        s["last"] = h
        s["moves"] = [m for m in s["moves"] if ts - m <= window]
        slow = len(s["moves"]) > limit
        if not slow:
            s["held"] = None
        if s["kept"] is not None and bits(h ^ s["kept"]) <= threshold:
            continue
        if slow:
            if s["held"] is not None and ts - s["held"] < interval:
                continue
            s["held"] = ts
        s["kept"] = h
        out.add(i)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_throttle_equals_plain_code(spark, seed):
    draw = random.Random(seed)
    data, at = [], 0.0
    for i in range(1500):
        # Distinct times: churn counts all rows of a time at once.
        at += draw.choice([0.5, 1.0, 2.0, 30.0] if draw.random() < 0.02 else [0.5, 1.0])
        busy = (i // 200) % 2
        data.append((i % 2, at, i, draw.getrandbits(60) if busy or draw.random() < 0.05 else 3))
    found = frames.throttle(spark.createDataFrame(data, FRAMES), 6.0, 4, 20.0, 8, width=10.0)
    assert {r["id"] for r in found.collect()} == plain_throttle(data, 6.0, 4, 20.0, 8)


@pytest.mark.parametrize("fanout", [2, 64])
@pytest.mark.parametrize("step", [0.97, 2.1, 7.0, 23.0])
def test_spaced_rows_equal_plain_code(spark, monkeypatch, step, fanout):
    monkeypatch.setattr(pointers, "FANOUT", fanout)
    n = 1200
    rows = [(round(i * step, 2), i) for i in range(n)]
    df = spark.createDataFrame([(1, t, i) for t, i in rows] + [(2, 5.0, n)], "recording_id int, timestamp double, id long")
    found = sorted(r["id"] for r in frames.sample_base(df, 10.0, width=1.0).collect())
    assert found == sorted(plain_spaced([(t, i, False) for t, i in rows], 10.0) + [n])


def test_many_chunks_need_few_rounds(spark, rounds):
    df = spark.range(200_000).selectExpr("1 as recording_id", "round(id * 3.7D, 1) as timestamp", "id")
    found = frames.sample_base(df, 10.0, width=100.0).count()
    last, want = None, 0
    for i in range(200_000):
        t = round(i * 3.7, 1)
        if last is None or t - last >= 10.0:
            last, want = t, want + 1
    # 3,700 chunks of 200 s.
    assert found == want and len(rounds) <= 12


def test_marks_restart_the_clock(spark):
    draw = random.Random(4)
    rows = [(i * 1.0, i, draw.random() < 0.07) for i in range(900)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, t, i, m) for t, i, m in rows], "recording_id int, timestamp double, id long, mark boolean")
    for counts in (True, False):
        found = frames._greedy(df, ["recording_id"], F.lit(10.0), F.col("mark"), counts, 200.0)
        assert sorted(r["id"] for r in found.collect()) == plain_spaced(rows, 10.0, counts)


def test_sparse_rows_have_wider_chunks(spark, monkeypatch):
    monkeypatch.setattr(pointers, "FILL", 50)
    data = [(i % 3, i * 7200.0, i, flicker(1, i)[0]) for i in range(900)]
    seen, real = [], pointers._visited
    monkeypatch.setattr(pointers, "_visited", lambda nodes, *a: seen.append(nodes.select("display_id", "_chunk").distinct().count()) or real(nodes, *a))
    found = frames.drop_near_duplicates(spark.createDataFrame(data, FRAMES), 4)
    assert {r["id"] for r in found.collect()} == plain_drop(data)
    assert seen[0] <= 3 * 8


def test_rows_without_a_time_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 2.0, 2)], "recording_id int, timestamp double, id long")
    assert [r["id"] for r in frames.sample_base(df).collect()] == [2]
    assert frames.sample_base(df.limit(0)).collect() == []
    empty = spark.createDataFrame([], FRAMES)
    assert frames.drop_near_duplicates(empty).collect() == []
    assert frames.drop_near_duplicates(empty, keys=()).collect() == []


def test_without_keys(spark):
    data = [(i % 3, float(i), i, flicker(1, i)[0]) for i in range(500)]
    found = frames.drop_near_duplicates(spark.createDataFrame(data, FRAMES), keys=(), width=20.0)
    assert {r["id"] for r in found.collect()} == plain_drop([(0, *r[1:]) for r in data])


def test_differences_decide_not_sums():
    times = np.array([0.1 * i for i in range(200)])
    at = pointers.first_reached(times, times, 0.3)
    assert at.tolist() == [next((j for j in range(200) if times[j] - t >= 0.3), 200) for t in times]


def test_runs_across_batches_and_nulls():
    batches = [pa.RecordBatch.from_pydict({"k": k, "c": c}) for k, c in [(["a", "a", None], [1, 1, 1]), ([None, None], [1, 2]), ([], []), (["b"], [2])]]
    batches = [b.cast(pa.schema([("k", pa.string()), ("c", pa.int64())])) for b in batches]
    assert [(t.column("k")[0].as_py(), t.num_rows) for t in pointers.runs(iter(batches), ["k", "c"])] == [("a", 2), (None, 2), (None, 1), ("b", 1)]
