"""Steps whose cost must not outgrow the rows: join kinds, window frames, files written."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dayweave.operators import frames
from dayweave.plans import ordered
from dayweave.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_similarity_sides_are_not_broadcast(spark):
    pairs = frames.similarity_pairs(spark.range(1000).select(F.col("id").alias("phash")))
    assert "Broadcast" not in plan(pairs) and "SortMergeJoin" in plan(pairs)


def test_similarity_rows_are_a_hash_and_a_number(spark):
    """A hash becomes many rows on the disk, so these carry no bands and no keys, and both sides read the same."""
    pairs = frames.similarity_pairs(spark.range(1000).select((F.col("id") * F.col("id") * 8191).alias("phash")))
    node = pairs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    for side in (node.children().apply(0), node.children().apply(1)):
        kinds = [side.output().apply(i).dataType().simpleString() for i in range(side.output().size())]
        assert sorted(kinds) == ["bigint", "bigint", "int"]
    pairs.collect()
    assert "ReusedExchange" in plan(pairs)


@pytest.mark.parametrize("far", [0, 1, 4, 9])
def test_similarity_of_any_distance(spark, far):
    draw = random.Random(far)
    base = [draw.getrandbits(64) for _ in range(5)]
    hashes = base + [b ^ sum(1 << p for p in draw.sample(range(64), draw.randint(1, far + 2))) for b in base for _ in range(12)]
    hashes = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    rows = spark.createDataFrame([(h,) for h in [*hashes, hashes[0], None]], "phash long")
    got = [(r.hash_a, r.hash_b, r.frames_a, r.distance) for r in frames.similarity_pairs(rows, far).collect()]
    apart = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a in hashes for b in hashes if a < b}
    assert sorted(got) == sorted((a, b, 1 + (a == hashes[0]), d) for (a, b), d in apart.items() if d <= far)


def test_trailing_count_passes_rows_once(spark):
    times = [0.0, 0.0, 10.0, 10.0, 20.0, 45.0, 55.0, 55.0, 55.5, None, None]
    rows = spark.createDataFrame([(1, i, t, i % 3 != 1) for i, t in enumerate(times)], "key int, id long, ts double, hit boolean")
    for width in (45.0, 1000.0):
        counts = ordered.trailing_count(rows, ["key"], "ts", F.col("hit"), 45, "n", width=width)
        want = {i: sum(1 for j, u in enumerate(times) if j % 3 != 1 and (u is None if t is None else u is not None and t - 45 <= u <= t)) for i, t in enumerate(times)}
        assert {r.id: r.n for r in counts.collect()} == want
    # A frame with both ends moving is counted anew for every row.
    assert "RangeFrame, -" not in plan(counts)


class Clock(float):
    """A time that counts how often it is compared with another."""

    asked = 0

    def __sub__(self, other):
        Clock.asked += 1
        return Clock(float(self) - float(other))


def test_capture_guard_looks_at_a_change_twice_at_most():
    class Last:
        def exists(self):
            return False

        def update(self, state):
            self.state = state

    guard = live._CaptureGuard("long", 4, 100.0, 5, 1.0, 1e9)
    guard.last = Last()
    rows = [(Clock(i), i, (i % 2) * 255) for i in range(400)]
    assert len(guard._released(rows, (1,))) == 400
    assert guard.last.state[3] == [float(i) for i in range(299, 400)]
    assert Clock.asked < 5 * len(rows)
