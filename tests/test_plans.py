"""Plan builders against straightforward single-key code, with one key holding most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.operators import frames, segments
from dayweave.plans import ordered
from dayweave.plans.fold import ordered_fold
from dayweave.plans.graphs import connected_components, first_independent
from dayweave.plans.ranges import binned_pairs, cover


def rows(seed: int, n: int = 400):
    """Key 0 holds two thirds of the rows; times repeat and leave gaps."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.67 else rng.randint(1, 4), float(rng.randint(0, 900)), i, rng.choice("aab")) for i in range(n)]


@pytest.fixture(params=[1, 2])
def data(request, spark):
    plain = rows(request.param)
    return plain, spark.createDataFrame(plain, "key int, ts double, id long, label string")


def by_key(plain):
    groups = {}
    for r in sorted(plain, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("width", [7.0, 60.0, 5000.0])
def test_islands(data, width):
    plain, df = data
    want = {}
    for group in by_key(plain).values():
        start, prev = None, None
        for r in group:
            if prev is None or r[3] != prev[3]:
                start = r[2]
            want[r[2]], prev = start, r
    got = ordered.islands(df, ["key"], ["ts", "id"], lambda a, b: a["label"] != b["label"], ["label"], width=width)
    assert {r["id"]: r["run_id"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [7.0, 60.0])
def test_carry_and_index(data, width):
    plain, df = data
    back, ahead, place = {}, {}, {}
    for group in by_key(plain).values():
        for i, r in enumerate(group):
            before = [x[2] for x in group[:i] if x[3] == "b"]
            after = [x[2] for x in group[i + 1 :] if x[3] == "b"]
            back[r[2]], ahead[r[2]], place[r[2]] = before[-1] if before else None, after[0] if after else None, i
    value = {"v": F.when(F.col("label") == "b", F.col("id"))}
    got = ordered.carry(df, ["key"], ["ts", "id"], value, width=width)
    assert {r["id"]: r["v"] for r in got.collect()} == back
    got = ordered.carry(df, ["key"], ["ts", "id"], value, forward=True, width=width)
    assert {r["id"]: r["v"] for r in got.collect()} == ahead
    got = ordered.row_index(df, ["key"], ["ts", "id"], "n", width=width)
    assert {r["id"]: r["n"] for r in got.collect()} == place


def test_without_key(data):
    plain, df = data
    got = ordered.row_index(df, [], ["ts", "id"], "n", width=50.0)
    want = {r[2]: i for i, r in enumerate(sorted(plain, key=lambda r: (r[1], r[2])))}
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_a_burst_without_keys_is_spread(spark, monkeypatch):
    """Nine tenths of the rows in one second of a day: chunks follow the rows, not the time."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 100)
    rng = random.Random(9)
    plain = [(rng.uniform(40_000, 40_001) if rng.random() < 0.9 else rng.uniform(0, 86_400), i) for i in range(5000)] + [(None, 9000)]
    df = spark.createDataFrame(plain, "ts double, id long")
    sizes = ordered.chunked(df, [], "ts", 3600.0).groupBy("_chunk").count().collect()
    assert len(sizes) >= 40 and max(r["count"] for r in sizes) <= 300
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = ordered.row_index(df, [], ["ts", "id"], "n")
    assert {r["id"]: r["n"] for r in got.collect()} == {i: n for n, (_, i) in enumerate(order)}
    blocks = segments.gap_blocks(df.where("ts is not null"), 30.0, (), ts="ts")
    times = sorted(t for t, _ in plain if t is not None)
    assert blocks.count() == 1 + sum(b - a > 30 for a, b in zip(times, times[1:]))


@pytest.mark.parametrize("width", [10.0, 2000.0])
def test_trailing_count(data, width):
    plain, df = data
    want = {r[2]: sum(1 for x in plain if x[0] == r[0] and r[1] - 45 <= x[1] <= r[1] and x[3] == "b") for r in plain}
    got = ordered.trailing_count(df, ["key"], "ts", F.col("label") == "b", 45, "n", width=width)
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_pairs(spark):
    rng = random.Random(3)
    spans = lambda: [(0 if rng.random() < 0.6 else 1, i, s, s + rng.choice([0.0, 3.0, 50.0, 400.0])) for i, s in enumerate(float(rng.randint(0, 500)) for _ in range(60))]
    a, b = spans(), spans()
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    left = spark.createDataFrame(a, "key int, a long, s1 double, e1 double")
    right = spark.createDataFrame(b, "key int, b long, s2 double, e2 double")
    got = [tuple(r) for r in binned_pairs(left, right, ["key"], ("s1", "e1"), ("s2", "e2"), F.expr("s1 < e2 and s2 < e1"), width=20.0).select("a", "b").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("width", [0.5, 7.0])
def test_pairs_of_spans_of_all_lengths(spark, width):
    rng = random.Random(8)
    spans = lambda n: [(rng.choice([0, 0, 1, 2]), i, s, s + rng.choice([-1.0, 0.0, 0.25, 1.0, 40.0, 3000.0])) for i, s in enumerate(rng.uniform(-500, 2500) for _ in range(n))]
    a, b = spans(150), spans(150)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    left = spark.createDataFrame(a, "key int, a long, s1 double, e1 double")
    right = spark.createDataFrame(b, "key int, b long, s2 double, e2 double")
    got = binned_pairs(left, right, ["key"], ("s1", "e1"), ("s2", "e2"), F.expr("s1 <= e2 and s2 <= e1"), width=width)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


def test_a_long_span_is_few_rows(spark):
    """A year among seconds: no more rows than two a level, and they make up the span exactly."""
    year = 365 * 86400
    for low, high in [(0, year), (12345, 12345 + year), (-7, -7), (5, 4), (-year, year)]:
        cells = spark.range(1).select(cover(F.lit(low), F.lit(high)).alias("c")).first().c
        assert len(cells) <= 64
        assert sum(1 << c.level for c in cells) == max(0, high - low + 1)
        assert not cells or (min(c.node << c.level for c in cells), max((c.node + 1) << c.level for c in cells)) == (low, high + 1)
    long = spark.createDataFrame([(1, 0, 0.0, float(year))] + [(1, i, float(i * 100), i * 100 + 1.0) for i in range(1, 400)], "key int, a long, s1 double, e1 double")
    points = spark.createDataFrame([(1, i, i * 77.0, i * 77.0 + 1) for i in range(500)], "key int, b long, s2 double, e2 double")
    got = binned_pairs(long, points, ["key"], ("s1", "e1"), ("s2", "e2"), F.expr("s1 < e2 and s2 < e1"), width=1.0)
    assert got.where("a = 0").count() == 500


@pytest.mark.parametrize("width", [5.0, 40.0, 5000.0])
def test_fold_needs_its_predecessors(data, width):
    """A state that never forgets: the fold must pass it through every chunk."""
    plain, df = data

    def step(total, row):
        total = (total * 31 + row[1]) % 1009
        return total, [(row[0], row[1], total)]

    want = {}
    for group in by_key(plain).values():
        total = 0
        for r in group:
            total = (total * 31 + r[2]) % 1009
            want[r[2]] = total
    schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("total", T.LongType())])
    few = df if width > 100 else df.where("ts < 120")
    got = ordered_fold(few, ["key"], ["ts", "id"], ["key", "id"], step, 0, schema, width=width)
    found = {r["id"]: r["total"] for r in got.collect()}
    assert found and found == {k: v for k, v in want.items() if k in found}
    assert len(found) == few.count()


def merged(runs, minimum):
    """Plain form of the short-run merge: list of lists of run numbers."""
    result = [{"s": s, "e": e, "m": [i]} for i, (s, e) in enumerate(runs)]
    at = 0
    while at < len(result):
        seg = result[at]
        prev = result[at - 1] if at else None
        after = result[at + 1] if at + 1 < len(result) else None
        if seg["e"] - seg["s"] >= minimum or (prev is None and after is None):
            at += 1
            continue
        if prev is None or (after is not None and prev["e"] - prev["s"] < after["e"] - after["s"]):
            home = after
        else:
            home = prev
        home["m"] += seg["m"]
        home["s"], home["e"] = min(home["s"], seg["s"]), max(home["e"], seg["e"])
        del result[at]
    return [r["m"] for r in result]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_short_runs(spark, seed):
    rng = random.Random(seed)
    data, want = [], {}
    for rec in range(4):
        at, runs = 0.0, []
        for _ in range(60 if rec == 0 else rng.randint(1, 12)):
            length = rng.choice([0.0, 5.0, 10.0, 40.0])
            runs.append((at, at + length))
            at += length + rng.choice([1.0, 20.0])
        data += [(rec, s, i, s, e) for i, (s, e) in enumerate(runs)]
        for members in merged(runs, 30.0):
            want.update({(rec, m): (members[0], n) for n, m in enumerate(members)})
    runs = spark.createDataFrame(data, "recording_id int, run_ts double, run_id long, start_time double, end_time double")
    for width in (25.0, 10_000.0):
        got = segments.merge_short_segments(runs, 30.0, width=width).collect()
        assert {(r["recording_id"], r["run_id"]): (r["anchor_id"], r["position"]) for r in got} == want


def test_near_duplicates_in_short_chunks(spark):
    rng = random.Random(5)
    data = [(0 if i % 3 else 1, float(i), i, rng.choice([0, 1, 3, 255, 2**40 + 5, -1])) for i in range(200)]
    df = spark.createDataFrame(data, "display_id int, timestamp double, id long, phash long")
    want = set()
    for display in (0, 1):
        kept = None
        for d, _, i, h in data:
            if d == display and (kept is None or ((h ^ kept) & (2**64 - 1)).bit_count() > 4):
                kept = h
                want.add(i)
    assert {r["id"] for r in frames.drop_near_duplicates(df, 4, width=9.0).collect()} == want


def test_similarity_pairs_find_every_pair(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(6)]
    hashes = base + [b ^ sum(1 << p for p in rng.sample(range(63), rng.randint(1, 6))) for b in base for _ in range(8)] + [base[0]] * 50
    got = {(r["hash_a"], r["hash_b"]): r for r in frames.similarity_pairs(spark.createDataFrame([(h,) for h in hashes], "phash long"), 4).collect()}
    distinct = sorted(set(hashes))
    want = {(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4}
    assert set(got) == want
    assert all(r["frames_a"] >= 50 for (a, b), r in got.items() if a == base[0])


def test_components_and_independent_set(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            hi, lo = max(find(a), find(b)), min(find(a), find(b))
            parent[hi] = lo
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {n: find(n) for a, b in pairs if a != b for n in (a, b)}
    edges = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    accepted = set()
    for n in range(130):
        if not any((m, n) in edges for m in accepted):
            accepted.add(n)
    nodes = spark.range(130).select(F.col("id").cast("int").alias("node"), F.col("id").alias("rank"))
    found = first_independent(nodes, spark.createDataFrame(sorted(edges), "earlier int, later int"))
    assert {r["node"] for r in found.collect()} == accepted


@pytest.mark.parametrize("step", [7.0, 2.1, 0.97])
def test_fold_rounds_do_not_grow_with_the_chunks(spark, step, monkeypatch):
    """A steady frame rate keeps its phase for ever; rounds follow from the phases, not from the chunks."""
    from dayweave.operators.frames import sample_base
    from dayweave.plans import fold

    hours, rounds, plain = 120, [], []
    found_empty = fold.DataFrame.isEmpty
    monkeypatch.setattr(fold.DataFrame, "isEmpty", lambda self: rounds.append(1) or found_empty(self))
    n = int(hours * 3600 / step)
    frames = spark.range(n).selectExpr("1L as recording_id", "id", f"round(id * {step}D, 2) as timestamp")
    found = [r.id for r in sample_base(frames, 10.0).select("id").orderBy("id").collect()]
    last = None
    for i in range(n):
        at = round(i * step, 2)
        if last is None or at - last >= 10.0:
            plain.append(i)
            last = at
    assert found == plain
    assert len(rounds) <= 14


def test_the_grid_of_required_timestamps_is_not_shuffled(spark):
    lengths = [(1, 100.0), (1, 47.0), (2, 33.5), (3, 0.0), (4, 61.0)]
    cuts = [(1, 20.0), (1, 12.4), (1, 12.2), (1, 80.0), (2, 30.0), (2, 34.0), (4, 7.0), (9, 1.0)]
    recordings = spark.createDataFrame(lengths, "id long, duration double")
    scenes = spark.createDataFrame(cuts, "recording_id long, timestamp double")
    for base, threshold, fill in ((10, 15, 3), (30, 15, 4)):
        found = frames.required_timestamps(recordings, scenes, base, threshold, fill)
        wanted = []
        for rec in {r for r, d in lengths if d > 0}:
            grid = {s for r, d in lengths if r == rec for s in range(0, int(d) + 1, base)}
            marks = {int(t + 0.5) for r, t in cuts if r == rec for q, d in lengths if q == rec and int(t + 0.5) <= d}
            some = sorted(grid | marks)
            wanted += [(rec, s) for s in some]
            given = sum(r == rec for r, _ in lengths)
            wanted += [(rec, s) for a, b in zip(some, some[1:]) if b - a > threshold for s in range(a + fill, b, fill)] * given
        assert sorted((r.recording_id, r.second) for r in found.collect()) == sorted(wanted)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Aggregate")


def test_fold_makes_no_call_per_key(spark, capsys):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("n", T.LongType())])
    rows = spark.range(0, 400, 1, 4).selectExpr("id % 40 AS k", "CAST(id AS DOUBLE) AS t")
    step = lambda state, row: (state + 1, [(*row, state + 1)])
    found = ordered_fold(rows, ["k"], ["t"], ["k", "t"], step, 0, schema, width=50.0)
    assert sorted((r.k, r.t, r.n) for r in found.collect()) == [(k, float(k + 40 * n), n + 1) for k in range(40) for n in range(10)]
    found.explain()
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out
