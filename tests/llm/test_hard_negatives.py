from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.llm import hard_negatives as H
from dayweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string, size string, tag string"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in rows], SCHEMA)


def plain(rows, every, positives=5, negatives=3, low=50, high=95):
    """The definition, every pair of every anchor."""
    good = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in good:
        if a[0] % every:
            continue
        met = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in good if r is not a and len(r[2]) == len(a[2])]
        met.sort()
        for s, p, _ in [m for m in met if m[2] == a[1]][:positives]:
            fit = [m for m in met if m[2] != a[1] and low * -s <= 100 * -m[0] <= high * -s][:negatives]
            out += [(a[0], p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, every=50, **options):
    return sorted(tuple(r) for r in H.mine(df, F.col("id") % every == 0, **options).select(OUT).collect())


def random_rows(count, dim, seed, labels=3):
    draw = random.Random(seed)
    return [(i, [draw.choice([-0.5, 0.0, 0.25, 1.0, 2.0]) for _ in range(dim)], draw.randrange(labels)) for i in range(count)]


@pytest.mark.parametrize("dim", [1, 2, 5])
def test_equals_brute_force_with_many_ties(spark, dim):
    rows = random_rows(300, dim, dim)
    assert mined(table_of(spark, rows), 10) == plain(rows, 10)


def test_blocks_of_few_rows_give_the_same(spark, monkeypatch):
    rows = random_rows(240, 4, 7, labels=2)
    whole = mined(table_of(spark, rows), 5)
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "ROWS", 20)
    monkeypatch.setattr(H, "SLICE", 6)
    assert mined(table_of(spark, rows), 5) == whole == plain(rows, 5)


def test_a_label_with_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 50)
    rows = [(i, v, 0 if i % 20 else 1) for i, v, _ in random_rows(400, 3, 3)]
    assert mined(table_of(spark, rows), 10) == plain(rows, 10)


def test_awkward_rows(spark):
    good = random_rows(60, 3, 1)
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, 1), (150, [1.0, None, 2.0], 1), (200, [nan, 1.0, 1.0], 0), (250, [inf, 0.0, 0.0], 0), (300, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    odd = [(350, [], 1), (351, [], 0), (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [1.0, 1.75], 0), (450, [0.0, 0.0, 0.0], 1)]
    rows = good + bad + odd
    assert mined(table_of(spark, rows), 50) == plain(rows, 50)


def test_repeated_rows(spark):
    rows = random_rows(80, 3, 5)
    again = rows + rows[:30]
    assert mined(table_of(spark, again), 10) == plain(rows, 10)
    # An id with other content is a row of its own, as an anchor too.
    twice = rows + [(10, [2.0, 2.0, 2.0], 1), (20, [1.0, 0.25, 1.0], 2)]
    assert mined(table_of(spark, twice), 10) == plain(twice, 10)


def test_scores_beyond_a_double_are_exact(spark):
    rows = [(0, [2.0**30, 1.0], 0), (1, [2.0**30, 2.0], 0), (2, [2.0**29, 1.0], 1), (3, [2.0**29, 3.0], 1), (4, [0.9 * 2.0**30, -1.0], 1)]
    exact = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert mined(table_of(spark, rows), 50) == [r for r in plain(exact, 50) if abs(r[4]) <= H.MOST]


def test_scores_beyond_a_long_are_held_at_its_ends(spark):
    rows = [(0, [1e30], 0), (1, [1e30], 0), (2, [1e25], 1)]
    assert mined(table_of(spark, rows), 50) == []


def test_an_empty_table_and_one_label(spark):
    assert mined(table_of(spark, [])) == []
    assert mined(table_of(spark, [(i, [1.0, 2.0], 1) for i in range(60)]), 10) == []


def test_keys_sort_as_their_parts():
    draw = random.Random(2)
    ends = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    parts = [(draw.choice(ends), draw.choice(ends), draw.choice(ends), draw.randrange(2), draw.choice(ends), draw.choice(ends)) for _ in range(300)]
    assert all(H.unpack(H.pack(*p)) == p for p in parts)
    assert sorted(parts, key=lambda p: H.pack(*p)) == sorted(parts, key=lambda p: (p[0], p[1], -p[2], *p[3:]))


def test_the_stream_holds_open_windows_only():
    keys = sorted(H.pack(1, 0, s, k, i, 0) for s, k, i in [(100, 0, 5), (95, 1, 6), (96, 1, 7), (60, 0, 8), (57, 1, 9), (50, 1, 10), (49, 1, 11), (29, 1, 12)])
    assert list(H.stream(iter(keys), 50, 95, 3)) == [(1, 5, 1, 6, 100, 95), (1, 5, 2, 9, 100, 57), (1, 8, 1, 9, 60, 57), (1, 5, 3, 10, 100, 50), (1, 8, 2, 10, 60, 50), (1, 8, 3, 11, 60, 49)]


def test_pairs_are_cut_before_the_shuffle(spark, monkeypatch):
    """What a block gives of an anchor is bounded by the windows, not by the rows."""
    monkeypatch.setattr(H, "ROWS", 100)
    rows = H.usable_rows(table_of(spark, random_rows(1000, 3, 9)), "vec_id", "embedding", F.col("label"))
    heads = rows.where("id % 100 = 0").withColumn("windows", F.expr("array(struct(3000L AS score, 0L AS id, 0L AS tag))").cast(H.WINDOWS))
    found = H._in_blocks(rows, heads, ["size"], 3, False, 0, 100).groupBy("anchor").count().collect()
    assert found and max(r["count"] for r in found) <= 3 * 10


def test_query_columns(spark):
    df = QUERIES["op11_hard_negatives"](spark, SF)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
