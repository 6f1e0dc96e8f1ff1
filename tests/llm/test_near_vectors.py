from __future__ import annotations

import numpy as np
import pytest

from dayweave.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, point string, n string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "x", "x") for i, v, k in rows], SCHEMA)


def brute(rows, cosine=0.98):
    usable = [v is not None and k is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, k in rows]
    wide = [np.array(np.float32(v), float) if u else None for (_, v, _), u in zip(rows, usable)]
    size = len(rows)

    def linked(a, b):
        if not (usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(wide[a]) == len(wide[b])):
            return False
        x, y = wide[a] / np.abs(wide[a]).max(), wide[b] / np.abs(wide[b]).max()
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine

    pairs = {a: [b for b in range(size) if b != a and linked(a, b)] for a in range(size)}
    label = list(range(size))
    changed = True
    while changed:
        changed = False
        for a in range(size):
            low = min([label[a], *(label[b] for b in pairs[a])])
            changed, label[a] = changed or low != label[a], low
    out = []
    for a, (i, _, _) in enumerate(rows):
        component = None if i is None else min(rows[b][0] for b in range(size) if label[b] == label[a] and rows[b][0] is not None)
        out.append((i, len(pairs[a]), component, i is not None and component == i))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.01], 1), (11, [1.0, 0.0], 2),
        (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (15, [1e-30, 0.0], 1), (16, [1e30, 0.0], 1),
    ]
    assert found(near_vectors.near_duplicates(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert near_vectors.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("block", [512, 16])
def test_clusters_equal_brute_force(spark, monkeypatch, block):
    # A small block splits the crowded cell of the large cluster over many comparisons.
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    draw = np.random.default_rng(4)
    rows, n = [], 0
    for size, spread in [(60, 0.012), (5, 0.012), (2, 0.02), (3, 0.017), *[(1, 0.0)] * 80]:
        center = draw.standard_normal(32)
        center /= np.linalg.norm(center)
        for _ in range(size):
            rows.append((n, [float(x) for x in center + spread * draw.standard_normal(32)], n % 2 if size == 1 else 0))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(40)]
    assert found(near_vectors.near_duplicates(table(spark, rows))) == brute([(i, np.float32(v).tolist(), k) for i, v, k in rows])
