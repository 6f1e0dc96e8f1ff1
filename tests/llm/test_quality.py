from __future__ import annotations

import numpy as np
import pytest
from helpers import AWKWARD, LONG, documents
from pyspark.sql import functions as F

from dayweave.llm import quality
from dayweave.llm.common import remainder
from dayweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def read(docs):
    return docs.withColumn("statistics", quality.read(F.col("text")))


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = read(spark.read.parquet(f"{SF}/documents.parquet")).cache(), spark.read.parquet(f"{SF}/labels.parquet")
    rest = remainder(F.col("doc_id"), 4)
    return quality.learn(docs.where(rest != 2), labels), docs.where(rest == 2).join(labels, "doc_id"), docs.where(rest != 2).join(labels, "doc_id")


def test_held_out_quality(spark, learned):
    model, held, _ = learned
    rows = held.where("quality is not null").select("quality", quality.scored(F.col("statistics"), model, spark).alias("p")).select("quality", "p.*").toPandas()
    y, s = rows["quality"].to_numpy(), rows["score"].to_numpy()
    assert s.min() >= 0 and s.max() <= 1 and ((s >= 0.7) == (rows["predicted"] == 1)).all()
    rank = rows["score"].rank().to_numpy()
    area = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.99 and (s[y == 1] >= 0.7).mean() > 0.98 and (s[y == 0] < 0.7).mean() > 0.95


def test_weights_solve_the_normal_equations_of_all_rows(learned):
    """The sums over partitions give the weights that one matrix of all rows gives."""
    model, _, fitted = learned
    rows = fitted.where("quality is not null").select("doc_id", "text", "quality").toPandas()
    from zlib import crc32

    aside = np.array([crc32(str(i).encode()) % 28 // 7 == 1 for i in rows["doc_id"]])
    x = np.stack([quality.statistics(t) for t in rows["text"]])
    fit, y = x[~aside], rows["quality"].to_numpy(float)
    assert model.centre == pytest.approx(fit.mean(0)) and model.spread == pytest.approx(fit.std(0))
    z = model.features(fit)
    penalty = 1e-3 * len(z) * np.eye(z.shape[1]) / (z.shape[1] - 1)
    penalty[-1, -1] = 1e-9
    expected = z @ np.linalg.solve(z.T @ z + penalty, z.T @ y[~aside])
    assert z @ model.weights == pytest.approx(expected, abs=1e-6)
    # Chances rise with the score and have the mean of the labels they were fitted to.
    assert (np.diff(model.chances) >= 0).all() and (np.diff(model.places) > 0).all()


def test_features_approximate_a_gaussian_kernel():
    draw = np.random.default_rng(0)
    many, dim, width = 20_000, quality.STATISTICS, 6.0
    model = quality.QualityModel(np.zeros(dim), np.ones(dim), draw.standard_normal((dim, many)) / width, draw.uniform(0, 2 * np.pi, many), None, None, None)
    x = draw.standard_normal((12, dim))
    z = model.features(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-apart / (2 * width**2))).max() < 0.05


def plain_isotonic(y, w):
    """Largest over starts of the smallest over ends of the weighted means (the max-min formula)."""
    n = len(y)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_equals_the_formula():
    draw = np.random.default_rng(3)
    for _ in range(20):
        x, y, w = np.arange(15.0), draw.integers(0, 3, 15) / 2, draw.integers(1, 5, 15).astype(float)
        places, means = quality.isotonic(x, y, w)
        full = np.array(plain_isotonic(y, w))
        assert means == pytest.approx(np.unique(full.round(12)), abs=1e-9) and (np.diff(places) > 0).all()


def test_statistics_of_a_long_text_do_not_depend_on_the_piece(monkeypatch):
    whole = quality.statistics(LONG)
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert quality.statistics(LONG) == pytest.approx(whole, rel=0.05)


def test_awkward_texts(spark, learned):
    model, _, _ = learned
    docs = documents(spark, AWKWARD)
    rows = read(docs).select("doc_id", quality.scored(F.col("statistics"), model, spark).alias("p")).select("doc_id", "p.*").collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1] == by[2] and by[5] == by[6][:1] and by[6][0] == by[6][1]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert read(docs.limit(0)).select(quality.scored(F.col("statistics"), model, spark)).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = read(documents(spark, AWKWARD))
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    good = quality.learn(docs, spark.createDataFrame([(i, 1) for i in range(1, 11)] + [(None, 0), (4, None)], "doc_id long, quality int"))
    rows = docs.select(quality.scored(F.col("statistics"), none, spark).alias("a"), quality.scored(F.col("statistics"), good, spark).alias("b")).collect()
    assert {r.a.score for r in rows} == {0.5} and {r.b.score for r in rows} == {1.0}


def test_an_id_with_several_labels_takes_the_largest(spark):
    docs = read(documents(spark, [(i, "good words here " * (i + 1)) for i in range(8)]))
    labels = spark.createDataFrame([(i, q) for i in range(8) for q in (0, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert docs.select(quality.scored(F.col("statistics"), model, spark)["score"].alias("s")).distinct().collect()[0].s == 1.0


def test_query_columns_and_folds(spark):
    df = QUERIES["op12_quality"](spark, "/root/testdata/sf0.01")
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).count()
    assert df.where("held_out").count() == held and df.count() == docs.count()
