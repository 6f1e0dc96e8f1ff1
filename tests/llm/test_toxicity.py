from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from helpers import AWKWARD, LONG, documents
from pyspark.sql import functions as F

from dayweave.llm import toxicity
from dayweave.llm.common import remainder

SF = "/root/testdata/sf0.1"


def plain_chance(model, code):
    """The network by its definition, one place at a time."""
    vectors = [model.table[c >> 40] + model.table[(c >> 8) & 0xFFFFFFFF] for c in code.tolist()] + [np.zeros(model.table.shape[1])] * 2
    features = []
    for w in toxicity.WIDTHS:
        places = range(max(1, len(code)))
        features.append(np.max([sum(vectors[i + j] @ model.filters[w][j] for j in range(w) if i + j < len(vectors)) for i in places], axis=0) + model.biases[w])
    return 1 / (1 + np.exp(-(np.maximum(np.concatenate(features), 0) @ model.out + model.offset)))


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rest = remainder(F.col("doc_id"), 5)
    return toxicity.learn(docs.where(rest != 0), labels), docs.where(rest == 0).join(labels, "doc_id")


def test_held_out_quality(spark, learned):
    model, held = learned
    rows = held.select("toxic", toxicity.scored(F.col("text"), model, spark).alias("p")).select("toxic", "p.*").toPandas()
    y, s = rows["toxic"].to_numpy(), rows["score"].to_numpy()
    assert s.min() >= 0 and s.max() <= 1 and ((s >= 0.5) == (rows["predicted"] == 1)).all()
    rank = rows["score"].rank().to_numpy()
    area = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    # About a sixth of the labels are not explained by any word of the text.
    assert area > 0.88 and (s[y == 0] >= 0.5).mean() < 0.03 and (s[y == 1] >= 0.5).mean() > 0.65


def test_scores_equal_the_definition(learned):
    model, _ = learned
    words = toxicity._Words(model.rows)
    coded = [toxicity.codes(t, words) for t in ["", "idiot", "you are a clown and a moron", "two words", LONG[:3000]]]
    assert toxicity.raw_scores(model, coded) == pytest.approx([plain_chance(model, c) for c in coded], rel=1e-4)


def test_a_text_longer_than_a_chunk_equals_the_definition(learned, monkeypatch):
    model, _ = learned
    coded = [toxicity.codes(t, toxicity._Words(model.rows)) for t in ["a b", LONG[:4000] + " worthless scum", "c"]]
    whole = toxicity.raw_scores(model, coded)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert toxicity.raw_scores(model, coded) == pytest.approx(whole, rel=1e-5)


def test_awkward_texts(spark, learned):
    model, _ = learned
    docs = documents(spark, AWKWARD)
    rows = docs.select("doc_id", toxicity.scored(F.col("text"), model, spark).alias("p")).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.p.score <= 1 for r in rows)
    empty = {r.doc_id: r.p.score for r in rows}
    assert empty[1] == empty[2] == empty[3]
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_labels_of_one_kind_or_none(spark):
    docs = documents(spark, [(1, "a b"), (2, None), (None, "c")])
    for labels in ([], [(1, 0), (None, 1), (3, None)], [(1, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = [r[0] for r in docs.select(toxicity.scored(F.col("text"), model, spark)["score"]).collect()]
        assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)
    assert documents(spark, []).select(toxicity.scored(F.col("text"), model, spark)).collect() == []


def test_thresholds_follow_the_language():
    chances = np.concatenate([np.linspace(0, 0.6, 60), np.linspace(0.7, 1, 60), np.linspace(0, 0.2, 60), np.linspace(0.3, 0.5, 60)])
    labels = np.repeat([0, 1, 0, 1], 60)
    limits = toxicity.calibrate(chances, labels, ["en"] * 120 + ["fr"] * 120)
    assert 0.6 < limits["en"] < 0.7 and 0.2 < limits["fr"] < 0.3 and limits["de"] == limits[""]


def test_every_labelled_document_is_learned_from(spark):
    docs = spark.range(0, 9000, 1, 8).selectExpr("id AS doc_id", "concat('only', id, ' seen') AS text")
    labels = spark.range(0, 9000, 1, 8).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic")
    model = toxicity.learn(docs, labels, epochs=1)
    start = (np.random.default_rng(5).standard_normal(model.table.shape) * 0.02).astype(np.float32)
    trained = docs.where(F.floor(remainder(F.col("doc_id"), 35) / 7) != 1).toPandas()["text"]
    first = [toxicity._hashes(text.split()[0], model.rows)[0] for text in trained]
    assert (model.table[first] != start[first]).any(1).mean() > 0.99
    again = toxicity.learn(docs.repartition(3), labels, epochs=1)
    assert np.array_equal(model.table, again.table) and model.thresholds == again.thresholds


def test_means_of_changes_do_not_reach_the_driver_as_objects(spark):
    words = "concat_ws(' ', transform(sequence(1, 40), i -> concat('x', id * 40 + i))) AS text"
    docs = spark.range(0, 3000, 1, 8).selectExpr("id AS doc_id", words)
    labels = spark.range(0, 3000, 1, 8).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic")
    tracemalloc.start()
    try:
        model = toxicity.learn(docs, labels, rows=1 << 14, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * model.table.nbytes, peak / model.table.nbytes
