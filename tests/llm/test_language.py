from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from dayweave.llm import language
from dayweave.llm.common import remainder

SF = "/root/testdata/sf0.01"
TRAIN = {"en": ["the cat sat on the mat with the other cat"] * 4, "de": ["die katze sass auf der matte mit der anderen"] * 4}


def plain_bits(texts, text, order, contexts):
    """Code length by the definition: counts of one language, contexts that are states."""
    counts = {}
    for t in texts:
        raw = t.encode()
        for i in range(len(raw)):
            for k in range(order + 1):
                if i >= k:
                    counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1

    def chances(context):
        below = chances(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context, Counter())
        total, distinct = sum(seen.values()), len(seen)
        if not total:
            return below
        rest = sum(p for b, p in enumerate(below) if b not in seen)
        escape = distinct / (total + distinct) if rest > 0 else 0.0
        return [(1 - escape) * seen[b] / total if b in seen else escape * below[b] / rest for b in range(256)]

    raw, bits = text.encode(), 0.0
    for i in range(len(raw)):
        k = max(k for k in range(order + 1) if k <= i and (k == 0 or raw[i - k : i] in contexts))
        bits -= math.log2(chances(raw[i - k : i])[raw[i]])
    return bits


@pytest.fixture(scope="module")
def model(spark):
    rows = [(10 * n + i, t) for n, (_, ts) in enumerate(sorted(TRAIN.items())) for i, t in enumerate(ts)]
    langs = {10 * n + i: lang for n, (lang, ts) in enumerate(sorted(TRAIN.items())) for i in range(len(ts))}
    return language.learn(documents(spark, rows, langs), order=3, contexts=100_000)


def test_code_lengths_equal_the_definition(model):
    texts = ["the mat", "der matte katze", "zzz é", "x" * 700 + " the cat" * 100]
    found = language.code_lengths(model, texts)
    for k, name in enumerate(model.names):
        totals = Counter()
        for t in TRAIN[name]:
            raw = t.encode()
            for i in range(len(raw)):
                totals.update(raw[i - n : i] for n in range(1, 4) if i >= n)
        contexts = {c for c, n in totals.items() if n > 1}
        for n, text in enumerate(texts):
            assert found[n, k] == pytest.approx(plain_bits(TRAIN[name], text, 3, contexts), rel=1e-5)


def test_chances_sum_to_one(model):
    for bits in model.bits:
        assert abs((2.0 ** -bits.astype(float)).reshape(-1, 256).sum(1) - 1).max() < 1e-5


def test_every_language_is_learned_with_contexts_of_its_own(spark):
    """More than 64 languages, one of them rare beside a large one: none is left out."""
    rows, langs = [], {}
    for n in range(70):
        word = "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=7))
        for i in range(40 if n == 0 else 2):
            rows.append((len(rows), f"{word} {word[::-1]} {word}{word} " * 5))
            langs[len(langs)] = f"l{n:02}"
    model = language.learn(documents(spark, rows, langs), contexts=50)
    assert len(model.names) == 70 and all(len(b) > 256 for b in model.bits)
    docs = documents(spark, rows, langs)
    found = docs.select("lang", language.predicted(F.col("text"), model, spark)["lang"].alias("p")).collect()
    assert all(r.lang == r.p for r in found)


def test_equal_code_lengths_take_the_first_name(spark):
    docs = documents(spark, [(i, "same words here") for i in range(4)], {0: "b", 1: "a", 2: "b", 3: "a"})
    row = docs.limit(1).select(language.predicted(F.col("text"), language.learn(docs), spark).alias("p")).first().p
    assert row.lang == "a" and row.score == pytest.approx(0.5)


def test_awkward_texts(spark, model):
    docs = documents(spark, AWKWARD)
    rows = docs.select("doc_id", language.predicted(F.col("text"), model, spark).alias("p")).collect()
    found = {r.doc_id: r.p for r in rows}
    assert len(rows) == len(AWKWARD)
    assert all(found[i].lang == "und" and found[i].score == 0 and found[i].bits is None for i in (1, 2, 3, 10))
    assert found[5].lang == "en" and 0.5 < found[5].score <= 1 and found[7].lang in TRAIN
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, None}


def test_nothing_to_learn(spark):
    empty = documents(spark, [])
    model = language.learn(empty)
    assert model.names == []
    rows = documents(spark, [(1, "text")]).select(language.predicted(F.col("text"), model, spark).alias("p")).collect()
    assert rows[0].p.lang == "und" and empty.select(language.predicted(F.col("text"), model, spark)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rest = remainder(F.col("doc_id"), 4)
    model = language.learn(docs.where(rest != 2))
    held = docs.where(rest == 2).select("lang", language.predicted(F.col("text"), model, spark)["lang"].alias("found")).toPandas()
    assert len(held) > 200 and (held["lang"] == held["found"]).mean() > 0.98
