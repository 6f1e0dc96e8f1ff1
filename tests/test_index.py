"""A search index of runs against plain code, over many changes."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dayweave.functions import words
from dayweave.operators import search
from dayweave.streaming import live

DOCS = "doc_id long, text string"


def plain_search(texts, query, k):
    held = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in texts.items()}
    size = {i: sum(c.values()) for i, c in held.items()}
    mean = sum(size.values()) / max(1, len(size))
    terms = sorted(set(query.lower().split()))
    df = {t: sum(t in c for c in held.values()) for t in terms}
    idf = {t: max(1e-6, math.log((len(held) - df[t] + 0.5) / (df[t] + 0.5))) for t in terms}
    found = []
    for i, c in held.items():
        if all(t in c for t in terms):
            found.append((-sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in terms), i))
    # Sorted by what does not depend on the order of additions.
    return [(i, pytest.approx(-s, rel=1e-6)) for s, i in sorted((float(f"{s:.9e}"), i) for s, i in found)[:k]]


def found_by(index, query, k):
    rows = search.search(index, [query], k, stems=False).orderBy("rank").collect()
    return [(r.doc_id, r.score) for r in rows]


def postings_of(texts):
    return sorted((t, i, n) for i, text in texts.items() for t, n in Counter(re.findall(r"\w+", text.lower())).items())


def make(draw, top=60):
    return " ".join(draw.choice(["the", "the", "a", "fox", "dog", "red", f"w{draw.randrange(40)}"]) for _ in range(draw.choice([0, 1, 3, 8, 20, top])))


def test_many_changes_equal_plain_code(spark, tmp_path):
    draw = random.Random(1)
    texts = {i: make(draw) for i in range(150)}
    index = search.write_index(search.build_index(spark.createDataFrame(list(texts.items()), DOCS), stems=False), str(tmp_path / "x"))
    for step in range(9):
        changed = {draw.randrange(200): make(draw) for _ in range(draw.choice([1, 4, 30]))}
        changed[500 + step] = ""
        gone = [draw.randrange(200) for _ in range(5)]
        texts = {i: t for i, t in texts.items() if i not in gone} | changed
        index = search.change_index(index, spark.createDataFrame(list(changed.items()), DOCS), spark.createDataFrame([(i,) for i in gone], "doc_id long"), stems=False)
        # Sizes fall by more than half from run to run, so their number is logarithmic.
        assert len(index.runs) <= 2 + math.log2(len(texts)) and all(a.docs > 2 * b.docs for a, b in zip(index.runs, index.runs[1:]))
    again = search.load_index(spark, str(tmp_path / "x"))
    assert again.runs == index.runs and len(index.runs) > 1
    assert sorted((r.term, r.doc_id, r.tf) for r in again.postings.collect()) == postings_of(texts)
    assert sorted((r.doc_id, r.length) for r in again.documents.collect()) == sorted((i, len(re.findall(r"\w+", t))) for i, t in texts.items())
    for query in ("the", "fox dog", "w3", "nothing here"):
        assert found_by(again, query, 7) == plain_search(texts, query, 7)
    kept = {p.name for p in (tmp_path / "x" / "postings").iterdir() if p.name.startswith("run")}
    assert {f"run-{r.run}" for r in index.runs} <= kept and len(kept) <= 2 * len(index.runs) + 3


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    # One frequent term in texts of very different lengths: the longest cannot be among the best ten.
    texts = {i: "the " + " ".join(f"x{i % 7}" for _ in range(i % 400)) for i in range(4000)}
    index = search.write_index(search.build_index(spark.createDataFrame(list(texts.items()), DOCS), stems=False), str(tmp_path / "x"))
    read, real = [], search.StoredIndex.live

    def watched(self, name, runs=None, where=None):
        rows = real(self, name, runs, where)
        if name == "postings":
            read.append(rows.count())
        return rows

    monkeypatch.setattr(search.StoredIndex, "live", watched)
    assert found_by(index, "the", 10) == plain_search(texts, "the", 10)
    assert max(read) < 400
    plan = index.part("postings", index.runs[0]).where(F.col("term").isin(["the"]) & F.col("block").between(0, 3))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "OrEqual(block,0)" in plan


def test_a_frequent_term_lies_in_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(5000).selectExpr("id as doc_id", "concat('the the ', if(id % 50 = 0, 'rare', '')) as text")
        index = search.write_index(search.build_index(docs, stems=False), str(tmp_path / "x"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = index.part("postings", index.runs[0]).where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) < 2500


def test_batches_with_removed_and_empty_texts(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/index"
    steps = [[(1, "the fox"), (2, "red dog"), (3, "the the")], [(1, None), (2, ""), (4, "dog")], [(3, "now this"), (1, "back again")], [(4, None)]]
    texts = {}
    for n, step in enumerate(steps):
        spark.createDataFrame([(i, t, n) for i, t in step], "doc_id long, text string, at int").coalesce(1).write.mode("append").parquet(folder)
        live.index_batches(spark.readStream.schema("doc_id long, text string, at int").parquet(folder), path, stems=False)
        texts = {i: t for i, t in (texts | dict(step)).items() if t is not None}
        index = live.read_index(spark, path)
        assert sorted((r.term, r.doc_id, r.tf) for r in index.postings.collect()) == postings_of(texts)
        # A document without words is still a document.
        assert sorted(r.doc_id for r in index.documents.collect()) == sorted(texts)
    assert len(index.runs) <= 4


def test_a_repeated_batch_and_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "x")
    assert search.load_index(spark, path).runs == []
    one = search.change_index(search.load_index(spark, path), spark.createDataFrame([(1, "a b")], DOCS), stems=False, batch=0)
    assert search.change_index(one, spark.createDataFrame([(1, "c")], DOCS), stems=False, batch=0).runs == one.runs
    empty = search.write_index(search.build_index(spark.createDataFrame([], DOCS), stems=False), str(tmp_path / "y"))
    assert search.search(empty, ["a"], stems=False).collect() == []
    assert found_by(one, "zzz", 5) == []


def test_stemmed_terms_are_counted_in_one_shuffle(spark):
    texts = [(1, "running runs run"), (2, None), (3, "  "), (4, "nations élle national nation"), (5, "running running")]
    index = search.build_index(spark.createDataFrame(texts, DOCS))
    wanted = {(words.stem_word(w), i): 0 for i, t in texts for w in (t or "").replace("é", "e").split()}
    for i, t in texts:
        for w in (t or "").replace("é", "e").split():
            wanted[words.stem_word(w), i] += 1
    assert {(r.term, r.doc_id): r.tf for r in index.postings.collect()} == wanted
    assert index.postings._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    lists = spark.createDataFrame([(["runs", None, "ties"],), (None,), ([],), (["skies"],)], "w array<string>")
    assert [r[0] for r in lists.select(words.stems("w")).collect()] == [["run", None, "ti"], None, [], ["ski"]]
