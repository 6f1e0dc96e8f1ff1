from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
from helpers import AWKWARD, documents
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from dayweave.llm import bpe, language, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b) if a or b else True


def test_pipeline_equals_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.toPandas().sort_values("doc_id")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    words = toxicity._Words(model.rows)
    coded = [toxicity.codes(t, words) for t in rows["text"]]
    limit = np.array([model.thresholds[toxicity.language_group(c)] for c in coded])
    rows = rows[toxicity.raw_scores(model, coded) < limit]
    known = language.learn(spark.createDataFrame(rows))
    lengths = language.code_lengths(known, rows["text"].tolist())
    share = 1 / np.exp2(lengths.min(1)[:, None] - lengths).sum(1)
    rows = rows[[bool(re.search(r"[^\W\d_]", t)) for t in rows["text"]] & (share >= 0.3)]
    sets = [shingles(t) for t in rows["text"]]
    # The smallest id of every group that links of 0.8 or more connect stays.
    root = list(range(len(sets)))
    for n in range(len(sets)):
        for m in range(n):
            if alike(sets[n], sets[m]) and root[n] != root[m]:
                root = [min(root[n], root[m]) if r in (root[n], root[m]) else r for r in root]
    kept = [n for n in range(len(sets)) if root[n] == n]
    encoder = bpe.loaded(path("byte_bpe_50k.json"), PATTERN)
    wanted = {i: len(raw) // 4 + 1 for i, raw in zip(rows["doc_id"].iloc[kept], encoder.encode(rows["text"].iloc[kept].tolist()))}
    found = corpus_pipeline.run(spark, SF).toPandas()
    sizes = found.groupby("doc_id")["length"].sum().to_dict()
    assert sizes == wanted and len(sizes) < len(rows)
    assert found.groupby("sequence_id")["length"].sum().max() <= 1024
    assert found["sequence_id"].nunique() <= found["length"].sum() / 1024 * 1.05 + 1


def test_stages_on_awkward_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (documents(spark, AWKWARD), documents(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string")), documents(spark, [])):
        now = docs
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, folder)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            out.write.mode("overwrite").parquet(f"{folder}/{n}")
            now = spark.read.parquet(f"{folder}/{n}")
        now.collect()


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
