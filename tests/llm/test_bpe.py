from __future__ import annotations

import base64
import random

import numpy as np
import pytest
import tiktoken
from helpers import AWKWARD, documents
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayweave.llm import bpe

RANKS, JSON = path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    draw = random.Random(7)
    return ["".join(draw.choice("ab é 日\n\t  'sS1٣😀́‍") for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_other_library(spark, reference):
    docs = documents(spark, [*AWKWARD, *enumerate(odd_texts(300), 100), (900, "a <|endoftext|> b")])
    rows = docs.select("text", bpe.encoded(F.col("text"), RANKS, PATTERN).alias("ids")).withColumn("raw", bpe.decoded(F.col("ids"), RANKS, PATTERN)).collect()
    assert len(rows) == len(AWKWARD) + 301
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode()


def test_ids_equal_the_tokenizers_file():
    whole = Tokenizer.from_file(JSON)
    texts = [t or "" for _, t in AWKWARD] + odd_texts(300) + ["x<|endoftext|><|endoftext|>", " " * 5000, "ab" * 4000]
    encoder = bpe.loaded(JSON, PATTERN)
    wanted = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == wanted and encoder.encode_quick(texts) == wanted


def test_memory_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder.from_ranks(RANKS, PATTERN)
    texts = ["one two three", "four five six seven eight nine ten eleven", "one two"]
    for text in texts * 2:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_spans_cover_split_characters(spark):
    docs = documents(spark, [(1, "a 😀é日"), (2, None), (3, "plain text")])
    for r in docs.select("text", bpe.encoded_spans(F.col("text"), RANKS, PATTERN).alias("s")).collect():
        tokens = bpe.loaded(RANKS, PATTERN).tokens
        for i, a, b in zip(r.s.ids, r.s.starts, r.s.ends):
            assert tokens[i] in r.text[a:b].encode()
        assert not r.s.ids or (r.s.starts[0] == 0 and r.s.ends[-1] == len(r.text))


def test_null_ids_and_empty_table(spark):
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in none.select(bpe.decoded(F.col("ids"), RANKS, PATTERN)).collect()] == [None, b""]
    assert documents(spark, []).select(bpe.encoded(F.col("text"), RANKS, PATTERN)).collect() == []
