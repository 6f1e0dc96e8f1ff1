from __future__ import annotations

import random

import pytest
import sentencepiece
from helpers import AWKWARD, documents
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from dayweave.llm import unigram

MODEL = path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    made = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def test_counts_equal_the_library(spark):
    held = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    exact = library([(held.id_to_piece(i), held.get_score(i)) for i in range(held.get_piece_size())], True)
    draw = random.Random(3)
    texts = [*AWKWARD, *((100 + i, "".join(draw.choice("abé 日▁\n the of") for _ in range(draw.randint(0, 40)))) for i in range(300))]
    rows = documents(spark, texts).select("text", unigram.token_counts(F.col("text"), MODEL).alias("p")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.p.n_tokens == len(exact.encode(r.text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(12))
def test_ties_and_unknown_characters_equal_the_library(seed):
    draw = random.Random(seed)
    pieces = [("<unk>", 0.0)] + [(p, -float(draw.randint(1, 4))) for p in sorted({"▁"} | {"".join(draw.choice("ab▁" if k == 0 else "ab") for k in range(draw.randint(1, 4))) for _ in range(15)})]
    exact, mine = library(pieces, False), unigram.Counter(pieces[1:], False)
    texts = ["".join(draw.choice("abc ") for _ in range(draw.randint(0, 25))) for _ in range(200)]
    _, counts = mine.texts(texts)
    assert counts.tolist() == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(unigram, "REMEMBERED", 6)
    pieces, stand_in = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("▁a", -1.5)], False
    text = "a b ab ba aa bb aab abb bba baa abab"
    small = unigram.Counter(pieces, stand_in).texts([text, text, ""])
    assert small[1].tolist() == [sum(unigram.Counter(pieces, stand_in).word(w)[1] for w in unigram.words(text))] * 2 + [0]


def test_empty_table(spark):
    assert documents(spark, []).select(unigram.token_counts(F.col("text"), MODEL)).collect() == []
