from __future__ import annotations

import math
import random
import zlib

import numpy as np
from helpers import AWKWARD, documents
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from dayweave.llm import packing

JSON = path("byte_bpe_50k.json")


def test_pieces_hold_the_ids_of_the_documents(spark):
    whole = Tokenizer.from_file(JSON)
    docs = documents(spark, AWKWARD)
    rows = packing.pack_documents(docs, JSON, PATTERN).collect()
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in AWKWARD}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
        assert r.length == 1024 or r.piece == 0
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in AWKWARD)
    assert sum(r.doc_id == 6 for r in rows) == 2 * sum(r.doc_id == 5 for r in rows)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 1024)


def check_sequences(places, capacity):
    by_sequence: dict = {}
    for sequence, offset, length in places:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_many_pieces_of_few_lengths(spark, monkeypatch):
    # A third of all pieces has one length; chunks are small, so every length is ranked in many.
    monkeypatch.setattr(packing, "RANKED", 7)
    draw = random.Random(3)
    lengths = [40] * 300 + [draw.randint(1, 100) for _ in range(600)] + [100] * 30
    table = spark.createDataFrame([(i, 0, 0, k, 0) for i, k in enumerate(lengths)], packing.PIECES).repartition(5)
    rows = packing.pack(table, 100).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    used = check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 100)
    assert math.ceil(sum(lengths) / 100) <= used <= len(plain_best_fit(lengths, 100))


def plain_best_fit(lengths, capacity):
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return sorted(gaps)


def test_best_fit_on_a_histogram_equals_one_by_one():
    draw = random.Random(5)
    for _ in range(60):
        capacity = draw.randint(5, 60)
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 120))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        made = packing.best_fit(counts, capacity)
        gaps = sorted(capacity - sum(k * t for k, t in held) for held, n in made for _ in range(n))
        assert gaps == plain_best_fit(lengths, capacity)


def test_plan_holds_every_piece_and_is_no_worse_than_best_fit():
    draw = random.Random(6)
    for scale in (1, 50):
        for _ in range(20):
            capacity = draw.randint(20, 200)
            counts = np.bincount([draw.randint(1, capacity) for _ in range(draw.randint(0, 300))], minlength=capacity + 1) * scale
            made = packing.plan(counts, capacity)
            total = np.zeros(capacity + 1, np.int64)
            for held, n in made:
                assert sum(k * t for k, t in held) <= capacity
                for k, t in held:
                    total[k] += t * n
            assert (total == counts).all()
            assert sum(n for _, n in made) <= sum(n for _, n in packing.best_fit(counts, capacity))


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), JSON, PATTERN).collect() == []
