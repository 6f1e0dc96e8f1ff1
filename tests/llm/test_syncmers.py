from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from dayweave.llm import syncmers


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return signed(seed)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = [chained([w.encode()]) for w in words]
    pairs = [chained(p) for p in zip(hashes, hashes[1:])]
    anchors = []
    for i in range(len(words) - 4):
        inner = pairs[i : i + 4]
        if min(inner) in (inner[0], inner[3]):
            anchors.append((chained([inner[0], inner[2], hashes[i + 4]]) & 0xFFFFFFFF, i))
    if not anchors and words:
        anchors = [(chained(hashes) & 0xFFFFFFFF, 0)]
    return anchors


def plain_likeness(a, b):
    """Anchors met at the few most frequent shifts of shared hashes, by the definition."""
    first_a, first_b = {}, {}
    for first, anchors in ((first_a, a), (first_b, b)):
        for h, place in anchors:
            first.setdefault(h, place)
    shared = [h for h in first_a if h in first_b]
    count = min(len(shared), syncmers.ASKED)
    shifts = [first_b[shared[i * len(shared) // count]] - first_a[shared[i * len(shared) // count]] for i in range(count)]
    best = sorted(set(shifts), key=lambda d: (-shifts.count(d), d))[: syncmers.SHIFTS]
    met = {(h, p) for d in best for h, p in a if (h, p + d) in set(b)}
    every = len(a) + len(b) - len(met)
    return len(met) / every if every else 1.0


def unpacked(values):
    return [(v >> syncmers.PLACE, v & ((1 << syncmers.PLACE) - 1)) for v in values]


def compared(spark, pairs):
    rows = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, x string, y string")
    for text, out in (("x", "fx"), ("y", "fy")):
        rows = syncmers.with_fingerprint(rows, text, out)
    return {r.n: r for r in syncmers.with_likeness(rows, "fx", "fy", "near").collect()}


def test_fingerprints_equal_brute_force(spark):
    docs = documents(spark, AWKWARD).withColumn("fp_words", F.lit("x")).withColumn("fp_pairs", F.lit("y"))
    found = syncmers.with_fingerprint(docs, "text", "fp")
    assert found.columns == [*docs.columns, "fp"]
    rows = found.collect()
    assert len(rows) == len(AWKWARD) and all(r.fp_words == "x" and r.fp_pairs == "y" for r in rows)
    for r in rows:
        assert unpacked(r.fp) == plain_fingerprint(r.text)
    # Every anchor of a long text is there, not a number of them.
    assert max(len(r.fp) for r in rows) > 5000


def test_likeness_equals_the_definition(spark):
    draw = random.Random(5)
    words = lambda n: " ".join(f"w{draw.randrange(400)}" for _ in range(n))
    part = [words(60) for _ in range(6)]
    texts = [AWKWARD[i][1] or "" for i in (1, 3, 4, 9)] + [" ".join(part), " ".join(part[1:]), " ".join(reversed(part)), words(20) + " " + part[2], " ".join([*part, part[0]]), "x " * 300]
    pairs = [(a, b) for a in texts for b in texts]
    rows = compared(spark, pairs)
    for n, (a, b) in enumerate(pairs):
        assert abs(rows[n].near - plain_likeness(plain_fingerprint(a), plain_fingerprint(b))) < 1e-12, (a[:40], b[:40])
        assert a != b or rows[n].near == 1.0


def test_likeness_is_positional(spark):
    base = [f"w{i}" for i in range(600)]
    shuffled = [base[i] for i in range(0, 600, 2)] + [base[i] for i in range(1, 600, 2)]
    moved = ["new", "start", *base]
    late = [*base[:-1], "other"]
    swapped = [*base[300:], *base[:300]]
    rows = compared(spark, [(" ".join(base), " ".join(t)) for t in (moved, late, swapped, shuffled)])
    # A shift, a change far behind the first 128 anchors, and two exchanged halves; alternate words share no run.
    assert 0.97 < rows[0].near <= 1 and 0.97 < rows[1].near < 1 and rows[2].near > 0.95 and rows[3].near == 0
    assert rows[1].fx != rows[1].fy


def test_edited_share_is_what_likeness_says(spark):
    """Three quarters of a text stay in place: about 0.75 / 1.25 of the anchors are shared."""
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(2000)) for _ in range(4)]
    rows = compared(spark, [(t, t[: len(t) - len(t) // 4] + texts[n - 1][: len(t) // 4]) for n, t in enumerate(texts)])
    assert all(0.56 < r.near < 0.64 for r in rows.values())


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "TOGETHER", 2)
    rows = [(i, t) for i, t in AWKWARD if i is not None] + [(1000, "far away"), (5000, "😀 the end of it")]
    found = syncmers.edited(documents(spark, rows)).collect()
    line = sorted(((i, t or "") for i, t in rows))
    wanted = []
    for n, (i, t) in enumerate(line):
        after = line[(n + 1) % len(line)][1]
        cut = len(t) // 4
        wanted.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted((r.id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in found) == sorted(wanted)


def test_null_id_single_row_and_empty_table(spark):
    assert [(r.id, r.next_text) for r in syncmers.with_next(documents(spark, [(None, "x"), (4, "y")])).orderBy("id").collect()] == [(None, "y"), (4, "x")]
    assert [r.edited for r in syncmers.edited(documents(spark, [(4, "abcdefgh")])).collect()] == ["abcdefab"]
    assert syncmers.edited(documents(spark, [])).collect() == []
