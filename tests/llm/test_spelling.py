from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
import regex
from helpers import AWKWARD, documents

from dayweave.llm import spelling as S
from dayweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_near(a, b):
    """One edit by trying all of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(texts, *, least_points=6, least_n=5, ratio=5, damaged=0):
    counts = Counter()
    for number, text in texts:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_points and n >= least_n}
    near = {w: [v for v in words if plain_near(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: f if f and words[f] >= ratio * words[w] else None for w, f in form.items()}
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in S.spelling_variants(df, **options).collect()), key=str)


def variants(seed, roots=12, size=7):
    """Texts of words and their misspellings, with rare and frequent ones."""
    draw = random.Random(seed)
    letters = "abcdefgéöß"
    words = ["".join(draw.choice(letters) for _ in range(size)) for _ in range(roots)]
    for w in list(words):
        for _ in range(4):
            i = draw.randrange(len(w))
            words.append(draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]]))
    some = [draw.choice([1, 2, 5, 6, 30, 150]) for _ in words]
    bag = [w.upper() if draw.random() < 0.2 and w.isascii() else w for w, n in zip(words, some) for _ in range(n)]
    draw.shuffle(bag)
    return [(i, " ".join(bag[i::40])) for i in range(40)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    texts = variants(seed)
    rows = found(documents(spark, texts))
    assert rows == plain(texts) and any(r[1] for r in rows)


def test_damaged_runs_equal_brute_force(spark):
    texts = variants(9)
    assert found(documents(spark, texts), damaged=3) == plain(texts, damaged=3)


def test_crowded_reduced_words_equal_brute_force(spark, monkeypatch):
    texts = variants(4, roots=40, size=6)
    whole = plain(texts)
    monkeypatch.setattr(S, "CROWD", 1)
    assert found(documents(spark, texts)) == whole
    monkeypatch.setattr(S, "CROWD", 0)
    assert found(documents(spark, texts)) == whole


def test_chains_of_forms(spark):
    chain = [("abcdefgh", 5), ("abcdefghi", 30), ("abcdefghij", 200), ("abcdefghijk", 1100), ("abcdefghijkl", 5600)]
    texts = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    rows = found(documents(spark, texts))
    assert rows == plain(texts) and {r[2] for r in rows} == {"abcdefghijkl"}


def test_ties_take_the_smallest_word(spark):
    texts = [(1, "abcdef " * 5 + "abcdeg " * 50 + "zbcdef " * 50 + "abcdeé " * 50)]
    rows = {r[0]: r for r in found(documents(spark, texts))}
    assert rows["abcdef"][1] == "abcdeg" and sorted(rows.values(), key=str) == plain(texts)


def test_awkward_texts(spark):
    texts = AWKWARD + [(20, "a" * 50_000), (21, "b" + "a" * 50_000), (None, "ÀÖØ×÷ÿÉé " * 9)] * 6
    rows = found(documents(spark, texts), damaged=199)
    short = [(i, t) for i, t in texts if len(t or "") != 50_000 and len(t or "") != 50_001]
    assert [r for r in rows if len(r[0]) < 1000] == plain(short, damaged=199)
    # The very long runs: only those that were not damaged are equal in all texts.
    assert all(r[4] <= 1 for r in rows if len(r[0]) > 1000)
    assert found(documents(spark, [(1, None)])) == [] and found(documents(spark, [(1, "x")]).limit(0)) == []


def test_long_words_one_edit_apart(spark):
    long = "".join(random.Random(3).choices("abcdefgh", k=20_000))
    texts = [(i, f"{long} {long[:9000] + long[9001:]} {long[:50] + 'z' + long[51:]} {long}x") for i in range(5)]
    rows = found(documents(spark, texts))
    assert sorted(r[4] for r in rows) == [1, 1, 1, 3] and all(r[3] == 5 for r in rows)


def test_neighbour_keys_are_the_keys_of_all_edits():
    draw = random.Random(1)
    for letters, source in ((S.REDUCED, "abcd"), (S.POINTS, "abcxyzäéÿ")):
        points = [chr(c) for c in letters]
        words = ["".join(draw.choice(source) for _ in range(size)) for size in (1, 2, 6, 6, 9)]
        found = {n: [] for n in range(len(words))}
        for places, keys in S.neighbour_keys(words, letters):
            for n, k in zip(places.tolist(), keys.tolist()):
                found[n].append(k)
        for n, word in enumerate(words):
            edits = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
            for c in points:
                edits |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
            assert sorted(found[n]) == sorted(set(S.own_keys(sorted(edits)).tolist()))


def test_no_join_is_broadcast(spark, monkeypatch):
    """Neighbours are many times what Spark takes them for: the size of the words they are made of."""
    plans = []

    def stored(df, name, write=S.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(S, "stored", stored)
    rows = S.spelling_variants(documents(spark, variants(2)))
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans) and sum(p.count("SortMergeJoin") for p in plans) > 10


def test_symbols_are_few():
    assert len(S.SYMBOL_OF) == len(S.POINTS) and set(S.SYMBOL_OF) == {chr(c) for c in S.REDUCED}


def test_query_columns(spark):
    df = QUERIES["op13_spelling"](spark, SF)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
