from __future__ import annotations

import random

import xxhash
import numpy as np
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from dayweave.llm import simhash

BLANK = " \t\n\x0b\x0c\r"


def plain_fingerprint(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c if c not in BLANK else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_groups_equal_brute_force(spark):
    found = {(r.doc_id, r.bits % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(spark, AWKWARD)).collect()}
    prints = [(i, plain_fingerprint(t, 3)) for i, t in AWKWARD]
    label = plain_groups(range(len(prints)), lambda a, b: bin(prints[a][1] ^ prints[b][1]).count("1") <= 2 or (prints[a][0] is not None and prints[a][0] == prints[b][0]))
    ids = lambda c: min(prints[k][0] for k in label if label[k] == c and prints[k][0] is not None) if any(label[k] == c and prints[k][0] is not None for k in label) else None
    assert found == {(i, p, ids(label[n])) for n, (i, p) in enumerate(prints)}


def test_every_pair_within_the_distance_is_found(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(60)]
    bits = {b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(8)} | {0, 1, 3, 7, (1 << 64) - 1}
    signed = [(b - (1 << 64) if b >> 63 else b,) for b in bits]
    for distance in (1, 2, 3):
        found = {(r.a, r.b) for r in simhash.linked_pairs(spark.createDataFrame(signed, "bits long"), distance).collect()}
        wanted = {(a, b) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}
        assert found == wanted


def test_keep_first_leaves_one_of_each_group(spark):
    docs = documents(spark, [*AWKWARD, (20, "other text about a wholly different thing that nobody else has"), (21, "Other text about a wholly different thing that nobody else has")])
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs, size=5))
    assert sorted(str(r.doc_id) for r in simhash.keep_first(docs, simhash.similar_documents(docs)).collect()) == sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 1, 2 and 3 have no words; 6 repeats 5; 21 differs from 20 in case only; rows without an id stay.
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8, 9, 10, 20] and ids.count(None) == 1


def test_repeated_id_stays_once(spark):
    docs = documents(spark, [(1, "b text one two three four five"), (1, "a quite different text with other words inside")])
    for found in (simhash.near_duplicates(docs), simhash.similar_documents(docs)):
        assert [r.text[0] for r in simhash.keep_first(docs, found).collect()] == ["a"]


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.similar_documents(documents(spark, [])).collect() == []
    assert simhash.keep_first(documents(spark, []), simhash.near_duplicates(documents(spark, []))).collect() == []


def test_similar_documents_equal_brute_force(spark):
    draw = random.Random(9)
    texts = []
    for _ in range(25):
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(draw.choice([30, 120, 220]))]
        texts.append(" ".join(words))
        for changes in (0, 1, 2, 3, 6):
            other = list(words)
            for k in draw.sample(range(len(words)), changes):
                other[k] = "changed"
            texts.append(" ".join(other))
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, rows)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = plain_groups(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert found == label


def shared_start(shared, own, words=iter(range(10**9))):
    """A text of ``shared`` and of as many words as ``own`` that no other text has."""
    return " ".join([*shared, *(f"own{next(words)}" for _ in range(own))])


def test_long_texts_are_decided_at_the_limit_itself(spark):
    texts = []
    for n in range(40):
        # Of 1,000 shingles each 895 or 883 are shared: a similarity of 0.80995 or 0.7905; 889 would be 0.8002.
        for kind, common in (("a", 895), ("b", 883)):
            shared = [f"{kind}{n}w{k}" for k in range(common + 4)]
            texts += [shared_start(shared, 1000 - common) for _ in range(2)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, list(enumerate(texts)))).collect()}
    assert found == {i: i - 1 if i % 4 == 1 else i for i in range(len(texts))}


def test_texts_that_differ_after_their_smallest_hashes_are_not_one(spark):
    words = [f"w{k}" for k in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, *(f"more{k}" for k in range(750))])), (4, " ".join([*words, *(f"other{k}" for k in range(760))]))]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, rows)).collect()}
    # 2996 of 3746 shingles are 0.7998.
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pairs_in_a_group_with_other_ends_are_found(spark, monkeypatch):
    # 150 true pairs (0.86) share a template with all the others (0.77), so most groups end in texts not alike.
    monkeypatch.setattr(simhash, "BLOCK", 16)
    template = [f"t{k}" for k in range(178)]
    texts = []
    for n in range(150):
        common = [*template, *(f"p{n}w{k}" for k in range(11))]
        texts += [shared_start(common, 15) for _ in range(2)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, list(enumerate(texts)))).collect()}
    assert found == {i: i - i % 2 for i in range(len(texts))}


def near_copies(count, draw, words=100):
    """Near copies of one text, one to three words of each changed: few are 0.8 alike, most share samples."""
    base = [f"b{k}" for k in range(words)]
    texts = []
    for n in range(count):
        other = list(base)
        for k in draw.sample(range(words), draw.randint(1, 3)):
            other[k] = f"own{n}k{k}"
        texts.append(" ".join(other))
    return texts


def test_near_copies_of_one_text_equal_brute_force_and_rows_follow_the_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    given, real = {}, simhash.tied_across

    def watched(members, sets, similarity):
        out = real(members, sets, similarity)
        given[size] = out.count()
        return out

    monkeypatch.setattr(simhash, "tied_across", watched)
    for size in (100, 400):
        texts = near_copies(size, random.Random(size))
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, list(enumerate(texts)))).collect()}
        sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
        assert found == plain_groups(range(size), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    # At most one row a node and comparison that ties it to another; pairs would grow 16 times.
    assert given[400] <= 8 * max(given[100], 100)


def test_linked_roots_equal_plain_sets():
    draw = np.random.default_rng(2)
    base = [draw.integers(0, 60, 40) for _ in range(3)]
    sets = [np.unique(np.where(draw.random(40) < 0.1, draw.integers(0, 1000, 40), base[draw.integers(3)])) for _ in range(60)]
    kinds, sizes = draw.integers(0, 20, 60), np.array([len(s) for s in sets])
    for side in (np.zeros(60, int), draw.integers(0, 2, 60)):
        linked, root = simhash.linked_roots(sets, sizes, side, kinds, 0.6)
        ties = {(a, b) for a in range(60) for b in range(60) if kinds[a] != kinds[b] and (side.min() == side.max() or side[a] != side[b]) and len(set(sets[a]) & set(sets[b])) >= 0.6 * len(set(sets[a]) | set(sets[b]))}
        assert linked.tolist() == [any(a == x for x, _ in ties) for a in range(60)]
        label = plain_groups(range(60), lambda a, b: (a, b) in ties)
        assert all((root[a] == root[b]) == (label[a] == label[b]) for a in range(60) for b in range(60))


def test_names_the_operator_uses_inside_may_be_columns(spark):
    docs = documents(spark, AWKWARD).withColumn("_gone", F.lit(1)).withColumn("_twice", F.lit(2)).withColumn("kept_id", F.lit(3)).withColumn("kept_row", F.lit(4)).withColumn("node", F.lit(5))
    assert simhash.keep_first(docs, simhash.similar_documents(docs)).columns == docs.columns
    assert simhash.keep_first(docs, simhash.similar_documents(docs)).count() == simhash.keep_first(documents(spark, AWKWARD), simhash.near_duplicates(documents(spark, AWKWARD))).count()
