"""SimHash near-duplicates found through tables of distances to reference fingerprints.

Fingerprints come from word shingles. For every distinct fingerprint the Hamming distances to a fixed
set of reference fingerprints are computed once, per block of bits. Two fingerprints that differ in at
most two bits agree on all of three out of five blocks, so their distances to every reference agree
there as well: those triples of distance vectors are the join key. Of the pairs that meet, those whose
total distances to some reference differ by more than the limit are discarded (triangle inequality), and
the survivors are verified bit by bit. Nothing within the limit is lost.

The work goes over distinct fingerprints: copies meet in a pre-aggregated group, never as pairs. Near
copies share few unstable bits, which bounds how many distinct fingerprints agree on three blocks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm.common import free_name, stored
from dayweave.llm.near_vectors import _roots, _runs
from dayweave.plans.graphs import connected_components
from dayweave.plans.pointers import together

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SEED = 42
#: Samples of shingles that are fingerprinted on their own, and how many shingles each draws.
SAMPLES, DRAWN = 24, 4
#: Members of a group, and hashes of theirs, that one block holds; columns that are multiplied at a time.
BLOCK, BLOCK_HASHES, COLUMNS = 512, 1 << 20, 4096
#: By how much a bound on a similarity is loosened, so that rounding never excludes a pair.
SLACK = 1e-6
#: Bits are cut into this many blocks more than may differ in the join key.
KEPT_BLOCKS = 3


def _packed_hashes(text: str | None, size: int) -> bytes:
    """Hashes of all shingles of a text, repeats included, eight bytes each."""
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return b""
    shingles = [" ".join(words)] if len(words) < size else map(" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in shingles])


def text_fingerprint(text: str | None, size: int = 3) -> int:
    """Fingerprint of one text as an unsigned number; zero without a word."""
    return _majority(_packed_hashes(text, size))


def _majority(packed: bytes) -> int:
    total = len(packed) // 8
    ones = np.zeros(64, np.int64)
    # In pieces, so that a very long text does not expand to one byte a bit at once.
    for at in range(0, len(packed), 8 * 65536):
        part = np.frombuffer(packed, np.uint8, min(8 * 65536, len(packed) - at), at)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: Column, size: int = 3) -> Column:
    """SimHash of a text column as a long that holds the 64 bits."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, size) for t in texts], np.uint64).astype(np.int64))

    return simhash(text)


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _blocks(parts: int) -> list[int]:
    """Bit masks of ``parts`` runs of bits that make up a fingerprint."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _references(count: int) -> list[int]:
    draw = random.Random(64)
    return [draw.getrandbits(64) for _ in range(count)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def linked_pairs(prints: DataFrame, distance: int = 2, references: int = 20) -> DataFrame:
    """All pairs ``(a, b)`` with ``a < b`` of the distinct ``bits`` that differ in at most ``distance`` bits."""
    masks, refs = _blocks(KEPT_BLOCKS + distance), _references(references)
    here = [[F.bit_count(F.col("bits").bitwiseXOR(F.lit(_signed(r))).bitwiseAND(F.lit(_signed(m)))) for r in refs] for m in masks]
    # A block's distance vector as one number, so that a triple of blocks is a narrow join key.
    spots = prints.select("bits", F.array(*[F.xxhash64(*row) for row in here]).alias("spot"), F.array(*[sum(col[1:], col[0]).cast("byte") for col in zip(*here)]).alias("far"))
    keys = [F.xxhash64(F.lit(n), *[F.col("spot")[i] for i in kept]) for n, kept in enumerate(combinations(range(len(masks)), KEPT_BLOCKS))]
    met = spots.select("bits", "far", F.explode(F.array(*keys)).alias("key"))
    x, y = met.alias("x"), met.alias("y")
    near = F.array_max(F.zip_with("x.far", "y.far", lambda p, q: F.abs(p - q))) <= distance
    same = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= distance
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where("x.bits < y.bits").where(near).where(same)
    return pairs.select(F.col("x.bits").alias("a"), F.col("y.bits").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, distance: int = 2, references: int = 20) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, bits, component_id)``.

    Documents link when their fingerprints differ in at most ``distance`` bits; ``component_id`` is the
    smallest id reachable over links. Null, empty and wordless texts have fingerprint zero and link like
    any other. A repeated id keeps its rows and joins what each of them links with. A null id takes part
    as a copy, but is never the smallest id unless all ids of its group are null. Other columns are not
    read. An empty table gives no rows.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size).alias("bits")), "simhash")
    prints = stored(rows.groupBy("bits").agg(F.min("id").alias("low")), "prints")
    pairs = stored(linked_pairs(prints.select("bits"), distance, references), "pairs")
    # A repeated id carries the links of all its rows.
    many = rows.where("id is not null").groupBy("id").agg(F.min("bits").alias("a"), F.max("bits").alias("b")).where("a <> b")
    also = rows.join(many.select("id", "a"), "id").where("bits <> a").select("a", F.col("bits").alias("b"))
    groups = connected_components(pairs.unionByName(also))
    placed = prints.join(groups, prints.bits == groups.node, "left").select("bits", "low", F.coalesce("component", "bits").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    final = placed.join(lows, "component").select("bits", "component_id")
    return rows.join(final, "bits").select(F.col("id").alias(id_col), "bits", "component_id")


def sample_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of ``SAMPLES`` small samples of a set of shingle hashes.

    The hashes are dealt into bins and the smallest of each bin is drawn, so two sets draw the same hash
    from a bin as often as they are similar; an empty bin borrows from the next one that is not.
    """
    bins = SAMPLES * DRAWN
    drawn = np.zeros(bins, np.uint64)
    if len(hashes):
        ordered = np.sort(hashes)
        filled, first = np.unique(ordered % np.uint64(bins), return_index=True)
        at = np.searchsorted(filled, np.arange(bins, dtype=np.uint64)) % len(filled)
        away = (filled[at].astype(np.int64) - np.arange(bins)) % bins
        # A borrowed hash is changed by the distance, so that one shingle does not fill a sample.
        drawn = ordered[first[at]] ^ (away.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b, c, d = drawn.reshape(SAMPLES, DRAWN).T
    return (a & b & (c | d)) | (c & d & (a | b))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text as unsigned numbers in order."""
    # The digests are big-endian numbers.
    return np.unique(np.frombuffer(_packed_hashes(text, size), ">u8").astype(np.uint64))


def linked_roots(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, kinds: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of some sets are as alike as asked to another of another kind, and the first one each is tied with.

    Overlaps are products of 0/1 matrices over the hashes that more than one set has, some columns at a time.
    Where there are two sides only pairs across them are looked at.
    """
    left, right = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if side.min() != side.max() else (np.arange(len(sets)),) * 2
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[part], column[part] - at] = 1
        common += dense[left] @ dense[right].T
    both = sizes[left][:, None] + sizes[right][None, :] - common.astype(np.float64)
    alike = (common / np.maximum(both, 1) >= similarity) & (kinds[left][:, None] != kinds[right][None, :])
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(left, right)] = alike
    linked |= linked.T
    return linked.any(1), _roots(linked)


def tied_across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` that tie together the nodes of a group which are alike but in different components.

    ``members`` is (n, sample, node, component), a group being an ``(n, sample)``. Every pair of a group in
    different components is compared, inside tasks: a group is dealt into blocks of bounded size, a component
    that fills blocks has its own, so a block never meets another of the same component. A task returns a row
    per node that has a link, never the pairs.
    """
    # Written before it is read several times: the plans of what follows stay small.
    sized = stored(members.join(sets.select("node", F.size("hashes").alias("size")), "node"), "members")
    most = lambda of: F.greatest(F.ceil(F.sum(of[0]) / BLOCK), F.ceil(F.sum(of[1]) / BLOCK_HASHES)).cast("int")
    parts = stored(sized.groupBy("n", "sample", "component").agg(most((F.lit(1), "size")).alias("own"), F.count("*").alias("count"), F.sum("size").alias("hashes")), "parts")
    # Components that fill no block share some.
    pooled = F.when(F.col("own") > 1, F.lit(0))
    block = lambda component, part: F.struct(component.cast("long").alias("component"), part.cast("int").alias("part"))
    numbered = lambda component, count: F.transform(F.sequence(F.lit(1), count), lambda i: block(component, i - 1))
    mine = F.when(F.col("own") > 1, block(F.col("component"), F.pmod(F.hash("node"), "own"))).otherwise(block(F.lit(None), F.pmod(F.hash("node"), "pools")))
    groups = parts.groupBy("n", "sample").agg(
        most((F.coalesce(pooled, "count"), F.coalesce(pooled, "hashes"))).alias("pools"),
        F.collect_list(F.when(F.col("own") > 1, F.struct("component", "own"))).alias("large"),
    )
    shared = F.when(F.col("pools") > 0, numbered(F.lit(None), F.col("pools"))).otherwise(F.array().cast("array<struct<component: long, part: int>>"))
    groups = groups.select("n", "sample", "pools", F.concat(shared, F.flatten(F.transform("large", lambda x: numbered(x["component"], x["own"])))).alias("blocks"))
    dealt = sized.join(parts.select("n", "sample", "component", "own"), ["n", "sample", "component"]).join(groups, ["n", "sample"]).withColumn("block", mine)
    # A block of a large component does not meet another of that component, nor itself.
    others = F.filter("blocks", lambda o: F.coalesce(o["component"] != F.col("block.component"), F.lit(True)))
    run = ["cell", "b1", "b2"]
    number = lambda c: F.xxhash64(F.coalesce(c["component"], F.lit(0)), c["component"].isNull(), c["part"])
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.select("node", "component", F.xxhash64("n", "sample").alias("cell"), number(F.col("block")).alias("block"), number(F.col("other")).alias("other"))
    dealt = dealt.select("node", "component", "cell", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    filled = together(dealt.join(sets, "node"), run)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, run):
            rows = rows.combine_chunks()
            if rows.num_rows < 2:
                continue
            column = rows.column("hashes").chunk(0)
            flat, edges = column.flatten().to_numpy(), np.cumsum([0, *np.diff(column.offsets.to_numpy())])
            sets_here = [flat[a:b] for a, b in zip(edges, edges[1:])]
            linked, root = linked_roots(sets_here, np.diff(edges), rows.column("block").to_numpy(), rows.column("component").to_numpy(), similarity)
            node = rows.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root][linked])], names=["a", "b"])

    return filled.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, component_id)``, grouped by similarity of their shingles.

    Two bits of a whole fingerprint are far fewer than similar texts differ in: about ten at a similarity of
    0.8. Pairs are therefore also looked for by the SimHashes of small samples of their shingles, which are
    equal where the samples are. All pairs found either way are verified by the Jaccard index of their whole
    sets of shingle hashes; the sets are made again from the texts that stand in a pair, not kept of all. In
    a group that shares a sample, members are compared with its first and last one; where that leaves a
    group in several components, those of different ones are compared with each other by :func:`tied_across`.
    Nulls, repeated ids, clashing names and empty tables are treated as in :func:`near_duplicates`.
    """

    @F.pandas_udf("node long, bits long, samples array<long>, size int")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingle_hashes(text, size)
            node = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64)
            rows.append((node, np.uint64(_majority(_packed_hashes(text, size))).astype(np.int64), sample_fingerprints(hashes).astype(np.int64), len(hashes)))
        return pd.DataFrame(rows, columns=["node", "bits", "samples", "size"])

    @F.pandas_udf("array<long>")
    def whole_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(text, size).astype(np.int64) for text in texts], dtype=object)

    # A row is named by its id and text, so that one of each node can be read again.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("copy", F.xxhash64("id", "text"))
    rows = stored(texts.select("id", "copy", sketch("text").alias("s")).select("id", "copy", "s.*"), "sketches")
    nodes = stored(rows.groupBy("node").agg(F.min("id").alias("low"), F.min("copy").alias("copy"), F.min("bits").alias("bits"), F.first("samples").alias("samples"), F.first("size").alias("size")), "nodes")
    shown = nodes.select("node", "size", F.posexplode("samples").alias("n", "sample")).unionByName(nodes.select("node", "size", F.lit(-1).alias("n"), F.col("bits").alias("sample")))
    ends = shown.groupBy("n", "sample").agg(F.min(F.struct("node", "size")).alias("first"), F.max(F.struct("node", "size")).alias("last")).where("first.node < last.node")
    met = shown.join(ends, ["n", "sample"]).select(F.struct("node", "size").alias("x"), F.explode(F.array("first", "last")).alias("y"))
    one = nodes.groupBy("bits").agg(F.min(F.struct("node", "size")).alias("x"))
    near = linked_pairs(one.select("bits"), distance)
    near = near.join(one.select(F.col("bits").alias("a"), "x"), "a").join(one.select(F.col("bits").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
    # Sets of too different sizes cannot be alike.
    pairs = met.unionByName(near).where("x.node <> y.node").where(F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - SLACK)
    pairs = stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    # Only the sets of texts that stand in a pair or a larger group are made, one row per node.
    larger = shown.groupBy("n", "sample").agg(F.count("*").alias("members")).where("members > 3").select("n", "sample")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shown.join(larger, ["n", "sample"]).select("node"))
    wanted = wanted.distinct().join(nodes.select("node", "copy"), "node")
    sets = stored(texts.join(wanted, "copy").select("node", "text").dropDuplicates(["node"]).select("node", whole_set("text").alias("hashes")), "sets")

    def verified(candidates: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return candidates.join(x, "a").join(y, "b").where(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b")

    links = stored(verified(pairs), "links")
    many = rows.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    groups = connected_components(links.unionByName(rows.join(many, "id").where("node <> a").select("a", F.col("node").alias("b"))))
    placed = stored(nodes.select("node", "low").join(groups, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component")), "placed")
    # Up to three members have all met by way of the first and the last.
    open_groups = shown.select("node", "n", "sample").join(placed.select("node", "component"), "node").groupBy("n", "sample")
    open_groups = open_groups.agg(F.count("*").alias("members"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("members > 3 and c1 < c2")
    members = shown.select("n", "sample", "node").join(open_groups.select("n", "sample"), ["n", "sample"]).join(placed.select("node", "component"), "node")
    late = stored(tied_across(members, sets, similarity), "late")
    # The components found so far are the nodes of the second round.
    at = placed.select("node", "component")
    across = late.join(at.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(at.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    joined = connected_components(across.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("larger"))
    placed = placed.join(joined, "component", "left").select("node", "low", F.coalesce("larger", "component").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.select("id", "node").join(placed.join(lows, "component").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row per group of ``found``: the one with the smallest id.

    Of rows that repeat an id the one with the smallest text (null as empty) stays. Rows without an id
    cannot be named in a group, so they all stay.
    """
    found = stored(found.select(F.col(id_col).alias("id"), "component_id"), "groups")
    name, packed = free_name(docs, "kept_id"), free_name(docs, "kept_row")
    gone = found.where("id <> component_id").select(F.col("id").alias(name)).distinct()
    # Merged whatever the size, as it must be where many documents go.
    kept = docs.join(gone.hint("merge"), F.col(id_col) == F.col(name), "left_anti")
    twice = found.groupBy("id").count().where("id is not null and count > 1").select(F.col("id").alias(name))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, F.col(id_col) == F.col(name), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy(F.col(id_col).alias(name)).agg(F.min_by(row, F.coalesce(F.col(text_col), F.lit(""))).alias(packed)).select(f"{packed}.*")
    return kept.join(twice, F.col(id_col) == F.col(name), "left_anti").unionByName(one)
