"""Near-duplicate vectors by collision-counting projections.

Every vector is projected on many random lines. Vectors are brought together by sorting on groups of lines
cut into cells (tables), so that only neighbours on several lines meet; how many lines a table takes follows
the number of vectors, how many tables follows from the chance that a pair at the limit meets in none. Of
two vectors that meet, collisions are counted over many single lines with a window centred on each, pairs
with fewer than a count that a true pair misses about once in a million are discarded, and the rest are
verified by their cosine in double precision.

Equal vectors are one point with a weight, so copies never meet as pairs. A crowded cell is cut into blocks
and compared block by block; a task returns link counts and the groups it found, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.llm.common import stored
from dayweave.plans.graphs import connected_components

#: Width of a cell in units of the distance of a pair at the limit.
CELL = 6.0
#: Half width of a counting window in the same units, and how many lines are counted.
WINDOW = 2.5
COUNTED = 32
#: Chance that a pair at the limit meets in no table; that its collisions stay below the count.
MISSED, UNCOUNTED = 1e-4, 1e-6
#: Vectors of one cell that are compared at a time.
BLOCK = 512


def _tail(x: float) -> float:
    return math.erfc(x / math.sqrt(2)) / 2


class Lines:
    """Random lines, tables and counts for one limit and number of vectors; the same on every executor."""

    def __init__(self, cosine: float, vectors: int):
        self.cosine = cosine
        self.near = math.sqrt(2 - 2 * cosine)
        self.width = CELL * self.near
        same = 1 - self.near * math.sqrt(2 / math.pi) / self.width
        ratio = self.width / math.sqrt(2)
        apart = 1 - 2 * _tail(ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))
        # Unrelated vectors should meet about once a table.
        self.per_table = min(32, max(4, math.ceil(math.log(max(vectors, 2)) / -math.log(apart))))
        self.tables = math.ceil(math.log(MISSED) / math.log(1 - same**self.per_table))
        hit = 1 - 2 * _tail(WINDOW)
        below, least = 0.0, 0
        while below + math.comb(COUNTED, least) * hit**least * (1 - hit) ** (COUNTED - least) <= UNCOUNTED:
            below += math.comb(COUNTED, least) * hit**least * (1 - hit) ** (COUNTED - least)
            least += 1
        self.least = least
        self.drawn: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"drawn": {}}

    def _draw(self, dim: int) -> tuple:
        if dim not in self.drawn:
            draw = np.random.default_rng(dim)
            n = max(self.tables * self.per_table, COUNTED)
            self.drawn[dim] = (draw.standard_normal((dim, n)), draw.random(n) * self.width, draw.integers(1, 1 << 62, n, np.int64) * 2 + 1)
        return self.drawn[dim]

    def project(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places on the counted lines, and the cell of every table as one number each."""
        directions, shift, mix = self._draw(units.shape[1])
        places = units @ directions
        used = self.tables * self.per_table
        cells = np.floor((places[:, :used] + shift[:used]) / self.width).astype(np.int64)
        with np.errstate(over="ignore"):
            keys = (cells * mix[:used]).reshape(len(units), self.tables, self.per_table).sum(2)
        return places[:, :COUNTED], keys


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one number of components each."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for size in np.unique(sizes):
        yield batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of every run of equal keys in a sorted partition, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            here = tuple(c[a] for c in columns)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _links(lines: Lines, table: int, units: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the links among the members of a cell, and of those that no earlier table shows."""
    places, keys = lines.project(units)
    size = len(units)
    counts = np.zeros((size, size), np.int8)
    for line in places.T:
        counts += np.abs(line[:, None] - line[None, :]) <= WINDOW * lines.near
    pairs = np.argwhere(counts >= lines.least)
    a, b = pairs[:, 0], pairs[:, 1]
    # In a pair of blocks only what lies across them belongs to this comparison.
    keep = (a != b) & ((side[a] != side[b]) | (side.min() == side.max()))
    a, b = a[keep], b[keep]
    good = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        good[part] = (units[a[part]] * units[b[part]]).sum(1) >= lines.cosine
    a, b = a[good], b[good]
    linked, first = np.zeros((size, size), bool), np.zeros((size, size), bool)
    linked[a, b] = True
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        first[x, y] = (keys[x] == keys[y]).argmax(1) == table
    return linked, first


def _roots(linked: np.ndarray) -> np.ndarray:
    """For every member the first one it is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(1))
        if (low == root).all():
            return root
        root = low[low]


def points(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(point, label, vector, low, n)``: the distinct usable vectors of each label."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), wide.alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(usable)
    # Scaled by the largest component, so that the squares of very small or large ones are still numbers.
    grouped = rows.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    return grouped.withColumn("point", F.xxhash64("label", "vector"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: ``(id_col, n_links, component_id, kept)``.

    Vectors link when their labels are equal, neither null, and their cosine is at least ``cosine``; vectors
    of different length do not. A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing and is its own component, as does one without a label. Copies count in ``n_links``
    like any other vector. A row without an id takes no part: no links, a null component, not kept. Rows
    that repeat an id are vectors of their own. Other columns are not read; an empty table gives no rows.
    """
    found = stored(points(vectors, id_col, vector_col, label_col), "points")
    lines = Lines(cosine, found.count())

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches if whole.num_rows for part in _by_size(whole, "vector")):
            raw = _matrix(batch.column("vector"))
            raw = raw / np.abs(raw).max(1)[:, None]
            _, keys = lines.project(_units(raw))
            number = np.tile(np.arange(lines.tables, dtype=np.int32), len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("point").to_numpy(), lines.tables)), pa.array(number), pa.array(keys.reshape(-1))], names=["point", "table", "cell"])

    # A label and a length are part of the cell: only equal ones may meet.
    sorted_in = found.select("point", "vector").mapInArrow(cells, "point long, table int, cell long")
    sorted_in = sorted_in.join(found.select("point", F.xxhash64("label", F.size("vector")).alias("kind")), "point").select("point", "table", F.xxhash64("kind", "table", "cell").alias("cell"))
    sorted_in = stored(sorted_in, "cells")
    crowded = sorted_in.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    members = sorted_in.join(crowded, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.hash("point"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("point", "table", "cell", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block")
    run = ["cell", "b1", "b2"]
    filled = members.join(found.select("point", "vector", "n", F.xxhash64("label", F.size("vector")).alias("kind")), "point")
    filled = filled.repartition(*run).sortWithinPartitions(*run, "point")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, run):
            # Different labels share a cell's number only when two hashes meet; they are told apart here.
            kind = rows.column("kind").to_numpy()
            for one in np.unique(kind):
                some = rows.filter(pa.array(kind == one)).combine_chunks()
                if some.num_rows < 2:
                    continue
                raw = _matrix(some.column("vector").chunk(0))
                raw = raw / np.abs(raw).max(1)[:, None]
                linked, first = _links(lines, some.column("table")[0].as_py(), _units(raw), some.column("block").to_numpy())
                if not linked.any():
                    continue
                point, weight = some.column("point").to_numpy(), some.column("n").to_numpy()
                any_link = linked.any(1)
                yield pa.RecordBatch.from_arrays([pa.array(point[any_link]), pa.array((first @ weight)[any_link]), pa.array(point[_roots(linked)][any_link])], names=["point", "links", "root"])

    groups = stored(filled.mapInArrow(compare, "point long, links long, root long"), "links")
    links = groups.groupBy("point").agg(F.sum("links").alias("links"))
    joined = connected_components(groups.select(F.col("point").alias("a"), F.col("root").alias("b")))
    placed = found.select("point", "label", "vector", "low", "n").join(joined, F.col("point") == F.col("node"), "left").withColumn("component", F.coalesce("component", "point"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = placed.join(lows, "component").join(links, "point", "left")
    placed = placed.select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")

    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("_vector"))
    met = rows.join(placed, (F.col("_label") == F.col("label")) & (F.col("_vector") == F.col("vector")) & F.col("_id").isNotNull(), "left")
    component = F.coalesce("component_id", "_id")
    return met.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
