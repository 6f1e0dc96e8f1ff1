"""Packing documents into sequences of fixed capacity by fitted length patterns.

Documents are cut into pieces no longer than the capacity. How many pieces there are of each length is a
histogram of at most ``capacity`` numbers, whatever the size of the corpus, and is all the driver sees. On
it, patterns of two or three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted by non-negative least squares and rounded, and what is left is packed best-fit decreasing, again by
length and count. The plan is a table of slots per length; every piece finds its slot by its rank among the
pieces of its length, counted in chunks so that a frequent length is not one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm.bpe import loaded
from dayweave.llm.common import stored

#: Pieces of one length that are ranked together.
RANKED = 2000

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``size`` ids; only the first may be shorter than the capacity."""
    if size <= capacity:
        return [(0, size)]
    first = size % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, size, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, *, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: ``(id, piece, start, length, ids_crc32)``.

    A document is the ids of its text and ``end_id``; a null text counts as empty. Rows that repeat an id
    are documents of their own, as are rows without one. Other columns are not read.
    """
    end = int(end_id).to_bytes(4, "little")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1)):
                raw = encoder.encode_quick([text.as_py() or ""])[0] + end
                rows += [(key.as_py(), n, a, k, zlib.crc32(raw[4 * a : 4 * (a + k)])) for n, (a, k) in enumerate(cut(len(raw) // 4, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(split, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of the given lengths that sum to the capacity; 0 fills the third place."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    small = np.flatnonzero(have)
    found = []
    for a in small[1:]:
        b = small[(small <= a) & (capacity - a - small <= small) & (capacity - a - small >= 0)]
        b = b[have[capacity - a - b] & (b > 0)]
        if a < capacity and len(b):
            found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_squares(rows: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts of the patterns, none negative, that come closest to the histogram.

    Multiplicative steps: they keep counts non-negative and never raise the squared error.
    """
    size, width = len(counts), rows.shape[1]
    flat = rows.reshape(-1)

    def pull(values: np.ndarray) -> np.ndarray:
        values[0] = 0
        return values[rows].sum(1)

    wanted = pull(counts.astype(float))
    repeat = np.full(len(rows), counts.sum() / max(1, width * len(rows)))
    for _ in range(steps):
        have = np.bincount(flat, np.repeat(repeat, width), size)
        repeat = repeat * wanted / np.maximum(pull(have), 1e-12)
    return repeat


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: sequences as ``(((length, times), ...), repeats)``.

    Equal open sequences are handled together, so the work depends on the number of lengths only.
    """
    open_by_gap: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {capacity: []}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for gap in sorted(g for g in open_by_gap if g >= length):
            if not left:
                break
            fits, waiting = gap // length, open_by_gap.pop(gap)
            keep = []
            for held, repeats in waiting:
                full = min(repeats, left // fits)
                rest = (left - full * fits) if full < repeats else 0
                for times, n in ((fits, full), (rest, 1 if rest else 0)):
                    if n:
                        open_by_gap.setdefault(gap - times * length, []).append(((*held, (length, times)), n))
                        left -= times * n
                if repeats - full - (1 if rest else 0):
                    keep.append((held, repeats - full - (1 if rest else 0)))
            if keep:
                open_by_gap.setdefault(gap, []).extend(keep)
        if left:
            fits = capacity // length
            for times, n in ((fits, left // fits), (left % fits, 1)):
                if times and n:
                    open_by_gap.setdefault(capacity - times * length, []).append((((length, times),), n))
    return [x for group in open_by_gap.values() for x in group]


def plan(counts: np.ndarray, capacity: int, rounds: int = 4) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences for a histogram of piece lengths, as ``(((length, times), ...), repeats)``.

    Each round fits patterns to what the former left. A fit that leaves lengths which go together worse,
    as where only few lengths occur, is undone: the round with the fewest sequences in all counts.
    """
    left = counts.astype(np.int64).copy()
    made = []
    if left[capacity]:
        made.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    total = lambda some: sum(repeats for _, repeats in some)
    best = made + best_fit(left, capacity)
    for _ in range(rounds):
        rows = patterns(np.flatnonzero(left), capacity)
        if not len(rows):
            break
        repeat = np.rint(least_squares(rows, left)).astype(np.int64)
        before = len(made)
        for n in np.argsort(-repeat, kind="stable"):
            if repeat[n] <= 0:
                break
            kinds, times = np.unique(rows[n][rows[n] > 0], return_counts=True)
            use = int(min(repeat[n], (left[kinds] // times).min()))
            if use > 0:
                left[kinds] -= use * times
                made.append((tuple(zip(kinds[::-1].tolist(), times[::-1].tolist())), use))
        if len(made) == before:
            break
        tried = made + best_fit(left, capacity)
        best = tried if total(tried) <= total(best) else best
    return best


@dataclass
class Slots:
    """Where the pieces of each length go: runs of slots by rank, in flat arrays sorted by length and rank."""

    first: np.ndarray  # length -> index of its first run; one more entry ends the last
    rank: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray


def slots(made: list[tuple[tuple[tuple[int, int], ...], int]], capacity: int) -> Slots:
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    used, sequence = [0] * (capacity + 1), 0
    for held, repeats in made:
        offset = 0
        for length, times in held:
            runs[length].append((used[length], sequence, times, offset))
            used[length] += repeats * times
            offset += length * times
        sequence += repeats
    flat = np.array([r for some in runs for r in some], np.int64).reshape(-1, 4)
    return Slots(np.cumsum([0, *map(len, runs)]), *flat.T)


def pack(table: DataFrame, capacity: int = 1024) -> DataFrame:
    """``table`` of :func:`pieces` with ``sequence_id`` and ``offset``: every piece in one sequence, without gaps.

    Runs over the table twice, so pass stored rows. An empty table gives no rows.
    """
    spark = table.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in table.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row.length] = row.n
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity), capacity))
    shares = F.array(*[F.lit(int(-(-n // RANKED)) or 1) for n in counts])
    rows = table.withColumn("_chunk", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.element_at(shares, F.col("length").cast("int") + 1)))
    sizes = rows.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head"))
    inside = Window.partitionBy("length", "_chunk").orderBy("id", "piece", "ids_crc32")
    ranked = rows.withColumn("_in", F.row_number().over(inside)).join(heads, ["length", "_chunk"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, size, at = shared.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # Length and rank as one number keep the search in the runs of the length.
        runs = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first)) * (1 << 44) + s.rank
        run = np.searchsorted(runs, size * (1 << 44) + at, side="right") - 1
        inner = at - s.rank[run]
        return pd.DataFrame({"sequence_id": s.sequence[run] + inner // s.times[run], "offset": s.offset[run] + inner % s.times[run] * size})

    found = ranked.select("id", "piece", "start", "length", "ids_crc32", placed("length", F.col("_head") + F.col("_in") - 1).alias("_at"))
    return found.select("id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, *, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack ``docs``: one row per piece, ``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``."""
    table = stored(pieces(docs, path, pattern, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(table, capacity).withColumnRenamed("id", id_col)
