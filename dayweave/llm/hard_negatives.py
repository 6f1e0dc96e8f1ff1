"""Hard negatives of anchor vectors by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into keys of anchor, descending score and id, and a
``repartitionAndSortWithinPartitions`` brings every anchor's pairs to one partition in that order. An iterator
then streams over them: a positive opens a window of scores, a negative is given to every open window it lies
in, a window closes when it is full or passed. An anchor is never held: at most its few open windows are.

Not every pair is shuffled. Anchors meet all rows in blocks of bounded size; a block keeps of each anchor the
best rows of its label (of all blocks together these give the positives) and then, the windows being known,
the best negatives of each window. What a block leaves out cannot be among the first of the whole, so the
stream has the same result as if it had all pairs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm.common import stored
from dayweave.plans.pointers import together

#: Anchors and rows of one block, and rows that are scored at a time.
ANCHORS, ROWS, SLICE = 4096, 16384, 512
#: Scores are longs; what lies beyond is held at their ends.
MOST = (1 << 63) - 1
POSITIVE, NEGATIVE = 0, 1
KEY = struct.Struct(">QQQBQQ")
SHIFT = 1 << 63
WINDOWS = "array<struct<score: long, id: long, tag: long>>"
FOUND = "anchor long, anchor_tag long, score long, id long, tag long"


def pack(anchor: int, anchor_tag: int, score: int, kind: int, row: int, tag: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id."""
    return KEY.pack(anchor + SHIFT, anchor_tag + SHIFT, SHIFT - 1 - score, kind, row + SHIFT, tag + SHIFT)


def unpack(key: bytes) -> tuple[int, int, int, int, int, int]:
    anchor, anchor_tag, score, kind, row, tag = KEY.unpack(key)
    return anchor - SHIFT, anchor_tag - SHIFT, SHIFT - 1 - score, kind, row - SHIFT, tag - SHIFT


def stream(keys: Iterator[bytes], low: int, high: int, wanted: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(anchor, positive, rank, negative, positive score, negative score)`` from keys in order.

    Holds the open windows of one anchor: positive, its score, negatives given so far.
    """
    here, open_windows = None, []
    for key in keys:
        anchor, anchor_tag, score, kind, row, _ = unpack(key)
        if (anchor, anchor_tag) != here:
            here, open_windows = (anchor, anchor_tag), []
        if kind == POSITIVE:
            open_windows.append([row, score, 0])
            continue
        left = []
        for window in open_windows:
            positive, top, given = window
            if 100 * score < low * top:
                continue
            if 100 * score <= high * top:
                given += 1
                window[2] = given
                yield anchor, positive, given, row, top, score
            if given < wanted:
                left.append(window)
        open_windows = left


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, as longs."""
    most = (np.abs(anchors).max(initial=0), np.abs(rows).max(1, initial=0))
    easy = most[0] * most[1] * max(1, anchors.shape[1]) < 2.0**53
    out = np.empty((len(anchors), len(rows)), np.int64)
    out[:, easy] = (anchors @ rows[easy].T).astype(np.int64)
    if not easy.all():
        # Beyond the whole numbers a double can hold: Python's own.
        whole = np.frompyfunc(int, 1, 1)
        out[:, ~easy] = np.clip(whole(anchors) @ whole(rows[~easy]).T, -MOST - 1, MOST).astype(np.int64)
    return out


class Block:
    """The best rows of each anchor's windows among the rows of one block seen so far."""

    def __init__(self, anchors: pa.Table, wanted: int, same_label: bool, low: int, high: int):
        self.ids, self.tags, self.labels = (anchors.column(c).to_numpy() for c in ("id", "tag", "label"))
        self.vectors = _matrix(anchors.column("vector"))
        self.wanted, self.same_label, self.low, self.high = wanted, same_label, low, high
        tops = [w or [] for w in anchors.column("windows").to_pylist()]
        self.windows = 1 if same_label else max(1, max(map(len, tops), default=1))
        #: Per window: the positive's score, whether there is one, the least score that can still enter.
        self.top = np.zeros((len(self.ids), self.windows), np.int64)
        self.used = np.full((len(self.ids), self.windows), same_label)
        for a, some in enumerate(tops if not same_label else []):
            for w, one in enumerate(some):
                self.top[a, w], self.used[a, w] = one["score"], True
        self.least = np.full((len(self.ids), self.windows), -MOST - 1)
        if not same_label:
            # Half of a score, say, rounded up: whole scores from there on are inside.
            self.least = _bound(self.top, low, up=True)
            self.most = _bound(self.top, high, up=False)
        self.held = [pd.DataFrame(columns=["a", "score", "id", "tag"]).astype(np.int64) for _ in range(self.windows)]

    def meet(self, rows: pa.Table) -> None:
        ids, tags, labels, vectors = rows.column("id").to_numpy(), rows.column("tag").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("vector"))
        for at in range(0, len(ids), SLICE):
            part = slice(at, at + SLICE)
            scores = _scores(self.vectors, vectors[part])
            usable = self.labels[:, None] == labels[part][None, :]
            if self.same_label:
                usable &= (self.ids[:, None] != ids[part][None, :]) | (self.tags[:, None] != tags[part][None, :])
            else:
                usable = ~usable
            for w in range(self.windows):
                good = usable & self.used[:, w, None] & (scores >= self.least[:, w, None])
                if not self.same_label:
                    good &= scores <= self.most[:, w, None]
                a, r = np.nonzero(good)
                if len(a):
                    self._keep(w, pd.DataFrame({"a": a, "score": scores[a, r], "id": ids[part][r], "tag": tags[part][r]}))

    def _keep(self, w: int, new: pd.DataFrame) -> None:
        both = pd.concat([self.held[w], new], ignore_index=True)
        both = both.sort_values(["a", "score", "id", "tag"], ascending=[True, False, True, True], kind="stable")
        self.held[w] = both[both.groupby("a").cumcount() < self.wanted]
        full = self.held[w].groupby("a")["score"].agg(["size", "min"])
        full = full[full["size"] == self.wanted]
        # A row with the last score may still enter by its id.
        self.least[full.index.to_numpy(), w] = full["min"].to_numpy()

    def found(self) -> pa.RecordBatch:
        all_held = pd.concat(self.held, ignore_index=True).drop_duplicates()
        a = all_held["a"].to_numpy()
        columns = [self.ids[a], self.tags[a], all_held["score"].to_numpy(), all_held["id"].to_numpy(), all_held["tag"].to_numpy()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "anchor_tag", "score", "id", "tag"])


def _bound(top: np.ndarray, share: int, *, up: bool) -> np.ndarray:
    """``share`` hundredths of whole numbers, rounded up or down without overflow."""
    rest = (top % 100) * share
    return top // 100 * share + (-(-rest // 100) if up else rest // 100)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(id, tag, label, vector)``: rows that take part, components as whole numbers, exact repeats once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # Doubles of that size are whole already; 256 times the largest of them would be infinite.
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 1e13, F.floor(x * 256).cast("double")).when(F.abs(x) < 1e300, x * 256).otherwise(x))
    rows = rows.withColumn("vector", whole)
    return rows.groupBy("id", "label", "vector").agg(F.lit(1)).select("id", F.xxhash64("label", "vector").alias("tag"), "label", "vector")


def _in_blocks(rows: DataFrame, anchors: DataFrame, group: list[str], wanted: int, same_label: bool, low: int, high: int) -> DataFrame:
    """The best ``wanted`` rows of every window of every anchor, per block of rows."""
    sized = rows.withColumn("size", F.size("vector"))
    heads = anchors.withColumn("size", F.size("vector"))
    parts = sized.groupBy(*group).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("row_parts"))
    parts = parts.join(heads.groupBy(*group).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("anchor_parts")), group)
    mine = F.pmod(F.hash("id", "tag"), F.col("row_parts"))
    dealt_rows = sized.join(parts, group).select(*group, F.lit(1).alias("side"), "id", "tag", F.col("label").alias("own_label"), "vector", F.lit(None).cast(WINDOWS).alias("windows"), mine.alias("rb"), F.explode(F.sequence(F.lit(0), F.col("anchor_parts") - 1)).alias("ab"))
    block = F.pmod(F.hash("id", "tag"), F.col("anchor_parts"))
    dealt_anchors = heads.join(parts, group).select(*group, F.lit(0).alias("side"), "id", "tag", F.col("label").alias("own_label"), "vector", "windows", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("rb"), block.alias("ab"))
    run = [*group, "ab", "rb"]
    dealt = together(dealt_anchors.unionByName(dealt_rows), run, "side")
    dealt = dealt.select(*run, "side", "id", "tag", F.col("own_label").alias("label_of"), "vector", "windows")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            named = pa.Table.from_batches([batch])
            keys = np.stack([batch.column(k).to_numpy() for k in run] + [batch.column("side").to_numpy()], 1)
            edges = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                part = named.slice(a, b - a).select(["id", "tag", "label_of", "vector", "windows"]).rename_columns(["id", "tag", "label", "vector", "windows"])
                place = tuple(keys[a, :-1])
                if place != last:
                    if block:
                        yield block.found()
                    last, heads, block = place, [], None
                if keys[a, -1] == 0:
                    heads.append(part)
                    continue
                if block is None and heads:
                    block, heads = Block(pa.concat_tables(heads), wanted, same_label, low, high), []
                if block:
                    block.meet(part)
        if block:
            yield block.found()

    return dealt.mapInArrow(best, FOUND)


def sorted_by_key(keys: RDD, partitions: int) -> RDD:
    """The secondary sort: keys of one anchor in one partition, in order."""
    return keys.map(lambda key: (key, None)).repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[:16])).keys()


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives: ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(256 * x)``, scores are integer inner products, higher ones first and equal ones
    by the smaller id. Rows for which ``anchor`` (over the column ``id``) holds are anchors; an anchor's
    positives are its first ``positives`` other rows of the same ``label``; each positive gets its first
    ``negatives`` rows of another label whose score lies between ``low`` and ``high`` hundredths of the
    positive's. Anchors and positives that get none have no row.

    Rows without an id or label, with a null vector or a null or non-finite component take no part. Vectors
    meet only vectors with as many components; empty ones score zero. Exact repeats of a row (id, label,
    vector) count once; rows that repeat an id otherwise are rows of their own, also as anchors. Scores beyond
    a long are held at its ends. Other columns are not read; an empty table gives no rows.
    """
    label = F.col("label") if label is None else label
    rows = stored(usable_rows(vectors, id_col, vector_col, label), "negatives-rows")
    heads = rows.where(anchor)
    near = _in_blocks(rows, heads.withColumn("windows", F.lit(None).cast(WINDOWS)), ["label", "size"], positives, True, low, high)
    ranked = Window.partitionBy("anchor", "anchor_tag").orderBy(F.desc("score"), "id", "tag")
    first = near.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= positives).drop("_n")
    first = stored(first, "positives")
    windows = first.groupBy(F.col("anchor").alias("id"), F.col("anchor_tag").alias("tag")).agg(F.collect_list(F.struct("score", "id", "tag")).cast(WINDOWS).alias("windows"))
    far = _in_blocks(rows, heads.join(windows, ["id", "tag"]), ["size"], negatives, False, low, high)
    pairs = stored(first.withColumn("kind", F.lit(POSITIVE)).unionByName(far.withColumn("kind", F.lit(NEGATIVE))), "scores")

    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = pairs.select("anchor", "anchor_tag", "score", "kind", "id", "tag").rdd.map(lambda r: pack(*r))
    found = sorted_by_key(keys, partitions).mapPartitions(lambda part: stream(part, low, high, negatives))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
