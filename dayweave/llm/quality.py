"""A quality classifier over document statistics.

A document becomes a few statistics of its text: lengths, letter classes, repetition, function-like short
words. Random Fourier features of the scaled statistics approximate a Gaussian kernel, so a linear model over
them is a kernel model of fixed size. Every partition adds up its own part of the normal equations in one
matrix, the parts are added over the cluster, and one small system gives the ridge weights. An isotonic
regression on labelled documents that the weights have not seen turns scores into chances.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm.common import free_name, remainder, stored

TOKEN = re.compile(r"\S+")
#: Code points read at a time, so that a very long text is counted in pieces.
PIECE = 1 << 20
#: Sums of partitions are added by so many tasks before the driver adds theirs.
ADDERS = 16
#: Scores are counted in so many steps for the isotonic regression.
STEPS = 4096
STATISTICS = 18

# Character classes of the code points below 0x10000: letter, upper case, digit, white space.
LETTER, UPPER, DIGIT, SPACE = 1, 2, 4, 8
_CLASSES = np.zeros(0x10000, np.uint8)


def _classes() -> np.ndarray:
    if not _CLASSES.any():
        for i in range(len(_CLASSES)):
            c = chr(i)
            _CLASSES[i] = LETTER * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit() | SPACE * c.isspace()
    return _CLASSES


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text, shares and logarithms; zeros for a null or empty one."""
    text = text or ""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    kinds, marks = np.zeros(16, np.int64), np.zeros(128, np.int64)
    table = _classes()
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds += np.bincount(table[np.minimum(points, 0xFFFF)], minlength=16)
        marks += np.bincount(points[points < 128], minlength=128)
    number = len(text)
    letters = int(kinds[1::2].sum())
    words = TOKEN.findall(text)
    count = max(1, len(words))
    lower = [w.lower() for w in words]
    seen: dict[str, int] = {}
    for w in lower:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    squeezed = _squeezed(text)
    out[:] = (
        np.log1p(number),
        np.log1p(len(words)),
        sizes.mean() if len(words) else 0,
        sizes.std() if len(words) else 0,
        (sizes <= 3).mean() if len(words) else 0,
        len(seen) / count,
        # How evenly the words repeat: distinct words against the root of all, as it does not fall with length.
        len(seen) / count**0.5,
        max(seen.values(), default=0) / count,
        sum(a == b for a, b in zip(lower, lower[1:])) / count,
        kinds[[3, 7, 11, 15]].sum() / max(1, letters),
        kinds[4:8].sum() / number,
        (number - letters - kinds[4:8].sum() - kinds[8:].sum()) / number,
        sum(not any(c.isalpha() for c in w) for w in words) / count,
        (marks[ord(".")] + marks[ord("!")] + marks[ord("?")]) / count,
        marks[ord(",")] / count,
        1 - len(set(lines)) / max(1, len(lines)),
        squeezed,
        np.log1p(len(words) / max(1, len(lines))),
    )
    return out


def _squeezed(text: str) -> float:
    """Size of the text when compressed, as a share; in pieces, all of it."""
    packer, total, size = zlib.compressobj(1), 0, 0
    for at in range(0, len(text), PIECE):
        raw = text[at : at + PIECE].encode("utf-8", "surrogatepass")
        total += len(raw)
        size += len(packer.compress(raw))
    return (size + len(packer.flush())) / max(1, total)


@dataclass
class QualityModel:
    """Scale of the statistics, the random features, ridge weights, and the steps of the calibration."""

    centre: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    places: np.ndarray
    chances: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.centre) / self.spread, -6, 6)
        # Added up by statistic, not by a matrix product, whose last bits depend on a row's place in its batch.
        turns = np.tile(self.phases, (len(rows), 1))
        for one, direction in zip(scaled.T, self.directions):
            turns += one[:, None] * direction
        return np.hstack([np.cos(turns) * np.sqrt(2 / len(self.phases)), np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return (self.features(rows) * self.weights).sum(1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.places, self.chances)


def isotonic(places: np.ndarray, means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means by pooling adjacent violators: ``(place, mean)`` at the middle of every pool."""
    pools: list[list[float]] = []
    for p, m, w in zip(places, means, weights):
        pools.append([p * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p / w for p, _, w in pools]), np.array([m / w for _, m, w in pools])


def _vector(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum over all rows of ``part(batch)``, an array of ``size`` numbers: by partition, by adder, then here.

    What reaches the driver is ``ADDERS`` arrays, however many partitions there are.
    """

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for one in batch.column("sums"):
                total += np.frombuffer(one.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = rows.mapInArrow(here, "sums binary").repartition(ADDERS).mapInArrow(again, "sums binary")
    return sum((np.frombuffer(r.sums) for r in sums.collect()), np.zeros(size))


def read(text: Column) -> Column:
    """The statistics of a text column as an array; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def all_statistics(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return all_statistics(text)


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", row_col: str = "statistics", label_col: str = "quality", *, features: int = 256, width: float = 6.0, ridge: float = 1e-3, held: int = 4, seed: int = 12) -> QualityModel:
    """A model from all ``rows`` of statistics (:func:`read`) that have a label; texts do not move.

    A ``held``-th of them, by a hash of the id, is kept from the weights and calibrates the scores. Null ids
    and labels are not used; of an id with several labels the largest counts. Without a label of either kind
    every text gets the share of good ones (a half where there is none at all).
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg((F.max("mark") > 0).cast("double").alias("mark"))
    known = rows.select(F.col(id_col).alias("id"), F.col(row_col).alias("row")).join(marks, "id")
    known = stored(known.select((F.floor(remainder(F.col("id"), 7 * held) / 7) == 1).alias("aside"), "mark", "row"), "labelled")
    fitted = known.where("not aside").select("mark", "row")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        rows, mark = _vector(batch.column("row")), batch.column("mark").to_numpy()
        return np.concatenate([[len(rows), mark.sum()], rows.sum(0), (rows * rows).sum(0)])

    total = _added(fitted, 2 + 2 * STATISTICS, moments)
    count = max(1.0, total[0])
    centre = total[2 : 2 + STATISTICS] / count
    spread = np.sqrt(np.maximum(total[2 + STATISTICS :] / count - centre**2, 0))
    draw = np.random.default_rng(seed)
    model = QualityModel(
        centre,
        np.where(spread > 1e-9, spread, 1.0),
        draw.standard_normal((STATISTICS, features)) / width,
        draw.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.zeros(1),
        np.array([total[1] / total[0] if total[0] else 0.5]),
    )
    if not 0 < total[1] < total[0]:
        return model
    size = features + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, mark = model.features(_vector(batch.column("row"))), batch.column("mark").to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ mark])

    sums = _added(fitted, size * size + size, normal)
    penalty = ridge * count * np.eye(size) / features
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + penalty, sums[size * size :])

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        # Scores are near 0 to 1; what lies further out is at the ends.
        step = np.clip((model.raw(_vector(batch.column("row"))) + 0.5) / 2 * STEPS, 0, STEPS - 1).astype(np.int64)
        return np.concatenate([np.bincount(step, minlength=STEPS), np.bincount(step, batch.column("mark").to_numpy(), STEPS)])

    # With no label aside the rows of the fit must do.
    aside = _added(known.where("aside"), 2 * STEPS, counts)
    if not aside[:STEPS].sum():
        aside = _added(fitted, 2 * STEPS, counts)
    used = aside[:STEPS] > 0
    middle = (np.arange(STEPS) + 0.5) / STEPS * 2 - 0.5
    model.places, model.chances = isotonic(middle[used], aside[STEPS:][used] / aside[:STEPS][used], aside[:STEPS][used])
    return model


def scored(row: Column, model: QualityModel, spark, limit: float = 0.7) -> Column:
    """A struct ``(score, predicted, raw)`` per array of statistics; ``predicted`` is 1 from a score of ``limit``.

    Null and empty texts have the same statistics and score, repeated texts equal ones; very long texts are
    read whole, in pieces where characters are counted. An empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int, raw double")
    def score(rows: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        every = np.stack(rows.to_list()) if len(rows) else np.zeros((0, STATISTICS))
        found = fitted.scores(every)
        return pd.DataFrame({"score": found, "predicted": (found >= limit).astype(np.int32), "raw": fitted.raw(every)})

    return score(row)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """``docs``, all columns, without those below the limit."""
    name = free_name(docs, "quality")
    return docs.withColumn(name, scored(read(F.col(text_col)), model, docs.sparkSession, limit)).where(F.col(name)["predicted"] == 1).drop(name)
