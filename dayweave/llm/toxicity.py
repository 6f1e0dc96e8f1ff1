"""A convolutional text classifier for toxicity, trained by tasks in numpy.

Words are hashed twice into a table of embeddings (the sum of both rows, so that two words share a vector
only if both hashes meet). Filters over one, two and three neighbouring words run over the whole text, the
largest answer of each filter is kept, and a logistic layer turns those into a chance. The decision
threshold is calibrated per language on labelled documents the network did not see; the language is guessed
from the text's own function words, so nothing but the text enters a score.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm.common import free_name, remainder

WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)
#: Words coded at a time; bounds the memory of a task.
CHUNK = 1 << 16
#: Words remembered with their hashes before the memory is emptied.
REMEMBERED = 1 << 17
#: Labelled documents one task trains on, and rounds at least where there are several tasks.
SHARD, LEAST_ROUNDS = 5000, 4
#: Steps to which changes of a value are rounded before they are added up, and chances before they are counted.
UNIT, BINS = 1 << 22, 10_000
#: Places of the bitmap that tells which ids can have a label.
PLACES = 1 << 24

# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu den von mit auf für im sich des dem auch als",
    "en": "the of and to in is that it for was on are as with be by this at from or",
    "es": "el la los las que y en un una por con no para su se del al lo como es",
    "fr": "le la les et est un une des du que qui dans pour pas sur au avec ce il ne",
}
GROUPS = ["", *sorted(FUNCTION_WORDS)]


@dataclass
class ToxicityModel:
    rows: int
    table: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)


def _hashes(word: str, rows: int) -> tuple[int, int]:
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) % rows, rows + zlib.crc32(raw, 0x9E3779B9) % rows


class _Words(dict):
    """Word to its two rows and its language votes, worked out at first sight."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows = rows
        self.votes: dict[str, int] = {}
        for i, group in enumerate(GROUPS):
            for word in FUNCTION_WORDS.get(group, "").split():
                self.votes[word] = self.votes.get(word, 0) | 1 << i

    def __missing__(self, word: str) -> int:
        a, b = _hashes(word, self.rows)
        code = (a << 40) | (b << 8) | self.votes.get(word, 0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code
        return code


def codes(text: str | None, words: _Words) -> np.ndarray:
    """One number per word: both rows of the embedding table and the language votes."""
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(words.__getitem__, found), np.int64, len(found))


def language_group(code: np.ndarray) -> str:
    """The language most of a text's function words belong to; empty for a tie or none."""
    votes = [int(((code >> i) & 1).sum()) for i in range(len(GROUPS))]
    most = max(votes)
    return GROUPS[votes.index(most)] if most and votes.count(most) == 1 else ""


def _vectors(model: ToxicityModel, code: np.ndarray) -> np.ndarray:
    return model.table.take(code >> 40, axis=0) + model.table.take((code >> 8) & 0xFFFFFFFF, axis=0)


def _answers(model: ToxicityModel, vectors: np.ndarray, width: int) -> np.ndarray:
    """Answers of all filters of one width at every place; ``vectors`` ends with padding."""
    size = len(vectors) - len(WIDTHS) + 1
    total = vectors[:size] @ model.filters[width][0]
    for j in range(1, width):
        total += vectors[j : j + size] @ model.filters[width][j]
    return total


def _pooled(model: ToxicityModel, code: np.ndarray) -> np.ndarray:
    """Largest answer of every filter over one text, in chunks that overlap by the filter width."""
    best = []
    for at in range(0, max(1, len(code)), CHUNK):
        part = code[at : at + CHUNK + len(WIDTHS) - 1]
        pad = len(WIDTHS) - 1 if at + CHUNK >= len(code) else 0
        vectors = np.concatenate([_vectors(model, part), np.zeros((max(pad, 1 + len(WIDTHS) - 1 - len(part)), model.table.shape[1]), np.float32)])
        best.append(np.concatenate([_answers(model, vectors, w).max(0) + model.biases[w] for w in WIDTHS]))
    return np.maximum(np.max(best, 0), 0)


def raw_scores(model: ToxicityModel, texts: list[np.ndarray]) -> np.ndarray:
    """Chance of toxicity per coded text. Texts are joined into chunks with padding between them."""
    features = np.zeros((len(texts), len(model.out)), np.float32)
    gap = len(WIDTHS) - 1
    held, first, size = [], 0, 0
    for n, code in enumerate(texts):
        if len(code) > CHUNK:
            features[n] = _pooled(model, code)
            code = code[:0]
        held.append(code)
        size += len(code) + gap + 1
        if size >= CHUNK or n == len(texts) - 1:
            lengths = np.array([len(c) for c in held])
            spans = np.maximum(lengths, 1) + gap
            starts = np.cumsum(spans) - spans
            place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            vectors = np.zeros((spans.sum() + gap, model.table.shape[1]), np.float32)
            vectors[place] = _vectors(model, np.concatenate(held)) if lengths.sum() else 0
            outside = np.ones(spans.sum(), bool)
            outside[place] = False
            outside[starts] = False
            some = []
            for w in WIDTHS:
                answers = _answers(model, vectors, w)
                answers[outside] = -np.inf
                some.append(np.maximum.reduceat(answers, starts, axis=0) + model.biases[w])
            found = np.maximum(np.concatenate(some, 1), 0)
            short = np.array([len(texts[first + i]) <= CHUNK for i in range(len(held))])
            features[first : n + 1][short] = found[short]
            held, first, size = [], n + 1, 0
    # A sum per row, not a product: equal texts get equal scores wherever they lie in a batch.
    return 1 / (1 + np.exp(-((features.astype(np.float64) * model.out).sum(1) + model.offset)))


@dataclass
class _Training:
    """A network being trained, with the sums of squared gradients its steps are divided by."""

    model: ToxicityModel
    dense: np.ndarray
    rows: np.ndarray


def _flat(model: ToxicityModel) -> np.ndarray:
    """All values of the network but the embedding table."""
    parts = [*[model.filters[w] for w in WIDTHS], *[model.biases[w] for w in WIDTHS], model.out, [model.offset]]
    return np.concatenate([np.ravel(p) for p in parts]).astype(np.float64)


def _put(model: ToxicityModel, flat: np.ndarray) -> None:
    """The inverse of :func:`_flat`."""
    at = 0
    for held in [*[model.filters[w] for w in WIDTHS], *[model.biases[w] for w in WIDTHS], model.out]:
        held[...] = flat[at : at + held.size].reshape(held.shape)
        at += held.size
    model.offset = float(flat[at])


def _untrained(rows: int, dim: int, filters: int, seed: int) -> _Training:
    draw = np.random.default_rng(seed)
    model = ToxicityModel(
        rows,
        (draw.standard_normal((2 * rows, dim)) * 0.02).astype(np.float32),
        {w: (draw.standard_normal((w, dim, filters)) * 0.4).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(filters, np.float32) for w in WIDTHS},
        (np.abs(draw.standard_normal(len(WIDTHS) * filters)) * 0.1).astype(np.float64),
        0.0,
    )
    return _Training(model, np.full(len(_flat(model)), 1e-3), np.full(2 * rows, 1e-3, np.float32))


def train(state: _Training, texts: list[np.ndarray], labels: np.ndarray, *, weight: float, epochs: int, batch: int, rate: float, seed: Sequence[int]) -> None:
    """``epochs`` passes over coded texts, in place; texts of label 1 weigh ``weight``."""
    draw, model = np.random.default_rng(seed), state.model
    dim, filters = model.table.shape[1], len(model.out) // len(WIDTHS)
    weights = np.where(labels == 1, weight, 1.0)
    pad = np.zeros((len(WIDTHS), dim), np.float32)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            pulled = ToxicityModel(0, pad, {w: np.zeros(v.shape) for w, v in model.filters.items()}, {w: np.zeros(filters) for w in WIDTHS}, np.zeros(len(model.out)), 0.0)
            touched, pulls = [], []
            some = order[at : at + batch]
            for n in some:
                code = texts[n]
                vectors = np.concatenate([_vectors(model, code), pad])
                ids = np.concatenate([np.stack([code >> 40, (code >> 8) & 0xFFFFFFFF], 1), np.full((len(pad), 2), -1)])
                raw, spots = [], []
                for w in WIDTHS:
                    answers = _answers(model, vectors, w)[: max(1, len(code))]
                    spots.append(answers.argmax(0))
                    raw.append(answers[spots[-1], np.arange(answers.shape[1])] + model.biases[w])
                flat = np.concatenate(raw)
                kept = np.maximum(flat, 0)
                pull = weights[n] * (1 / (1 + np.exp(-(kept @ model.out + model.offset))) - labels[n]) / len(some)
                pulled.offset += pull
                pulled.out += pull * kept
                back = pull * model.out * (flat > 0)
                for i, w in enumerate(WIDTHS):
                    g = back[i * filters : (i + 1) * filters]
                    pulled.biases[w] += g
                    for j in range(w):
                        pulled.filters[w][j] += vectors[spots[i] + j].T * g
                        touched.append(ids[spots[i] + j])
                        pulls.append(g[:, None] * model.filters[w][j].T)
            values, step = _flat(model), _flat(pulled)
            step[:-1] += 1e-5 * values[:-1]
            state.dense += step * step
            _put(model, values - rate * step / np.sqrt(state.dense))
            ids, pull = np.concatenate(touched), np.concatenate(pulls).astype(np.float32)
            for side in range(2):
                real = (ids[:, side] >= 0) & (np.abs(pull).sum(1) > 0)
                spot, inverse = np.unique(ids[real, side], return_inverse=True)
                total = np.zeros((len(spot), dim), np.float32)
                np.add.at(total, inverse, pull[real])
                state.rows[spot] += (total * total).mean(1)
                model.table[spot] -= rate * total / np.sqrt(state.rows[spot])[:, None]


def _changes(before: _Training, after: _Training) -> pd.DataFrame:
    """What training changed, as whole multiples of ``1 / UNIT``: changed rows of the table with their squares, then the rest in rows as wide."""
    dim = after.model.table.shape[1]
    moved = np.flatnonzero(after.rows != before.rows)
    table = np.column_stack([after.model.table[moved].astype(np.float64) - before.model.table[moved], after.rows[moved].astype(np.float64) - before.rows[moved]])
    rest = np.concatenate([_flat(after.model) - _flat(before.model), after.dense - before.dense])
    rest = np.pad(rest, (0, -len(rest) % (dim + 1))).reshape(-1, dim + 1)
    out = pd.DataFrame(np.rint(np.concatenate([table, rest]) * UNIT).astype(np.int64), columns=[f"v{i}" for i in range(dim + 1)])
    out.insert(0, "slot", np.concatenate([moved, len(after.rows) + np.arange(len(rest))]))
    return out


def _advance(state: _Training, means: pd.DataFrame) -> None:
    """Add the mean changes, one row per slot, to ``state``."""
    means = means.sort_values("slot")
    slot, values = means["slot"].to_numpy(), means.drop(columns="slot").to_numpy(np.float64)
    in_table = slot < len(state.rows)
    state.model.table[slot[in_table]] += values[in_table, :-1].astype(np.float32)
    state.rows[slot[in_table]] += values[in_table, -1].astype(np.float32)
    rest, size = values[~in_table].ravel(), len(state.dense)
    _put(state.model, _flat(state.model) + rest[:size])
    state.dense += rest[size : 2 * size]


def fit(dealt: DataFrame, shards: int, count: int, positive: int, *, rows: int = 1 << 17, dim: int = 8, filters: int = 16, epochs: int = 12, batch: int = 32, rate: float = 0.1, seed: int = 5) -> ToxicityModel:
    """Train the network on all ``dealt(id, tie, mark, code)`` rows; classes weigh the same whatever their share.

    A partition, dealt by id, is a shard of about ``SHARD`` rows. In every round each trains a copy of the network, and
    the mean of their changes is added to it: over all shards, for a row of the table over those that changed it. What
    reaches the driver are these means, as large as the network. A single shard is passed ``epochs`` times; more
    shards in as many rounds as give as many steps, at least ``LEAST_ROUNDS``.
    """
    state = _untrained(rows, dim, filters, seed)
    if not 0 < positive < count:
        state.model.out[:] = 0
        state.model.offset = 4.0 if positive else -4.0
        return state.model
    weight = min(4.0, (count - positive) / positive)
    rounds, passes = (1, epochs) if shards == 1 else (max(LEAST_ROUNDS, -(-epochs // shards)), 1)
    columns = [f"v{i}" for i in range(dim + 1)]

    def in_round(shared, turn: int):
        def changes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [f for f in frames if len(f)]
            if held:
                some = pd.concat(held).sort_values(["id", "tie"], kind="stable")
                after = copy.deepcopy(shared.value)
                train(after, [_read(c) for c in some["code"]], some["mark"].to_numpy(np.int64), weight=weight, epochs=passes, batch=batch, rate=rate, seed=(seed, turn, TaskContext.get().partitionId()))
                yield _changes(shared.value, after)

        return changes

    for turn in range(rounds):
        shared = dealt.sparkSession.sparkContext.broadcast(state)
        found = dealt.mapInPandas(in_round(shared, turn), "slot long, " + ", ".join(f"{c} long" for c in columns))
        # Sums of whole numbers do not depend on the order of the tasks.
        means = found.groupBy("slot").agg(*[(F.sum(c) / (F.count("*") * F.lit(float(UNIT)))).cast("float").alias(c) for c in columns])
        # As columns: rows of Python objects would take many times the network's memory.
        _advance(state, means.toArrow().to_pandas())
        shared.destroy()
    return state.model


def calibrate(chances: np.ndarray, labels: np.ndarray, groups: list[str], fewest: int = 20, counts: np.ndarray | None = None) -> dict[str, float]:
    """The threshold with the best F1 per language; those with few labels of a kind use the common one.

    With ``counts`` every entry stands for as many documents.
    """
    counts = np.ones(len(labels), np.int64) if counts is None else counts

    def best(p: np.ndarray, y: np.ndarray, n: np.ndarray, other: float) -> float:
        if min((n * y).sum(), (n * (1 - y)).sum()) < fewest:
            return other
        order = np.argsort(p, kind="stable")
        p, y, n = p[order], y[order], n[order]
        upto = np.cumsum(n)
        tries = np.unique(p[np.searchsorted(upto, np.linspace(0, upto[-1] - 1, 201), "right")])
        mids = np.concatenate([(tries[1:] + tries[:-1]) / 2, [0.5]])
        f1 = [2 * n[(p >= t) & (y == 1)].sum() / max(1, n[p >= t].sum() + (n * y).sum()) for t in mids]
        # Among equally good thresholds the middle one is the safest.
        good = mids[np.array(f1) >= max(f1) - 1e-12]
        return float(np.clip(np.sort(good)[len(good) // 2], 0.05, 0.95))

    common = best(chances, labels, counts, 0.5)
    names = np.array(groups, object)
    return {"": common} | {g: best(chances[names == g], labels[names == g], counts[names == g], common) for g in GROUPS[1:]}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, held: int = 5, **options) -> ToxicityModel:
    """A model from all documents that have a label.

    A ``held``-th of them, by a hash of the id, calibrates the thresholds, the others train the network. Texts are
    coded, dealt, trained on and scored in tasks; the driver gets means of changes (:func:`fit`) and counts of
    chances, both of bounded size. Null ids, texts and labels are not used; of an id with several labels the
    largest counts.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg(F.max("mark").alias("mark"))
    spark, size = docs.sparkSession, options.get("rows", 1 << 17)
    known, place = marks.count(), F.pmod(F.xxhash64("id"), F.lit(PLACES))
    shards = max(1, -(-known // SHARD))
    taken = spark.sparkContext.broadcast(_bitmap(marks.select(place.alias("place"))))

    def coded(places: pd.Series, texts: pd.Series) -> pd.Series:
        at, words = places.to_numpy(), _known(size)
        there = (taken.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pd.Series([zlib.compress(codes(t, words).tobytes(), 1) if x else None for t, x in zip(texts, there)], dtype=object)

    # One function, so a task has one Python worker; not deterministic for the optimiser, or the filter would run it again.
    code = F.pandas_udf(coded, "binary").asNondeterministic()(place, "text")
    # Most texts without a label leave before texts are dealt, once, for the join that decides and for all rounds.
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    some = some.select("id", F.xxhash64("text").alias("tie"), code.alias("code")).where("code is not null").repartition(shards, "id")
    apart = F.floor(remainder(F.col("id"), 7 * held) / 7) == 1
    dealt = some.join(marks.repartition(shards, "id"), "id").select("id", "tie", (F.col("mark") > 0).cast("int").alias("mark"), apart.alias("apart"), "code")
    # The join may deal rows out finer than asked.
    dealt = dealt.coalesce(shards).persist()
    seen = dealt.where("not apart").agg(F.count("*").alias("n"), F.coalesce(F.sum("mark"), F.lit(0)).alias("positive")).first()
    model = fit(dealt.where("not apart"), shards, seen.n, seen.positive, **options)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("chance double, language string")
    def answered(code: pd.Series) -> pd.DataFrame:
        texts = [_read(c) for c in code]
        return pd.DataFrame({"chance": raw_scores(shared.value, texts), "language": [language_group(c) for c in texts]})

    aside = dealt.where("apart").select("mark", answered("code").alias("a")).groupBy("a.language", "mark", F.floor(F.col("a.chance") * BINS).alias("bin")).agg(F.count("*").alias("n")).toArrow().to_pandas()
    dealt.unpersist()
    aside = aside.sort_values(["bin", "language", "mark"])
    middles = (aside["bin"].to_numpy(np.float64) + 0.5) / BINS
    model.thresholds = calibrate(middles, aside["mark"].to_numpy(np.int64), list(aside["language"]), counts=aside["n"].to_numpy(np.int64))
    return model


def _bitmap(places: DataFrame) -> np.ndarray:
    """The places as bits of words of 64; one row per word that has any reaches the driver."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_pandas()
    bits = np.zeros(PLACES // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _read(code: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(code), np.int64)


def scored(text: Column, model: ToxicityModel, spark) -> Column:
    """A struct ``(score, predicted, language, chance, threshold)`` per text.

    ``chance`` is the network's answer; ``score`` is the chance with the threshold of the text's language
    moved to 0.5, so ``predicted`` is 1 from a score of 0.5. A null text counts as empty and gets the score
    of a text without words.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int, language string, chance double, threshold double")
    def score(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        words = _known(fitted.rows)
        coded = [codes(t, words) for t in texts]
        groups = [language_group(c) for c in coded]
        chance = raw_scores(fitted, coded)
        limit = np.array([fitted.thresholds.get(g, fitted.thresholds.get("", 0.5)) for g in groups], np.float64)
        moved = np.where(chance < limit, 0.5 * chance / limit, 0.5 + 0.5 * (chance - limit) / (1 - limit))
        return pd.DataFrame({"score": moved, "predicted": (moved >= 0.5).astype(np.int32), "language": groups, "chance": chance, "threshold": limit})

    return score(text)


_KNOWN: dict[int, _Words] = {}


def _known(rows: int) -> _Words:
    """The words a Python worker has met, kept from batch to batch."""
    return _KNOWN.setdefault(rows, _Words(rows))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without those predicted toxic."""
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, scored(F.col(text_col), model, docs.sparkSession)).where(F.col(name)["predicted"] == 0).drop(name)
