"""Language identification by prediction by partial matching over bytes.

Every language has a context tree: how often each byte followed each context of up to ``order`` bytes. A
byte that was seen after the longest known context is coded there; otherwise an escape is paid and the
byte is coded in the next shorter context, down to equal chances. (Escape probability: distinct bytes over
distinct bytes plus count; bytes the longer context knows are excluded below it.) The language whose
frozen tree codes a text in the fewest bits is predicted.

With frozen counts the coder of a language is a finite automaton: its states are its own contexts, a table
gives the next state and another the code length. Texts are cut into short segments that are coded side by
side; the few bytes before a segment restore its state exactly, so nothing is lost at the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm.common import free_name, hash_share

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SEGMENT = 256
#: Bytes that are counted or coded at a time; bounds the memory of a task.
PIECE = 1 << 20


@dataclass
class LanguageModel:
    """Names of the languages, and of each its automaton and code lengths in bits."""

    names: list[str]
    order: int
    step: list[np.ndarray]  # (state * 256 + byte) -> state
    bits: list[np.ndarray]  # (state * 256 + byte) -> code length


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and numbers of their texts, in pieces of bounded size; a cut text counts as two."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), PIECE):
            held.append(raw[at : at + PIECE])
            size += len(held[-1])
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), np.repeat(np.arange(len(held)), [len(x) for x in held])
                held, size = [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.repeat(np.arange(len(held)), [len(x) for x in held])


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for raw, owner in _pieces([t for t, k in zip(texts, langs) if k == lang]):
                code = raw.astype(np.int64)
                for k in range(order + 1):
                    if k:
                        code = (code[:-1] << 8) | raw[k:]
                    inside = owner[: len(raw) - k] == owner[k:]
                    found, n = np.unique(code[inside], return_counts=True)
                    size = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), pa.array(np.full(size, k, np.int32)), pa.array(found), pa.array(n.astype(np.int64))],
                        names=["lang", "k", "code", "n"],
                    )


def learn(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", *, order: int = 4, docs_per_language: int = 1500, contexts: int = 1024
) -> LanguageModel:
    """Context trees of all languages in ``docs``.

    The fit reads about ``docs_per_language`` whole documents of each language (all where there are fewer),
    chosen by a hash of ``key_col``; the ``contexts`` most frequent contexts of each language become its
    states. Rows without text, language or key are not used. Only the chosen contexts with their counts reach
    the driver, at most ``contexts * 256`` a language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("key")).where("lang is not null and text is not null and key is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], order, [], [])
    shares = F.create_map(*[F.lit(x) for name in names for x in (name, docs_per_language / sizes[name])])
    some = rows.where(hash_share(F.col("key"), shares[F.col("lang")])).select("lang", "text")
    counts = some.mapInArrow(lambda batches: _counts(batches, order), "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))
    counts = counts.select("lang", "k", F.when(F.col("k") > 0, F.shiftright("code", 8)).otherwise(0).alias("context"), F.col("code").bitwiseAND(F.lit(255)).alias("byte"), "n").persist()
    totals = counts.where("k > 0").groupBy("lang", "k", "context").agg(F.sum("n").alias("total")).where("total > 1")
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "k", "context"))).where(F.col("rank") <= contexts)
    kept = counts.join(ranked.select("lang", "k", "context"), ["lang", "k", "context"], "left_semi").unionByName(counts.where("k = 0"))
    used = {lang: part for lang, part in kept.toPandas().groupby("lang")}
    counts.unpersist()
    tables = [_automaton(order, used[name]) if name in used else (np.zeros(256, np.int32), np.full(256, 8, np.float32)) for name in names]
    return LanguageModel(names, order, [step for step, _ in tables], [bits for _, bits in tables])


def _automaton(order: int, used: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Next states and code lengths of one language from the counts ``(k, context, byte, n)``."""
    number = {(0, 0): 0}
    for k, context in sorted(set(zip(used["k"].tolist(), used["context"].tolist())) - {(0, 0)}):
        # Ties at the limit may leave a context without its own ends; such a context is left out.
        if (k - 1, context >> 8) in number and (k - 1, context & ((1 << 8 * (k - 1)) - 1)) in number:
            number[k, context] = len(number)
    size = len(number)
    seen = np.zeros((size, 256), np.float64)
    at = np.array([number.get(x, -1) for x in zip(used["k"].tolist(), used["context"].tolist())], np.int64)
    known = at >= 0
    seen[at[known], used["byte"].to_numpy()[known]] = used["n"].to_numpy()[known]
    chance = np.empty((size, 256))
    step = np.zeros((size, 256), np.int32)
    for (k, context), state in number.items():  # in order of length: the shorter context is ready
        shorter = number[k - 1, context & ((1 << 8 * (k - 1)) - 1)] if k else None
        below = chance[shorter] if k else np.full(256, 1 / 256)
        n = seen[state]
        total, distinct = n.sum(), (n > 0).sum()
        rest = np.where(n > 0, 0.0, below)
        left = rest.sum()
        # With nothing left to escape to, the counts share everything; with nothing seen, all escapes.
        escape = (distinct / (total + distinct) if total > 0 else 1.0) if left > 0 else 0.0
        chance[state] = np.where(n > 0, (1 - escape) * n / max(total, 1), escape * rest / (left if left > 0 else 1))
        for byte in range(256):
            longer = number.get((k + 1, (context << 8) | byte)) if k < order else None
            step[state, byte] = longer if longer is not None else (step[shorter, byte] if k else 0)
    return step.reshape(-1), -np.log2(chance).reshape(-1).astype(np.float32)


def code_lengths(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Bits each language's frozen tree needs for each text, one row per text."""
    total = np.zeros((len(texts), len(model.names)))
    held, size, first = [], 0, 0
    for n, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw)
        if size >= PIECE or n == len(texts) - 1:
            total[first : n + 1] = _code(model, held)
            held, size, first = [], 0, n + 1
    return total


def _code(model: LanguageModel, raws: list[bytes]) -> np.ndarray:
    lengths = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    total = np.zeros((len(raws), len(model.names)))
    parts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(raws)), parts)
    if not len(owner):
        return total
    inner = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
    start = np.repeat(np.cumsum(lengths) - lengths, parts) + inner
    size = np.minimum(SEGMENT, lengths[owner] - inner)
    # Longest first: the segments still running at a step are the first ones.
    rank = np.argsort(-size, kind="stable")
    for at in range(0, len(rank), 1 << 15):
        some = rank[at : at + (1 << 15)]
        own, begin, count = owner[some], start[some], size[some]
        later = np.flatnonzero(inner[some] > 0)
        running = np.searchsorted(-count, -np.arange(count[0]), side="left")
        for lang, (step, bits) in enumerate(zip(model.step, model.bits)):
            state = np.zeros(len(some), np.int32)
            for back in range(model.order, 0, -1):
                state[later] = step[state[later] * 256 + data[begin[later] - back]]
            cost = np.zeros(len(some))
            for t, n in enumerate(running.tolist()):
                spot = state[:n] * 256 + data[begin[:n] + t]
                cost[:n] += bits.take(spot)
                state[:n] = step.take(spot)
            total[:, lang] += np.bincount(own, cost, len(raws))
    return total


def predicted(text: Column, model: LanguageModel, spark) -> Column:
    """A struct ``(lang, score, bits)`` per text.

    ``lang`` is the language with the shortest code (the first by name among equals), ``score`` its share
    when code lengths are turned into chances, ``bits`` the code length. A text that is null or has no
    letter, and every text where no language was learned, is ``und`` with score 0 and null bits. Equal texts
    have equal answers, very long ones are coded whole, an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, bits double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        usable = np.array([bool(fitted.names) and t is not None and LETTER.search(t) is not None for t in texts], bool)
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        bits = np.full(len(texts), None, object)
        if usable.any():
            length = code_lengths(fitted, texts[usable].tolist())
            best = length.argmin(1)
            low = length.min(1)
            lang[usable] = np.array(fitted.names, object)[best]
            score[usable] = 1 / np.exp2(low[:, None] - length).sum(1)
            bits[usable] = low
        return pd.DataFrame({"lang": lang, "score": score, "bits": bits})

    return identify(text)


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """``docs``, all columns, without those whose language is ``und`` or scored below ``min_score``."""
    name = free_name(docs, "language")
    found = docs.withColumn(name, predicted(F.col(text_col), model, docs.sparkSession))
    return found.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= min_score)).drop(name)
