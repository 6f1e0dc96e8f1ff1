"""Spelling variants of the words of a corpus by reduced-alphabet generation.

The letters of a word are hashed to a few symbols. If two words are one edit apart, their reduced words are at
most one edit apart, so every word makes the full one-edit neighbourhood of its reduced word and looks it up
among the reduced words of the vocabulary. What meets is verified on the original strings. A reduced word that
too many words share is looked up with every letter as its own symbol instead, where only true neighbours meet.

Reduced words and their neighbours are polynomial hashes, so a word of length L costs about ``2 * L * symbols``
numbers, never that many strings; words whose hashes meet by chance are told apart by the verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm.common import stored

#: Symbols of the reduced alphabet, and how many words may share a reduced word.
SYMBOLS, CROWD = 4, 512
#: Keys made at a time; bounds the memory of a task.
KEYS = 1 << 18
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points a word can hold.
POINTS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])


#: Symbol of every code point, by a fixed multiplicative hash; symbols are written as letters.
SYMBOL_OF = "".join(chr(ord("a") + (int(c) * 2654435761 >> 16) % SYMBOLS) for c in POINTS)
REDUCED = np.array([ord("a") + i for i in range(SYMBOLS)])


#: Odd multiplier of the polynomial hash.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(count: int) -> np.ndarray:
    out = np.full(count, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of one length each, and their code points as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        raw = "".join(words[i] for i in places).encode("latin-1")
        yield places, np.frombuffer(raw, np.uint8).reshape(len(places), size).astype(np.uint64)


def own_keys(words: list[str]) -> np.ndarray:
    """Hashes of the words themselves."""
    out = np.zeros(len(words), np.uint64)
    for places, points in _by_length(words):
        out[places] = (points * _powers(points.shape[1])[::-1]).sum(1, dtype=np.uint64)
    return out.astype(np.int64)


def neighbour_keys(words: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all strings of ``letters`` at most one edit from the words, each once: places and keys, in pieces."""
    letters = letters.astype(np.uint64)
    for places, points in _by_length(words):
        step = max(1, KEYS // (2 * len(letters) * (points.shape[1] + 1)))
        for at in range(0, len(places), step):
            keys = _around(points[at : at + step], letters)
            keys.sort(axis=1)
            first = np.ones(keys.shape, bool)
            first[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield np.repeat(places[at : at + step], first.sum(1)), keys[first].astype(np.int64)


def _around(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    count, size = points.shape
    power = _powers(size + 1)
    place = power[:size][::-1]
    terms = points * place
    # after[i]: the hash of the letters from place i on; front[i]: of those before it.
    after = np.zeros((count, size + 1), np.uint64)
    after[:, :size] = np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    front = after[:, :1] - after
    replaced = (after[:, :1] - terms)[:, :, None] + letters * place[:, None]
    # A rest that is longer or shorter by one moves what is in front of it by one power.
    inserted = (front * BASE + after)[:, :, None] + letters * power[::-1][:, None]
    shorter = _over_base(front)[:, :size] + after[:, 1:]
    return np.concatenate([after[:, :1], replaced.reshape(count, -1), inserted.reshape(count, -1), shorter], axis=1)


def _over_base(values: np.ndarray) -> np.ndarray:
    """Division by the odd multiplier, which has an inverse."""
    return values * np.uint64(pow(int(BASE), -1, 1 << 64))


def counted_words(docs: DataFrame, id_col: str, text_col: str, *, least_points: int, least_n: int, damaged: int) -> DataFrame:
    """``(word, n)``: the words of all texts with one code point missing where the hash says so."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", run.alias("run")).where(F.length("run") >= least_points)
    word = F.col("run")
    if damaged:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % damaged == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_points)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _own(words: DataFrame, name: str) -> DataFrame:
    """``(id, key)`` of every row of ``words`` (id, ``name``)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = own_keys(batch.column(name).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys)], names=["id", "key"])

    return words.select("id", name).mapInArrow(own, "id long, key long")


def _around_all(words: DataFrame, name: str, letters: np.ndarray) -> DataFrame:
    """``(id, key)`` of every neighbour of every row of ``words``."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("id").to_numpy()
            for places, keys in neighbour_keys(batch.column(name).to_pylist(), letters):
                yield pa.RecordBatch.from_arrays([pa.array(number[places]), pa.array(keys)], names=["id", "key"])

    return words.select("id", name).mapInArrow(around, "id long, key long")


def _meet(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that is merged. Tables are sized by their files or by the rows a Python function reads, not by the
    neighbours it makes of them, so either side could be broadcast where it is far too large for the driver."""
    return left.join(right.hint("merge"), on, how)


def near_words(words: DataFrame) -> DataFrame:
    """``(id, other)``: all ordered pairs of ``words`` (id, word) exactly one edit apart.

    Reduced words meet first, each once however many words share it; then the words of two that met.
    """
    placed = words.select("id", "word", F.translate("word", "".join(map(chr, POINTS)), SYMBOL_OF).alias("reduced"))
    reduced = placed.groupBy("reduced").agg(F.count("*").alias("words"))
    reduced = stored(reduced.select(F.monotonically_increasing_id().alias("id"), "reduced", (F.col("words") > CROWD).alias("crowded")), "reduced")
    placed = stored(_meet(placed, reduced.withColumnRenamed("id", "group"), "reduced").select("id", "word", "group", "crowded"), "placed")
    own = _meet(_own(reduced, "reduced"), reduced.select("id", "crowded"), "id").select(F.col("id").alias("other"), "crowded", "key")
    met = _meet(_around_all(reduced, "reduced", REDUCED), own, "key").where("id <= other or crowded")
    met = stored(met.select("id", "other", "crowded"), "met")
    few = _meet(met.where("not crowded and id <= other"), reduced.where("not crowded").select("id"), "id").select(F.col("id").alias("group"), "other")
    a = _meet(placed.select("group", F.col("id").alias("a"), F.col("word").alias("a_word")), few, "group")
    b = placed.select(F.col("group").alias("other"), F.col("id").alias("b"), F.col("word").alias("b_word"))
    pairs = _meet(a, b, "other").where("group < other or a < b").where(one_edit(F.col("a_word"), F.col("b_word"))).select("a", "b")

    # Words of a crowded reduced word, and all that look there, meet by whole letters.
    asking = _meet(placed, met.where("crowded").select(F.col("id").alias("group")).distinct(), "group", "left_semi")
    fine = _own(placed.where("crowded"), "word").select(F.col("id").alias("b"), "key")
    fine = _meet(_around_all(asking, "word", POINTS), fine, "key").where("id <> b").select(F.col("id").alias("a"), "b")
    fine = _meet(fine, placed.select(F.col("id").alias("a"), F.col("word").alias("a_word")), "a")
    fine = _meet(fine, placed.select(F.col("id").alias("b"), F.col("word").alias("b_word")), "b")
    fine = fine.where(one_edit(F.col("a_word"), F.col("b_word"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(pairs.unionByName(fine), "near")
    return both.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(both.select(F.col("b").alias("id"), F.col("a").alias("other")))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_points: int = 6, least_n: int = 5, ratio: int = 5, damaged: int = 0) -> DataFrame:
    """One row per word of the corpus: ``(word, form, root, n, n_near, form_n)``.

    A word is a maximal run of letters (A-Z lower-cased) of at least ``least_points`` code points that occurs
    at least ``least_n`` times. ``n_near`` counts the words one edit apart; ``form`` is the most frequent of
    them (ties: the smallest) if it occurs ``ratio`` times as often as the word, ``root`` the last word reached
    over forms. With ``damaged`` a run loses a code point where it divides the crc32 of ``id:run``, as the
    contract of the query asks; a null id counts as empty there. Null and empty texts have no words, repeated
    rows count as often as they occur, very long runs are words like any other. Other columns are not read; an
    empty table gives no rows.
    """
    words = counted_words(docs, id_col, text_col, least_points=least_points, least_n=least_n, damaged=damaged)
    # Written with their numbers, so these are the same in every later pass.
    words = stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = near_words(words.select("id", "word"))
    other = words.select(F.col("id").alias("other"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = _meet(pairs, other, "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "other")).alias("best"))
    rows = _meet(words, best, "id", "left")
    large = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    rows = rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"), F.when(large, F.col("best.other")).alias("next"))
    rows = stored(rows, "forms")
    ends = roots(rows.select("id", "next"))
    named = words.select(F.col("id").alias("last"), F.col("word").alias("root"))
    return _meet(_meet(rows, ends, "id"), named, "last").select("word", "form", "root", "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """``(id, last)``: where the chain of ``next`` from every id ends; each round doubles the reach.

    A form occurs several times as often as its word, so chains are short and have no cycle.
    """
    done = links.where("next is null").select("id", F.col("id").alias("last"))
    reach = stored(links.where("next is not null").select("id", F.col("next").alias("last")), "chains")
    while True:
        further = reach.select(F.col("id").alias("last"), F.col("last").alias("beyond"))
        after = stored(_meet(reach, further, "last", "left").select("id", F.coalesce("beyond", "last").alias("last"), F.col("beyond").isNotNull().alias("moved")), "chains")
        reach = after.select("id", "last")
        if after.where("moved").isEmpty():
            return done.unionByName(reach)
