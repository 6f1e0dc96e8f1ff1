"""Document fingerprints from closed syncmers over words, in DataFrame functions only.

Of every ``K`` neighbouring words the pairs of neighbours are hashed; the words are an anchor when the
smallest of those hashes is the first or the last one. Whether they are does not depend on anything outside
them, so a passage keeps its anchors wherever it stands. A fingerprint is all anchors of the text, each a hash
and the number of its first word. Two fingerprints are compared by position: the shifts between places of
shared hashes are found, and anchors count as equal where hash and shifted place agree, so passages match as
runs of anchors and single equal hashes elsewhere do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm.common import free_name

#: Words in an anchor, and how many pairs of neighbours they have.
K = 5
PAIRS = K - 1
#: Documents that follow each other by id and are ordered together.
TOGETHER = 256

LOW = 0xFFFFFFFF
#: Bits of a place; a fingerprint holds ``hash << PLACE | place``. Places of longer texts start again from 0.
PLACE = 24
#: Shared anchors that are asked for their shift, and shifts that are matched over the whole texts.
ASKED, SHIFTS = 32, 4


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the fingerprint of column ``text``, an array of packed anchors in order of place.

    A null text counts as empty; a text without words has no anchors. One that is shorter than an anchor,
    or has none, gets a single anchor made of all its words. Very long texts are read whole. Equal texts have
    equal fingerprints; other columns stay, a former ``out`` is replaced; an empty table gives no rows.
    """
    names: list[str] = []
    step = df
    for stem in ("words", "hashes", "pairs"):
        names.append(free_name(step, f"{out}_{stem}"))
        step = step.withColumn(names[-1], F.lit(None))
    words, hashes, pairs = names
    at = lambda name, i: F.get(F.col(name), i)

    def packed(hashed: Column, i: Column) -> Column:
        return F.shiftleft(hashed.bitwiseAND(F.lit(LOW)), PLACE).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << PLACE) - 1)))

    def anchor(x: Column, i: Column) -> Column:
        second, third, last = (at(pairs, i + n) for n in range(1, PAIRS))
        edge = (x <= F.least(second, third, last)) | (last <= F.least(x, second, third))
        return F.when(edge, packed(F.xxhash64(x, third, at(hashes, i + PAIRS)), i))

    split = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    step = step.withColumn(words, split).withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn(pairs, F.zip_with(hashes, F.slice(F.col(hashes), F.lit(2), F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    # The last pair has no second word; the places that start a whole anchor come before the last K - 1 words.
    starts = F.slice(F.col(pairs), F.lit(1), F.greatest(F.size(pairs) - PAIRS, F.lit(0)))
    whole = F.when(F.size(words) > 0, F.array(packed(F.xxhash64(hashes), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn(out, F.array_compact(F.transform(starts, anchor)))
    return step.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(words, hashes, pairs)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with ``out``: anchors that two fingerprints share at a consistent shift, as a share of all.

    Up to ``ASKED`` of the shared hashes, evenly spread over the first text, tell by how many words their first
    places differ; the ``SHIFTS`` most frequent differences are then matched over all anchors. 1 for equal
    fingerprints and for two without anchors, 0 where nothing matches.
    """
    names: list[str] = []
    step = df
    for stem in ("hashes_a", "hashes_b", "shared", "shifts"):
        names.append(free_name(step, f"{out}_{stem}"))
        step = step.withColumn(names[-1], F.lit(None))
    x, y, shared, shifts = names
    only = lambda c: F.transform(c, lambda v: F.shiftright(v, PLACE))
    place = lambda c, of, h: F.element_at(F.col(c), F.array_position(F.col(of), h).cast("int")).bitwiseAND(F.lit((1 << PLACE) - 1))
    step = step.withColumn(x, only(a)).withColumn(y, only(b)).withColumn(shared, F.array_intersect(x, y))
    count = F.least(F.size(shared), F.lit(ASKED))
    spread = F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(F.col(shared), (1 + F.floor((i - 1) * F.size(shared) / count)).cast("int")))
    asked = F.transform(spread, lambda h: place(b, y, h) - place(a, x, h))
    step = step.withColumn(shifts, F.when(F.size(shared) > 0, asked).otherwise(F.array().cast("array<bigint>")))
    votes = F.array_sort(F.transform(F.array_distinct(shifts), lambda d: F.struct((-F.size(F.filter(shifts, lambda e: e == d))).alias("n"), d.alias("d"))))
    best = F.transform(F.slice(votes, 1, SHIFTS), lambda v: v["d"])
    # Anchors of b moved to where they would stand in a.
    met = F.size(F.array_distinct(F.flatten(F.transform(best, lambda d: F.array_intersect(F.col(a), F.transform(F.col(b), lambda v: v - d))))))
    every = F.size(a) + F.size(b) - met
    return step.withColumn(out, F.when(every == 0, F.lit(1.0)).otherwise(met / every)).drop(*names)


def written(fingerprint: Column) -> Column:
    """A fingerprint as text: fourteen hexadecimal digits an anchor, eight of the hash and six of the place."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 14, "0")), ""))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, next_text)``: every document with the one that follows by id, the first after the last.

    Documents are ordered in chunks of neighbouring ids; the last of a chunk is followed by the first of the
    next one that has any. Rows with equal ids follow each other by text; rows without an id come first. A
    null text counts as empty. One aggregate runs when the plan is built, for the range of the ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("n")).first()
    low, width = span.low or 0, max(1, ((span.high or 0) - (span.low or 0) + 1) * TOGETHER // max(1, span.n))
    chunk = F.coalesce(F.floor((F.col("id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1))
    # Shuffled once; both the order inside chunks and the heads of the chunks read this exchange.
    dealt = rows.withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions("chunk", "id", "text")
    inside = Window.partitionBy("chunk").orderBy("id", "text")
    heads = dealt.withColumn("_n", F.row_number().over(inside)).where("_n = 1").select("chunk", F.col("text").alias("head"))
    # One row per chunk, so this order is over a small part of the rows.
    line = Window.orderBy("chunk")
    before = heads.select("chunk").withColumn("before", F.lag("chunk").over(line)).withColumn("last", F.max("chunk").over(Window.partitionBy(F.lit(0))))
    linked = heads.join(before.select("chunk", F.coalesce("before", "last").alias("before")), "chunk").select(F.col("before").alias("chunk"), "head")
    follows = dealt.withColumn("next", F.lead("text").over(inside))
    return follows.join(linked, "chunk", "left").select("id", "text", F.coalesce("next", "head").alias("next_text"))


def edited(docs: DataFrame, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, next_text, n_chars, edited)``: the last ``1/share`` of a text replaced by the next one's start."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / share).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut)
    return rows.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), cut)))
