"""Greedy keep-or-drop scans by next-kept pointers, without a whole key in one task.

Some scans carry nothing but the row they kept last: the next one is kept when it is far enough from it in
time, or differs enough from it. Every row then has a pointer, the first later row that would be kept if this
one is, and what the scan keeps is the path of pointers from the first row of the key.

Keys are cut into time chunks. Inside a chunk pointers are followed at once, which leaves for every row the
last one of its path in the chunk (its exit). Few rows are exits; each is matched with the chunk that stops
it, whatever its distance, so pointers between exits are known without walking the chunks one by one. The
same step then runs on the exits of 64 chunks, of 64 times 64, and so on: the number of rounds is the
logarithm of the number of chunks for every kind of state. On the way back each block is entered where the
path enters it, and each chunk gives out its kept rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.plans.ordered import CHUNK, CHUNK_SECONDS, fitting_width, with_chunk
from dayweave.session import ensure_checkpoint_dir

#: Blocks that one block of the next level holds.
FANOUT = 64
#: Rows a chunk should hold on average, and rows that widening may not bring any chunk beyond.
FILL, MOST = 256, 100_000
PLACE, TO_CHUNK, TO_PLACE, ENTRY = "_place", "_to_chunk", "_to_place", "_entry"


class Rule:
    """What a scan keeps; rows and states are tables with the same columns, in order.

    ``after`` gives the pointer of every row of a chunk, ``enter`` the first row of a chunk that each state
    keeps; the number of rows stands for none. ``exits`` turns rows into the states in which they leave their
    chunk. ``stopped`` names for states that passed a whole chunk the later chunk that stops them.
    """

    def after(self, rows: pa.Table) -> np.ndarray:
        raise NotImplementedError

    def enter(self, states: pa.Table, rows: pa.Table) -> np.ndarray:
        raise NotImplementedError

    def exits(self, rows: pa.Table, places: np.ndarray) -> pa.Table:
        return rows.take(places)

    def stopped(self, passing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``passing`` (keys, chunk passed, columns) with ``_to_chunk``; by default the next chunk stops any state."""
        return following(passing, rows, keys)


def values(table: pa.Table, name: str, fill=0) -> np.ndarray:
    column = table.column(name)
    return (column.fill_null(fill) if column.null_count else column).to_numpy()


def first_reached(times: np.ndarray, since: np.ndarray, gap: np.ndarray | float) -> np.ndarray:
    """First place whose time is ``gap`` or more after each of ``since``, by the difference itself."""
    size = len(times)
    at = np.searchsorted(times, since + gap)
    gaps = np.broadcast_to(gap, since.shape)
    # The sum may be rounded past the difference by a place or two.
    while (low := (at > 0) & (times[np.maximum(at, 1) - 1] - since >= gaps)).any():
        at[low] -= 1
    while (high := (at < size) & (times[np.minimum(at, size - 1)] - since < gaps)).any():
        at[high] += 1
    return at


def next_flag(flags: np.ndarray) -> np.ndarray:
    """First flagged place from each place on; one entry more than there are places."""
    spots = np.append(np.where(flags, np.arange(len(flags)), len(flags)), len(flags))
    return np.minimum.accumulate(spots[::-1])[::-1]


class Spaced(Rule):
    """Keeps a row ``gap`` after the last kept one; a mark is always kept."""

    def __init__(self, ts: str, gap: str, mark: str):
        self.ts, self.gap, self.mark = ts, gap, mark

    def after(self, rows: pa.Table) -> np.ndarray:
        times, marks = values(rows, self.ts), next_flag(values(rows, self.mark, False))
        later = np.arange(1, len(times) + 1)
        return np.minimum(np.maximum(first_reached(times, times, values(rows, self.gap)), later), marks[later])

    def enter(self, states: pa.Table, rows: pa.Table) -> np.ndarray:
        marks = next_flag(values(rows, self.mark, False))
        return np.minimum(first_reached(values(rows, self.ts), values(states, self.ts), values(states, self.gap)), marks[0])


class Different(Rule):
    """Keeps a row whose hash differs in more than ``threshold`` bits from the last kept one.

    A row without a hash differs from all. Where ``slow`` holds, a row must also come ``interval`` after the
    last kept one if that was kept slowly and all rows since were slow.
    """

    #: Places looked at one by one before whole columns are compared.
    NEAR = 32

    def __init__(self, ts: str, bits: str, slow: str, threshold: int, interval: float):
        self.ts, self.bits, self.slow, self.threshold, self.interval = ts, bits, slow, threshold, interval

    def _parts(self, table: pa.Table) -> tuple[np.ndarray, ...]:
        blank = table.column(self.bits).is_null().to_numpy()
        # Counting bits needs numbers without a sign.
        bits = values(table, self.bits).astype(np.int64).view(np.uint64)
        return values(table, self.ts), bits, blank, values(table, self.slow, False)

    def _first_far(self, start: np.ndarray, bits: np.ndarray, blank: np.ndarray, all_bits: np.ndarray, all_blank: np.ndarray) -> np.ndarray:
        size = len(all_bits)
        out = np.full(len(start), size)
        open_rows = np.flatnonzero(start < size)
        at = start.copy()
        for _ in range(self.NEAR):
            spot = at[open_rows]
            far = (np.bitwise_count(all_bits[spot] ^ bits[open_rows]) > self.threshold) | all_blank[spot] | blank[open_rows]
            out[open_rows[far]] = spot[far]
            open_rows = open_rows[~far]
            at[open_rows] += 1
            open_rows = open_rows[at[open_rows] < size]
            if not len(open_rows):
                return out
        # A quiet picture: few distinct hashes, each compared with the chunk once.
        for one in np.unique(bits[open_rows]):
            some = open_rows[bits[open_rows] == one]
            out[some] = next_flag((np.bitwise_count(all_bits ^ one) > self.threshold) | all_blank)[at[some]]
        return out

    def after(self, rows: pa.Table) -> np.ndarray:
        times, bits, blank, slow = self._parts(rows)
        start = np.arange(1, len(times) + 1)
        if slow.any():
            free = np.minimum(first_reached(times, times, self.interval), next_flag(~slow)[start])
            start = np.where(slow, np.maximum(free, start), start)
        return self._first_far(start, bits, blank, bits, blank)

    def enter(self, states: pa.Table, rows: pa.Table) -> np.ndarray:
        times, bits, blank, slow = self._parts(rows)
        since, own, own_blank, held = self._parts(states)
        free = np.minimum(first_reached(times, since, self.interval), next_flag(~slow)[0])
        return self._first_far(np.where(held, free, 0), own, own_blank, bits, blank)

    def exits(self, rows: pa.Table, places: np.ndarray) -> pa.Table:
        slow = values(rows, self.slow, False)
        held = slow[places] & (next_flag(~slow)[places] == len(slow))
        states = rows.take(places)
        return states.set_column(states.schema.get_field_index(self.slow), self.slow, pa.array(held))

    def stopped(self, passing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The first later chunk with a differing hash, found in a tree of what hashes the chunks hold.

        A block with two hashes more than twice the threshold apart stops every state, so those two stand for
        it; else all its hashes are near each other and are kept.
        """
        keys, base = list(keys), 16
        bits = F.col(self.bits)
        # Numbered without gaps, so the tree is as deep as the logarithm of the number of chunks.
        numbered = rows.select(*keys, CHUNK).distinct().withColumn("_at", F.row_number().over(_across(keys)).cast("long")).checkpoint()
        level = rows.select(*keys, CHUNK, bits.alias("_h")).distinct().join(numbered, [*keys, CHUNK]).select(*keys, F.lit(0).alias("_level"), F.col("_at").alias("_block"), "_h")
        block = [*keys, "_level", "_block"]
        depth, tree = 0, None
        most = numbered.agg(F.max("_at")).first()[0]
        while True:
            ends = level.groupBy(*block).agg(F.min("_h").alias("_p"), F.bool_or(F.col("_h").isNull()).alias("_none"))
            spread = level.join(ends, block).withColumn("_d", F.when(F.col("_none"), 99).otherwise(F.bit_count(F.col("_h").bitwiseXOR(F.col("_p")))))
            widest = spread.groupBy(*block).agg(F.max("_d").alias("_wide"), F.max_by("_h", "_d").alias("_w"), F.first("_p").alias("_p"), F.first("_none").alias("_none"))
            wide = F.col("_wide") > 2 * self.threshold
            both = widest.where(wide).select(*block, F.explode(F.when(F.col("_none"), F.array(F.lit(None).cast("long"))).otherwise(F.array("_p", "_w"))).alias("_h"))
            near = level.join(widest.where(~wide).select(*block), block)
            level = both.unionByName(near.select(*block, "_h")).checkpoint()
            tree = level if tree is None else tree.unionByName(level)
            if most // base ** (depth + 1) == 0:
                break
            depth += 1
            level = level.select(*keys, F.lit(depth).alias("_level"), F.floor(F.col("_block") / base).cast("long").alias("_block"), "_h").distinct()
        far = F.coalesce(F.bit_count(F.col("_h").bitwiseXOR(bits)) > self.threshold, F.lit(True))
        state = passing.join(numbered, [*keys, CHUNK]).withColumn("_state", F.monotonically_increasing_id()).checkpoint()
        # Siblings to the right on every level, nearest first: together all that comes later.
        spots = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda j: F.transform(F.sequence(F.lit(1), F.lit(base - 1)), lambda k: F.struct(j.alias("level"), (F.floor(F.col("_at") / F.pow(F.lit(base), j)).cast("long") + k).alias("block")))))
        right = lambda x: F.floor(x["block"] / base) == F.floor(F.floor(F.col("_at") / F.pow(F.lit(base), x["level"])) / base)
        asked = state.select(*keys, "_state", self.bits, F.explode(F.filter(spots, right)).alias("_spot")).select(*keys, "_state", self.bits, F.col("_spot.level").alias("_level"), F.col("_spot.block").alias("_block"))
        found = asked.join(tree, block).where(far).groupBy(*keys, "_state", self.bits).agg(F.min(F.struct("_level", "_block")).alias("_spot")).select(*keys, "_state", self.bits, "_spot.*")
        for j in range(depth, 0, -1):
            found = found.checkpoint()
            here = found.where(F.col("_level") == j)
            down = here.select(*keys, "_state", self.bits, F.lit(j - 1).alias("_level"), F.explode(F.sequence(F.col("_block") * base, F.col("_block") * base + base - 1)).alias("_block"))
            down = down.join(tree, block).where(far).groupBy(*keys, "_state", self.bits).agg(F.min("_block").alias("_block"))
            found = found.where(F.col("_level") < j).unionByName(down.select(*keys, "_state", self.bits, F.lit(j - 1).alias("_level"), "_block"))
        target = numbered.select(*keys, F.col("_at").alias("_block"), F.col(CHUNK).alias(TO_CHUNK))
        found = found.join(target, [*keys, "_block"]).select("_state", TO_CHUNK)
        return state.join(found, "_state").drop("_state", "_at")


def _across(keys: Sequence[str]) -> Window:
    """The chunks of a key in order: one row per chunk."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(CHUNK)


def following(states: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``states`` with the next chunk of their key that has rows."""
    chunks = rows.select(*keys, CHUNK).distinct().withColumn(TO_CHUNK, F.lead(CHUNK).over(_across(keys))).where(F.col(TO_CHUNK).isNotNull())
    return states.join(chunks, [*keys, CHUNK])


def together(df: DataFrame, by: Sequence[str], *order) -> DataFrame:
    """Rows with equal ``by`` in one task, sorted by ``by`` and ``order``, for Python to read as runs.

    Dealt by a computed key: a shuffle on the columns themselves is left out where a join below has made one,
    and adaptive execution may then read that one in pieces, as nothing asks for whole partitions.
    """
    dealt = df.repartition(F.hash(*by, F.lit("together"))) if by else df.coalesce(1)
    return dealt.sortWithinPartitions(*by, *order) if by or order else dealt


def runs(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of every run of equal values of ``by`` in a sorted partition, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for name in by:
            code = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            here = tuple(batch.column(name)[a].as_py() for name in by)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _followed(pointers: np.ndarray) -> np.ndarray:
    """Where each path of forward pointers leaves: pointers past the end stop it."""
    size = len(pointers)
    last = np.where(pointers < size, pointers, np.arange(size))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _path(pointers: np.ndarray, start: int) -> list[int]:
    out = []
    while start < len(pointers):
        out.append(start)
        start = int(pointers[start])
    return out


def _blocked(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of the nodes of a block by place, and their pointers inside it (the size for one that leaves)."""
    chunk, place = nodes.column(CHUNK).to_numpy(), nodes.column(PLACE).to_numpy()
    order = np.lexsort([place, chunk])
    spot = {k: i for i, k in enumerate(zip(chunk[order].tolist(), place[order].tolist()))}
    to = zip(nodes.column(TO_CHUNK).to_pylist(), nodes.column(TO_PLACE).to_pylist())
    pointers = np.array([spot.get(k, len(order)) for k in to], np.int64)
    return order, pointers[order]


def kept_path(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], rule: Rule, emitted: Callable[[pa.Table, np.ndarray], np.ndarray], schema: T.StructType, *, width: float = CHUNK_SECONDS
) -> DataFrame:
    """Rows that ``rule`` keeps, starting from the first row of every key; ``schema`` names the columns given out.

    ``emitted(rows, first)`` says which kept rows are given out; ``first`` marks the first row of the key.
    Rows without a time take no part. The plan of ``df`` runs once; rounds run when the plan is built.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys, columns = list(keys), list(columns)
    timed = df.where(F.col(order[0]).isNotNull())
    slot = [*keys, CHUNK]
    wanted = list(dict.fromkeys([*slot, *order, *columns]))
    width = fitting_width(timed, keys, order[0], width)
    rows = with_chunk(timed, order[0], width).select(*wanted).checkpoint()
    # Where rows are sparse, chunks are made wider, as long as the fullest of them stays small.
    held = rows.groupBy(*slot).agg(F.count("*").alias("n")).groupBy(*keys)
    held = held.agg(F.sum("n").alias("n"), F.max("n").alias("most"), (F.max(CHUNK) - F.min(CHUNK) + 1).alias("span"))
    held = held.agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("span").alias("span")).first()
    factor = min(FILL * held.span / held.n, MOST / held.most) if held.n else 1
    if factor > 1:
        rows = with_chunk(rows, order[0], width * factor).select(*wanted)
    # All columns decide the order, so every pass numbers the rows of a chunk alike.
    sort = [*slot, *order, *[c for c in columns if c not in slot and c not in order]]
    kinds = {f.name: f.dataType for f in rows.schema}
    key_part = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in slot)
    state_part = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in wanted if c not in slot)

    def with_slot(table: pa.Table, count: int, extra: dict[str, pa.Array]) -> pa.Table:
        """``count`` rows with the slot of ``table`` and the columns ``extra``."""
        first = table.slice(0, 1).select(slot).take(pa.array(np.zeros(count, np.int64)))
        for name, column in extra.items():
            first = first.append_column(name, column)
        return first

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in runs(batches, slot):
            pointers = rule.after(chunk)
            last = _followed(pointers)
            leaving = np.flatnonzero(pointers >= len(pointers))
            out = rule.exits(chunk, leaving).append_column(PLACE, pa.array(leaving, pa.int64()))
            # Where the first row's path leaves, for the chunk in which the key begins.
            out = out.append_column("_head", pa.array(leaving == last[0]))
            yield from out.combine_chunks().to_batches()

    sorted_rows = together(rows, slot, *sort[len(slot) :])
    exits = sorted_rows.select(*wanted).mapInArrow(local, f"{key_part}, {state_part}, {PLACE} long, _head boolean").checkpoint()
    first_chunk = rows.groupBy(*keys).agg(F.min(CHUNK).alias(CHUNK)) if keys else rows.agg(F.min(CHUNK).alias(CHUNK))
    start = exits.where("_head").join(first_chunk, slot).select(*keys, CHUNK, PLACE)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in runs(batches, slot):
            from_chunk = chunk.column("_from")
            is_state = from_chunk.is_valid().to_numpy()
            states, here = chunk.filter(pa.array(is_state)), chunk.filter(pa.array(~is_state))
            if not len(states):
                continue
            entry = rule.enter(states, here) if len(here) else np.zeros(len(states), np.int64)
            last = np.append(_followed(rule.after(here)), -1) if len(here) else np.array([-1])
            met = entry < len(here)
            found = {"_from": states.column("_from").combine_chunks(), PLACE: states.column(PLACE).combine_chunks(), ENTRY: pa.array(entry, mask=~met), TO_PLACE: pa.array(last[entry], mask=~met)}
            yield from with_slot(chunk, len(states), found).combine_chunks().to_batches()

    def entered(states: DataFrame) -> DataFrame:
        """``states`` met with the chunk ``_to_chunk``; a null place for those that pass it."""
        asked = states.select(*keys, F.col(TO_CHUNK).alias(CHUNK), *[c for c in wanted if c not in slot], F.col(CHUNK).alias("_from"), PLACE)
        both = asked.unionByName(rows.join(asked.select(*slot).distinct(), slot, "left_semi"), allowMissingColumns=True)
        both = together(both, slot, F.col("_from").isNotNull(), *sort[len(slot) :]).select(*slot, *[c for c in wanted if c not in slot], "_from", PLACE)
        out = both.mapInArrow(cross, f"{key_part}, _from long, {PLACE} long, {ENTRY} long, {TO_PLACE} long")
        return out.select(*keys, F.col("_from").alias(CHUNK), PLACE, F.col(CHUNK).alias(TO_CHUNK), ENTRY, TO_PLACE).checkpoint()

    met = entered(following(exits, rows, keys))
    nodes = met.where(F.col(ENTRY).isNotNull())
    passing = met.where(F.col(ENTRY).isNull())
    while not passing.isEmpty():
        # Named by the chunk they passed while the chunk that stops them is looked for.
        own = exits.join(passing.select(*slot, PLACE, TO_CHUNK), [*slot, PLACE]).withColumn("_own", F.col(CHUNK)).withColumn(CHUNK, F.col(TO_CHUNK)).drop(TO_CHUNK)
        later = rule.stopped(own, rows, keys).withColumn(CHUNK, F.col("_own")).drop("_own")
        met = entered(later)
        nodes, passing = nodes.unionByName(met.where(F.col(ENTRY).isNotNull())), met.where(F.col(ENTRY).isNull())
    # Exits that nothing stops end their path.
    ends = exits.select(*slot, PLACE).join(nodes.select(*slot, PLACE), [*slot, PLACE], "left_anti")
    nodes = nodes.unionByName(ends, allowMissingColumns=True).checkpoint()
    visited = _visited(nodes, start, keys, key_part)
    entries = visited.where(F.col(ENTRY).isNotNull()).select(*keys, F.col(TO_CHUNK).alias(CHUNK), ENTRY, F.lit(False).alias("_first"))
    entries = entries.unionByName(first_chunk.where(F.col(CHUNK).isNotNull()).select(*slot, F.lit(0).cast("long").alias(ENTRY), F.lit(True).alias("_first")))
    names = [f.name for f in schema.fields]

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in runs(batches, slot):
            path = np.array(_path(rule.after(chunk), chunk.column(ENTRY)[0].as_py()), np.int64)
            kept = chunk.take(pa.array(path))
            kept = kept.filter(pa.array(emitted(kept, chunk.column("_first")[0].as_py() & (path == 0))))
            yield from kept.select(names).combine_chunks().to_batches()

    final = together(rows.join(entries, slot), slot, *sort[len(slot) :]).select(*wanted, ENTRY, "_first")
    return final.mapInArrow(given, schema)


def _visited(nodes: DataFrame, start: DataFrame, keys: list[str], key_part: str) -> DataFrame:
    """The nodes on the path of pointers from ``start``, level by level."""
    name = [*keys, CHUNK, PLACE]
    levels, below, size = [], nodes, 1
    while True:
        blocks = below.groupBy(*keys).agg(F.count_distinct(F.floor(F.col(CHUNK) / size)).alias("n")) if keys else below.agg(F.count_distinct(F.floor(F.col(CHUNK) / size)).alias("n"))
        if (blocks.agg(F.max("n")).first()[0] or 0) <= FANOUT:
            break
        size *= FANOUT
        block = [*keys, "_block"]

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in runs(batches, block):
                order, pointers = _blocked(some)
                last = order[_followed(pointers)]
                ordered_nodes = some.take(pa.array(order))
                out = ordered_nodes.append_column("_exit_chunk", some.column(CHUNK).take(pa.array(last))).append_column("_exit_place", some.column(PLACE).take(pa.array(last)))
                yield from out.select([*name, TO_CHUNK, TO_PLACE, "_exit_chunk", "_exit_place"]).combine_chunks().to_batches()

        placed = below.withColumn("_block", F.floor(F.col(CHUNK) / size).cast("long"))
        ways = together(placed.select(*block, CHUNK, PLACE, TO_CHUNK, TO_PLACE), block)
        ways = ways.mapInArrow(leave, f"{key_part}, {PLACE} long, {TO_CHUNK} long, {TO_PLACE} long, _exit_chunk long, _exit_place long").checkpoint()
        levels.append((placed, block, start))
        start = ways.join(start, name).select(*keys, F.col("_exit_chunk").alias(CHUNK), F.col("_exit_place").alias(PLACE))
        leaving = ways.where(f"{CHUNK} = _exit_chunk and {PLACE} = _exit_place")
        target = ways.select(*keys, F.col(CHUNK).alias(TO_CHUNK), F.col(PLACE).alias(TO_PLACE), "_exit_chunk", "_exit_place")
        below = leaving.drop("_exit_chunk", "_exit_place").join(target, [*keys, TO_CHUNK, TO_PLACE], "left")
        below = below.select(*name, F.col("_exit_chunk").alias(TO_CHUNK), F.col("_exit_place").alias(TO_PLACE)).checkpoint()

    def walk(by: list[str]):
        def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in runs(batches, by):
                order, pointers = _blocked(some)
                begun = np.flatnonzero(some.column("_begin").to_numpy()[order])
                path = [p for b in begun.tolist() for p in _path(pointers, b)]
                yield from some.take(pa.array(order[path])).select(name).combine_chunks().to_batches()

        return walked

    def on_path(table: DataFrame, begins: DataFrame, by: list[str]) -> DataFrame:
        marked = table.join(begins.select(*name, F.lit(True).alias("_begin")), name, "left").na.fill(False, ["_begin"])
        marked = together(marked.select(*dict.fromkeys([*by, *name]), TO_CHUNK, TO_PLACE, "_begin"), by)
        return marked.mapInArrow(walk(by), f"{key_part}, {PLACE} long").checkpoint()

    seen = on_path(below, start, keys)
    for placed, block, start in reversed(levels):
        # A node seen above left its block here; the path goes on at its pointer.
        further = placed.join(seen, name).where(F.col(TO_CHUNK).isNotNull()).select(*keys, F.col(TO_CHUNK).alias(CHUNK), F.col(TO_PLACE).alias(PLACE))
        seen = on_path(placed, start.unionByName(further), block)
    return nodes.join(seen, name)
