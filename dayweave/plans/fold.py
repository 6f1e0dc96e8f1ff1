"""Exact ordered folds that do not put a whole key into one task.

Some operators carry a small state from row to row (the last kept time, the last kept hash). The key
is cut into time chunks, and a chunk is treated as a map from the state before it to the state after it.
Every chunk is folded from the initial state at once; then each from the states its predecessor was seen
to end in, and so on until no chunk meets a state it was not folded from. The maps are remembered, so the
number of rounds follows from how many states a chunk can be entered with (the phases of a sampler, one
or two where the fold forgets its start), not from how many chunks there are. One walk over the maps, a
few rows per chunk, then picks the state every chunk is really entered with, which makes the result equal
to the sequential fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dayweave.plans.ordered import CHUNK, CHUNK_SECONDS, fitting_width, with_chunk
from dayweave.session import ensure_checkpoint_dir

#: ``step(state, row) -> (state, output rows)``; the row is a tuple of the ``columns`` values.
Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]


def _scan(batches: Iterator[pa.RecordBatch], columns: list[str], slot: list[str], step: Step) -> Iterator[tuple]:
    """Fold the rows of a partition, sorted by slot; yields ``(slot, given, state, output rows, closed)``."""
    here = given = state = None
    for batch in batches:
        at = {name: i for i, name in enumerate(batch.schema.names)}
        values = lambda names: zip(*[batch.column(at[n]).to_pylist() for n in names])
        for place, (number, start), row in zip(values(slot), values(["_n", "_given"]), values(columns)):
            if number == 1:
                if here is not None:
                    yield here, given, state, (), True
                here, given, state = place, start, json.loads(start)
            state, out = step(state, row)
            if out:
                yield here, given, state, out, False
    if here is not None:
        yield here, given, state, (), True


def _walk(batches: Iterator[pa.RecordBatch], keys: list[str], first: str) -> Iterator[tuple]:
    """The state every chunk is entered with, as ``(slot, state)``, from maps ``(slot, _given, _left)`` sorted by slot."""
    here, state, lefts = None, first, {}
    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in [*keys, CHUNK, "_given", "_left"]]
        for *slot, given, left in zip(*values):
            if here != slot:
                if here is not None:
                    yield here, state
                    state = lefts[state] if here[:-1] == slot[:-1] else first
                here, lefts = slot, {}
            lefts[given] = left
    if here is not None:
        yield here, state


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    step: Step,
    initial: Any,
    schema: T.StructType,
    *,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Fold ``step`` over each key in ``order``; ``schema`` describes its output rows.

    The state must survive JSON. Chunks are read through a window, so all rows of one chunk reach one
    task in order, batch by batch.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys, columns = list(keys), list(columns)
    slot = [*keys, CHUNK]
    # Written once: every round reads these narrow rows instead of the plan behind them. A row without a
    # time has no place in a sequence of times.
    timed = df.where(F.col(order[0]).isNotNull())
    rows = with_chunk(timed, order[0], fitting_width(timed, keys, order[0], width))
    rows = rows.select(*dict.fromkeys([*slot, *order, *columns])).checkpoint()
    first = json.dumps(initial)
    in_slot = Window.partitionBy(*slot, "_given").orderBy(*order)
    state_schema = T.StructType(
        [*[rows.schema[k] for k in slot], T.StructField("_given", T.StringType()), T.StructField("_left", T.StringType())]
    )
    given_schema = T.StructType(state_schema.fields[:-1])
    state_arrow, given_arrow, out_arrow = to_arrow_schema(state_schema), to_arrow_schema(given_schema), to_arrow_schema(schema)

    def final_states(batches):
        closed = ((*here, given, json.dumps(state)) for here, given, state, _, end in _scan(batches, columns, slot, step) if end)
        return _batches(closed, state_arrow)

    def outputs(batches):
        return _batches((r for _, _, _, out, _ in _scan(batches, columns, slot, step) for r in out), out_arrow)

    def placed(given: DataFrame) -> DataFrame:
        return rows.join(given, slot).withColumn("_n", F.row_number().over(in_slot))

    def walk(batches):
        return _batches(((*here, state) for here, state in _walk(batches, keys, first)), given_arrow)

    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(CHUNK)
    after = rows.select(*slot).distinct().withColumn("_after", F.lead(CHUNK).over(across)).where("_after is not null").checkpoint()
    seeded = rows.withColumn("_given", F.lit(first)).withColumn("_n", F.row_number().over(in_slot))
    fresh = seeded.mapInArrow(final_states, state_schema).checkpoint()
    maps = fresh
    while True:
        met = fresh.join(after, slot).select(*keys, F.col("_after").alias(CHUNK), F.col("_left").alias("_given")).distinct()
        new = met.join(maps, [*slot, "_given"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        fresh = placed(new).mapInArrow(final_states, state_schema).checkpoint()
        maps = maps.unionByName(fresh)
    # The maps of a key are read in a stream of plain values: a call per key would cost more than its rows.
    dealt = maps.repartition(*keys) if keys else maps.repartition(1)
    chosen = dealt.sortWithinPartitions(*slot).mapInArrow(walk, given_schema)
    return placed(chosen).mapInArrow(outputs, schema)
