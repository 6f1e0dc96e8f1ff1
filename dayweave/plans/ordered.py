"""Ordered scans over one key that stay parallel when a single key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole recording into one task. Every builder
here cuts a key into time chunks first: the row-level window runs per ``(key, chunk)``, one summary
row per chunk is enough to connect neighbouring chunks, and the connection is joined back on the
partitioning the row-level window already has. Rows are shuffled once; only summaries move again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One hour of one key per chunk: at most 8,760 summary rows per key and year.
CHUNK_SECONDS = 3600.0
#: Rows of a scan without keys that one chunk should hold.
CHUNK_ROWS = 100_000
#: Edges of one group of edges, and groups of edges, at most.
EDGES = 64
CHUNK = "_chunk"
#: The chunk of rows without a time; it comes before all others.
NO_TIME = -(1 << 62)


def with_chunk(df: DataFrame, ts: str, width: float = CHUNK_SECONDS) -> DataFrame:
    """Add the chunk number ``floor(ts / width)``; rows without a time come first, as in SQL.

    The number is never null, so the row side and the summary side of a scan read the same plan and Spark
    reuses one shuffle for both.
    """
    return df.withColumn(CHUNK, F.coalesce(F.floor(F.col(ts) / F.lit(float(width))).cast("long"), F.lit(NO_TIME)))


def fitting_width(df: DataFrame, keys: Sequence[str], ts: str, width: float) -> float:
    """``width``, or for a scan without keys the width at which a chunk holds about ``CHUNK_ROWS`` rows.

    Without keys a fixed width would put all rows of that time into one task, however many there are.
    One aggregate runs when the plan is built.
    """
    if keys:
        return width
    span = df.agg(F.min(ts).alias("low"), F.max(ts).alias("high"), F.count(ts).alias("n")).first()
    if not span.n or span.high == span.low:
        return width
    return min(width, float(span.high - span.low) * CHUNK_ROWS / span.n)


def chunked(df: DataFrame, keys: Sequence[str], ts: str, width: float) -> DataFrame:
    """``df`` with the chunk of every row: by ``width`` with keys, else about ``CHUNK_ROWS`` rows each.

    Without keys the edges of the chunks are quantiles of the times, from a sketch that partitions build and
    merge, so a burst of rows is cut as finely as it is dense. One aggregate runs when the plan is built.
    """
    if keys:
        return with_chunk(df, ts, width)
    at = F.col(ts).cast("double")
    count = df.agg(F.count(at).alias("n")).first().n
    parts = min(EDGES * EDGES, -(-count // CHUNK_ROWS))
    if parts < 2:
        return with_chunk(df, ts, width)
    shares = [i / parts for i in range(1, parts)]
    edges = sorted(set(df.agg(F.percentile_approx(at, shares, 10 * parts).alias("q")).first().q))
    # Two steps: the group of edges, then the edge in it.
    groups = [edges[i : i + EDGES] for i in range(0, len(edges), EDGES)]
    matrix = F.array(*[F.array(*[F.lit(float(e)) for e in group]) for group in groups])
    passed = lambda array, c: F.size(F.filter(array, lambda e: e <= c))
    group = F.greatest(passed(F.array(*[F.lit(float(g[0])) for g in groups]), at) - 1, F.lit(0))
    place = (group * EDGES + passed(F.element_at(matrix, group + 1), at)).cast("long")
    return df.withColumn(CHUNK, F.when(at.isNull(), F.lit(NO_TIME)).otherwise(place))


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _pack(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(summary, [*keys, CHUNK])


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    *,
    strict: bool = True,
    forward: bool = False,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Last non-null value before each row in ``order`` (``order[0]`` is numeric seconds).

    ``values`` maps new column names to expressions. ``strict`` leaves the row itself out, which makes
    it a lag; ``forward`` looks at following rows instead, which makes it a lead or the right half of a
    nearest-neighbour lookup.
    """
    keys, names = list(keys), list(values)
    direction = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    pick = F.min_by if forward else F.max_by
    rows = chunked(df, keys, order[0], width).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = _by(*keys, CHUNK).orderBy(*[direction(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0
    )
    outside = _by(*keys).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*keys, CHUNK).agg(
        *[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), _pack(order))).alias(f"_edge_{n}") for n in names]
    )
    edges = edges.select(
        *keys, CHUNK, *[F.last(f"_edge_{n}", ignorenulls=True).over(outside).alias(f"_in_{n}") for n in names]
    )
    local = rows.withColumns({f"_at_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in names})
    filled = {n: F.coalesce(f"_at_{n}", f"_in_{n}") for n in names}
    spare = [f"{p}_{n}" for p in ("_v", "_at", "_in") for n in names]
    return _attach(local, edges, keys).withColumns(filled).drop(*spare, CHUNK)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    alias: str,
    *,
    descending: bool = False,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order``; ``value=lit(1)`` numbers the rows from one."""
    keys = list(keys)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = chunked(df, keys, order[0], width)
    inside = _by(*keys, CHUNK).orderBy(*[direction(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total"))
    before = _by(*keys).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return (
        _attach(rows.withColumn("_sum", F.sum(value).over(inside)), totals, keys)
        .withColumn(alias, F.col("_sum") + F.col("_base"))
        .drop("_sum", "_base", CHUNK)
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    alias: str,
    *,
    descending: bool = False,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Zero-based position of each row inside its key."""
    numbered = running_total(df, keys, order, F.lit(1), alias, descending=descending, width=width)
    return numbered.withColumn(alias, (F.col(alias) - 1).cast("long"))


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    breaks: Callable[[Column, Column], Column],
    compare: Sequence[str],
    *,
    alias: str = "run",
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Mark every row with the first row of its island.

    A new island starts where ``breaks(previous, current)`` holds; both arguments are structs of the
    ``compare`` columns. The island is named by ``<alias>_ts`` and ``<alias>_id``, the ``order`` values
    of its first row, so no per-key counter is needed.
    """
    keys = list(keys)
    start = F.struct(F.col(order[0]).alias("ts"), F.col(order[1]).alias("id"))
    rows = chunked(df, keys, order[0], width).withColumn("_cur", _pack(compare))
    scan = _by(*keys, CHUNK).orderBy(*order)
    rows = rows.withColumn("_prev", F.lag("_cur").over(scan)).withColumn(
        "_open", F.when(F.col("_prev").isNotNull() & breaks(F.col("_prev"), F.col("_cur")), start)
    )
    rows = rows.withColumn(
        "_local",
        F.last("_open", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, 0)),
    )
    heads = rows.groupBy(*keys, CHUNK).agg(
        F.min(start).alias("_first_at"),
        F.min_by("_cur", start).alias("_first"),
        F.max_by("_cur", start).alias("_last"),
        F.max("_local").alias("_latest"),
    )
    across = _by(*keys).orderBy(CHUNK)
    heads = heads.withColumn("_before", F.lag("_last").over(across))
    fresh = F.coalesce(F.col("_before").isNull() | breaks(F.col("_before"), F.col("_first")), F.lit(False))
    heads = heads.withColumn("_head", F.when(fresh, F.col("_first_at")))
    heads = heads.withColumn(
        "_in",
        F.last(F.coalesce("_latest", "_head"), ignorenulls=True).over(
            across.rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    heads = heads.select(*keys, CHUNK, F.coalesce("_head", "_in").alias("_head"))
    return (
        _attach(rows, heads, keys)
        .withColumn("_start", F.coalesce("_local", "_head"))
        .withColumn(f"{alias}_ts", F.col("_start.ts"))
        .withColumn(f"{alias}_id", F.col("_start.id"))
        .drop("_cur", "_prev", "_open", "_local", "_head", "_start", CHUNK)
    )


def trailing_count(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    flag: Column,
    seconds: float,
    alias: str,
    *,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Rows with ``flag`` in ``[ts - seconds, ts]`` of the same key.

    Every row also joins the following chunk as a halo row when it can still be seen from there, so
    no rows of other partitions are needed. A count is the difference of two that only grow along the
    chunk, so rows are passed once however many the range holds. ``seconds`` is a whole number.
    """
    if seconds != int(seconds):
        raise ValueError("the trailing range is a whole number of seconds")
    keys = list(keys)
    chunked = with_chunk(df.withColumn("_flag", flag), ts, width)
    reach = F.floor((F.col(ts) + F.lit(float(seconds))) / F.lit(float(width))).cast("long")
    spread = chunked.withColumn("_at", F.explode(F.sequence(F.col(CHUNK), F.coalesce(reach, F.col(CHUNK)))))
    scan = _by(*keys, "_at").orderBy(ts)
    spread = spread.withColumn("_equal", F.count_if("_flag").over(_by(*keys, "_at", ts).orderBy(ts)))
    passed = scan.rangeBetween(Window.unboundedPreceding, -int(seconds))
    spread = spread.withColumns({
        "_upto": F.count_if("_flag").over(scan.rangeBetween(Window.unboundedPreceding, 0)),
        "_gone": F.count_if("_flag").over(passed),
        "_edge": F.max(F.struct(F.col(ts).alias("ts"), F.col("_equal").alias("n"))).over(passed),
    })
    # Rows at the very start of the range belong to it.
    first = F.when(F.col("_edge.ts") == F.col(ts) - int(seconds), F.col("_edge.n")).otherwise(0)
    return (
        spread.withColumn(alias, F.when(F.col(ts).isNull(), F.col("_equal")).otherwise(F.col("_upto") - F.col("_gone") + first))
        .where(F.col("_at") == F.col(CHUNK))
        .drop("_flag", "_at", "_equal", "_upto", "_gone", "_edge", CHUNK)
    )
