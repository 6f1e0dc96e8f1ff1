"""Activity segments and gap-based blocks.

Rows keep their segment as the key of its first row; lists of observation ids are tables, never arrays,
so a segment of any length stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.functions import text
from dayweave.operators.filters import usable_visual
from dayweave.operators.joins import contained_blocks, orphan_blocks
from dayweave.plans import ordered
from dayweave.plans.fold import ordered_fold
from dayweave.session import ensure_checkpoint_dir

#: Runs are sparse, so their chunks are longer than those of observations.
RUN_CHUNK_SECONDS = 7 * 86400.0
RUN = ["recording_id", "run_ts", "run_id"]
ANCHOR = ["recording_id", "anchor_ts", "anchor_id"]


def mark_runs(obs: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Described visual rows with their activity and the first row of their activity run."""
    rows = text.with_activity(usable_visual(obs))
    return ordered.islands(
        rows, ["recording_id"], ["timestamp", "id"], lambda a, b: a["activity"] != b["activity"], ["activity"], width=width
    )


def _names(column: str, clean) -> Column:
    cleaned = F.filter(F.transform(F.col(column), clean), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.collect_set(cleaned)))


def activity_runs(obs: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """One row per run of equal activity; the end is the end of the run's last row."""
    at = F.struct("timestamp", "id")
    return (
        mark_runs(obs, width=width)
        .groupBy(*RUN, "activity")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max_by(F.coalesce("end_timestamp", "timestamp"), at).alias("end_time"),
            F.count("*").alias("observations"),
            F.min_by("vlm_description", at).alias("key_description"),
            _names("apps", text.clean_app).alias("apps"),
            _names("topics", text.clean_topic).alias("topics"),
        )
    )


def _merge_step(min_duration: float):
    """Left-to-right merge of short runs; the state is the last finished run and one pushed forward."""

    def step(state: dict, row: tuple):
        recording, ts, run_id, start, end, next_length = row
        prev, pushed = state["prev"], state["pushed"]
        members = [[ts, run_id]]
        if pushed:
            start, end = min(start, pushed["start"]), max(end, pushed["end"])
            members += pushed["members"]
        if end - start < min_duration and (prev or next_length is not None):
            if not prev or (next_length is not None and prev["end"] - prev["start"] < next_length):
                return {"prev": prev, "pushed": {"start": start, "end": end, "members": members}}, []
            prev = {**prev, "start": min(prev["start"], start), "end": max(prev["end"], end)}
        else:
            prev = {"key": [ts, run_id], "start": start, "end": end, "count": 0}
        out = [(recording, t, i, *prev["key"], prev["count"] + n) for n, (t, i) in enumerate(members)]
        prev["count"] += len(members)
        return {"prev": prev, "pushed": None}, out

    return step


def merge_short_segments(runs: DataFrame, min_duration: float = 30.0, *, width: float = RUN_CHUNK_SECONDS) -> DataFrame:
    """Assign every run to the run it ends up in.

    Runs are visited in time order; one shorter than the minimum joins the longer of its neighbours,
    the previous one on a tie. ``position`` is the place of the run in the merged list, whose first
    entry is the anchor itself.
    """
    length = F.col("end_time") - F.col("start_time")
    slim = runs.select(*RUN, "start_time", "end_time")
    ahead = ordered.carry(
        slim, ["recording_id"], ["run_ts", "run_id"], {"next_length": length}, forward=True, width=width
    )
    kinds = {f.name: f.dataType for f in runs.schema}
    schema = T.StructType(
        [
            *[T.StructField(c, kinds[c]) for c in RUN],
            T.StructField("anchor_ts", kinds["run_ts"]),
            T.StructField("anchor_id", kinds["run_id"]),
            T.StructField("position", T.LongType()),
        ]
    )
    columns = [*RUN, "start_time", "end_time", "next_length"]
    start = {"prev": None, "pushed": None}
    return ordered_fold(
        ahead, ["recording_id"], ["run_ts", "run_id"], columns, _merge_step(min_duration), start, schema, width=width
    )


def _stored_runs(obs: DataFrame) -> DataFrame:
    """The run table, written once: merging needs it several times, the observations only once."""
    ensure_checkpoint_dir(obs.sparkSession)
    return activity_runs(obs).checkpoint()


def segments(obs: DataFrame, min_duration: float = 30.0, *, width: float = RUN_CHUNK_SECONDS) -> DataFrame:
    """Activity segments after merging short runs, numbered ``seg-<n>`` per recording."""
    runs = _stored_runs(obs)
    home = merge_short_segments(runs, min_duration, width=width)
    own = F.col("position") == 0
    merged = (
        runs.join(home, RUN)
        .groupBy(*ANCHOR)
        .agg(
            F.max(F.when(own, F.col("activity"))).alias("activity"),
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.sum("observations").alias("observations"),
            F.max(F.when(own, F.col("key_description"))).alias("key_description"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("apps")))).alias("apps"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"),
        )
    )
    numbered = ordered.row_index(merged, ["recording_id"], ["anchor_ts", "anchor_id"], "_n", width=width)
    return numbered.withColumn("id", F.concat(F.lit("seg-"), F.col("_n"))).withColumn(
        "duration", F.col("end_time") - F.col("start_time")
    ).drop("_n")


def segment_members(obs: DataFrame, min_duration: float = 30.0, *, width: float = RUN_CHUNK_SECONDS) -> DataFrame:
    """Observation to segment: one row per described visual observation.

    Inside a segment the observations are listed by ``position`` of their run, then by time.
    """
    home = merge_short_segments(_stored_runs(obs), min_duration, width=width)
    rows = mark_runs(obs).select(*RUN, F.col("id").alias("observation_id"), "timestamp")
    return rows.join(home, RUN)


def segment_context(members: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cleaned, distinct and sorted applications and topics of every segment."""
    described = members.join(obs.select(F.col("id").alias("observation_id"), "apps", "topics"), "observation_id")
    return described.groupBy(*keys).agg(
        F.array_sort(_names("apps", text.clean_app)).alias("apps"),
        F.array_sort(_names("topics", text.clean_topic)).alias("topics"),
    )


def segment_stats(segs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Segments, total and mean length per activity."""
    return segs.groupBy(*keys, "activity").agg(
        F.count("*").alias("segments"),
        F.sum("duration").alias("total_duration"),
        F.avg("duration").alias("avg_duration"),
    )


def mark_blocks(
    obs: DataFrame, gap: float = 60.0, keys: Sequence[str] = ("recording_id",), *, ts: str = "timestamp", width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Rows with the first row of their block; a block ends where the next row is more than ``gap`` later."""
    return ordered.islands(
        obs, keys, [ts, "id"], lambda a, b: b[ts] - a[ts] > gap, [ts], alias="block", width=width
    )


def gap_blocks(
    obs: DataFrame, gap: float = 60.0, keys: Sequence[str] = ("recording_id",), *, ts: str = "timestamp", min_observations: int = 1
) -> DataFrame:
    """One row per gap-separated block with its span and number of observations."""
    blocks = mark_blocks(obs, gap, keys, ts=ts).groupBy(*keys, "block_ts", "block_id").agg(
        F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"), F.count("*").alias("observation_count")
    )
    blocks = blocks.withColumn("duration", F.col("to_ts") - F.col("from_ts"))
    return blocks.where(F.col("observation_count") >= min_observations)


def block_activity_counts(marked: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    return marked.where("activity_type is not null").groupBy(*keys, "block_ts", "block_id", "activity_type").agg(
        F.count("*").alias("n")
    )


def block_app_counts(marked: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    return (
        marked.select(*keys, "block_ts", "block_id", F.explode("apps").alias("app"))
        .groupBy(*keys, "block_ts", "block_id", "app")
        .agg(F.count("*").alias("n"))
    )


def top_entries(counts: DataFrame, keys: Sequence[str], name: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent names per key as ``name(count)``, smallest name first on a tie.

    Input has one row per key and name. Every task keeps ``n`` rows a key before they meet, so a key may have
    any number of names; keys without a name have no row, as before.
    """
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), name))).where(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col(name).alias("name"), "n")))
    shown = F.transform(listed, lambda r: F.concat(r["name"], F.lit("("), r["n"], F.lit(")")))
    return ranked.groupBy(*keys).agg(F.array_join(shown, ", ").alias("top"))


def gap_sweep(obs: DataFrame, gaps: Sequence[float] = (60.0, 120.0, 300.0), keys: Sequence[str] = ()) -> DataFrame:
    """Block statistics for several gaps; ``best`` marks the highest length-times-size per block.

    Rows are read once: blocks of the smallest gap are what larger gaps merge. Every block knows the pause
    before and after it, and one scan over them gives for each gap where the block it then belongs to began;
    a block ends where the pause after it is longer. Nothing is copied per gap but the blocks found.
    """
    ensure_checkpoint_dir(obs.sparkSession)
    keys, gaps = list(keys), sorted({float(g) for g in gaps})
    order = ["from_ts", "block_id"]
    small = gap_blocks(obs, gaps[0], keys).select(*keys, *order, "to_ts", "observation_count").checkpoint()
    line = ordered.carry(small, keys, order, {"_prev": F.col("to_ts")})
    line = ordered.running_total(line, keys, order, F.col("observation_count"), "upto").checkpoint()
    pause = F.col("from_ts") - F.col("_prev")
    begin = F.struct(F.col("from_ts").alias("ts"), (F.col("upto") - F.col("observation_count")).alias("base"))
    starts = {f"_s{n}": F.when(pause.isNull() | (pause > g), begin) for n, g in enumerate(gaps)}
    line = ordered.carry(line, keys, order, starts, strict=False)
    line = ordered.carry(line, keys, order, {"_next": F.col("from_ts")}, forward=True)
    after = F.col("_next") - F.col("to_ts")
    ends = F.array(*[F.when(after.isNull() | (after > g), F.struct(F.lit(g).alias("gap"), F.col(f"_s{n}").alias("s"))) for n, g in enumerate(gaps)])
    ended = line.select("to_ts", "upto", F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e"))
    blocks = ended.select("e.gap", (F.col("to_ts") - F.col("e.s.ts")).alias("duration"), (F.col("upto") - F.col("e.s.base")).alias("observation_count"))
    stats = block_stats(blocks, ["gap"])
    score = F.col("avg_duration") * F.col("avg_observations") / F.greatest("blocks", F.lit(1))
    # One row per gap is left: the ranking window is as small as the list of gaps.
    top = F.max_by("gap", F.struct(score.alias("s"), (-F.col("gap")).alias("g"))).over(ordered._by())
    return stats.withColumn("best", F.col("gap") == top)


def block_stats(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean length and size, share of short and of small blocks; zeros without blocks."""
    share = lambda cond: F.coalesce(F.avg(F.when(cond, 100.0).otherwise(0.0)), F.lit(0.0))
    return blocks.groupBy(*keys).agg(
        F.count("*").alias("blocks"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"),
        share(F.col("duration") < 30).alias("under_30s_percent"),
        share(F.col("observation_count") < 3).alias("under_3_percent"),
        F.coalesce(F.avg("observation_count"), F.lit(0.0)).alias("avg_observations"),
    )


def block_summary(obs: DataFrame, gap: float = 60.0, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Span, most frequent activity, names, title and key description of every block.

    The key description joins all descriptions of up to six, else the first five and the last; only
    those rows are collected. The title is the first row's applications, the summary its description.
    """
    block = [*keys, "block_ts", "block_id"]
    marked = mark_blocks(obs, gap, keys)
    at = F.struct("timestamp", "id")
    base = marked.groupBy(*block).agg(
        F.min("timestamp").alias("from_ts"),
        F.max("timestamp").alias("to_ts"),
        F.count("*").alias("observation_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("apps")))).alias("apps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"),
        F.min_by(F.array_join("apps", ", "), at).alias("title"),
        F.min_by("vlm_description", at).alias("summary"),
    )
    modes = block_activity_counts(marked, keys).groupBy(*block).agg(
        F.min_by("activity_type", F.struct((-F.col("n")).alias("n"), "activity_type")).alias("activity")
    )
    described = marked.where("vlm_description is not null").select(*block, "timestamp", "id", "vlm_description")
    placed = ordered.row_index(described, block, ["timestamp", "id"], "_n")
    sizes = described.groupBy(*block).agg(F.count("*").alias("_all"))
    shown = placed.join(sizes, block).where("_all <= 6 or _n < 5 or _n = _all - 1")
    key = shown.groupBy(*block).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", "vlm_description"))), lambda r: r["vlm_description"]), "; "
        ).alias("key_description")
    )
    return base.join(modes, block, "left").join(key, block, "left")


def rebuild_blocks(obs: DataFrame, gap: float = 60.0, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Fresh block assignment of every observation; ``tb_id`` is a stable hash of key and first row."""
    marked = mark_blocks(obs.drop("tb_id"), gap, keys)
    return marked.withColumn("tb_id", F.xxhash64(*keys, "block_ts", "block_id"))


def compact_blocks(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group of blocks: hull of the spans, sum of the members' effort.

    A block that was never compacted has its own length as effort.
    """
    effort = F.coalesce("effort_seconds", F.col("to_ts") - F.col("from_ts"))
    return blocks.join(groups.select(F.col("block_id").alias("id"), "group_id"), "id").groupBy("group_id").agg(
        F.min("from_ts").alias("from_ts"),
        F.max("to_ts").alias("to_ts"),
        F.sum(effort).alias("effort_seconds"),
        F.count("*").alias("members"),
    )


def fragmentation(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("recording_id",), *, width: float = 900.0) -> DataFrame:
    """Inner blocks per outer block, only outer blocks that contain any."""
    return contained_blocks(inner, outer, keys, width=width).groupBy(*keys, "outer_id").agg(F.count("*").alias("inner_blocks"))


def orphan_breakdown(orphans: DataFrame) -> DataFrame:
    """Orphans by activity and cause: too few observations, then too short, then other."""
    length = F.col("to_ts") - F.col("from_ts")
    cause = F.when(F.col("observation_count") < 3, "few").when(length < 30, "short").otherwise("other")
    return orphans.groupBy("activity_type", cause.alias("cause")).agg(
        F.count("*").alias("blocks"), F.sum(length).alias("seconds"), F.sum("observation_count").alias("observations")
    )


def block_diff(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("recording_id",), *, width: float = 900.0) -> DataFrame:
    """What replacing the inner blocks by the outer ones would lose, and a verdict."""
    length = F.col("to_ts") - F.col("from_ts")
    few = F.col("observation_count") < 3
    lost = orphan_blocks(inner, outer, keys, width=width).agg(
        F.count("*").alias("eliminated"),
        F.count_if(length < 30).alias("too_short"),
        F.count_if((length >= 30) & few).alias("too_few"),
        F.count_if((length >= 30) & ~few).alias("in_gap"),
        F.count_if((F.col("observation_count") >= 5) & (length >= 60)).alias("significant"),
    )
    n_inner, n_outer = inner.agg(F.count("*")).scalar(), outer.agg(F.count("*")).scalar()
    ratio = F.col("inner_blocks") / F.greatest(F.col("outer_blocks"), F.lit(1))
    share = F.col("eliminated") / F.col("inner_blocks")
    verdict = F.when((ratio > 3) & (share < 0.3), "promising").when((ratio > 2) & (share < 0.5), "moderate").otherwise("aggressive")
    return (
        lost.withColumn("inner_blocks", n_inner)
        .withColumn("outer_blocks", n_outer)
        .withColumn("compression", ratio)
        .withColumn("verdict", verdict)
    )
