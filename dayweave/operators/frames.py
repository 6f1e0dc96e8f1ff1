"""Frame sampling and near-duplicate reduction."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.functions.numbers import half_up, hamming, hash_from_hex
from dayweave.plans import ordered
from dayweave.plans.pointers import Different, Spaced, kept_path
from dayweave.session import ensure_checkpoint_dir

REC = ["recording_id"]
ORDER = ["timestamp", "id"]


def _out(df: DataFrame, keys: Sequence[str], *extra: T.StructField) -> T.StructType:
    kinds = {f.name: f.dataType for f in df.schema}
    return T.StructType([*[T.StructField(c, kinds[c]) for c in [*keys, *ORDER]], *extra])


def one_per_timestamp(frames: DataFrame) -> DataFrame:
    """The first frame (smallest id) of every recording and time."""
    return frames.groupBy("recording_id", "timestamp").agg(F.min("id").alias("id"))


#: Intervals a chunk of a greedy scan spans at least; shorter chunks would hardly hold a kept row.
SPANNED = 20


def _greedy(df: DataFrame, keys: Sequence[str], interval: Column, scene: Column, first_counts: bool, width: float) -> DataFrame:
    """Rows ``interval`` (one per key) after the last kept one; scene rows restart the clock and are not given out.

    The clock starts at the first row; ``first_counts`` says whether that row itself is kept.
    """
    rows = df.select(*keys, *ORDER, interval.cast("double").alias("_interval"), F.coalesce(scene, F.lit(False)).alias("_scene"))

    def emitted(kept: pa.Table, first: np.ndarray) -> np.ndarray:
        return ~kept.column("_scene").to_numpy() & (~first | first_counts)

    return kept_path(rows, keys, ORDER, ["_interval", "_scene"], Spaced("timestamp", "_interval", "_scene"), emitted, _out(df, keys), width=width)


def sample_base(frames: DataFrame, base: float = 10.0, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """First frame of each recording, then every frame at least ``base`` seconds after the last kept one."""
    kept = _greedy(one_per_timestamp(frames), REC, F.lit(base), F.lit(False), True, max(width, SPANNED * base))
    return kept.withColumn("reason", F.lit("base"))


def scene_dedup(scenes: DataFrame, min_interval: float = 2.0, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Scene times at least ``min_interval`` after the last kept one."""
    return _greedy(scenes, REC, F.lit(min_interval), F.lit(False), True, max(width, SPANNED * min_interval))


def gap_fill(
    frames: DataFrame, samples: DataFrame, threshold: Column, fill: Column, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Frames nearest to a grid of step ``fill`` inside gaps of more than ``threshold`` between samples.

    Whether some grid time lies closer to a frame than to its neighbours follows from the midpoints to
    the frames before and after it (the earlier frame wins a tie), so the grid is never produced.
    ``threshold`` and ``fill`` may use columns of ``frames``.
    """
    marked = frames.join(samples.select(*REC, *ORDER, "reason"), [*REC, *ORDER], "left")
    at = F.col("timestamp")
    kept = F.when(F.col("reason").isNotNull(), at)
    marked = ordered.carry(marked, REC, ORDER, {"_before": at, "_from": kept}, width=width)
    marked = ordered.carry(marked, REC, ORDER, {"_after": at, "_to": kept}, forward=True, width=width)
    gap = F.col("_to") - F.col("_from")
    steps = F.floor(gap / fill - 1 + 1e-9)
    low = (F.col("_before") + at) / 2 - F.col("_from")
    high = F.least((at + F.col("_after")) / 2 - F.col("_from"), steps * fill)
    hit = F.greatest(F.floor(low / fill) + 1, F.lit(1)) <= F.floor(high / fill)
    return marked.where(kept.isNull() & (gap > threshold) & hit).select(*REC, *ORDER).withColumn("reason", F.lit("gap_fill"))


def adaptive_sample(
    frames: DataFrame, base: float = 10.0, threshold: float = 15.0, fill: float = 3.0, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Base samples and the frames that fill their gaps."""
    distinct = one_per_timestamp(frames)
    # Read by both parts of the result.
    samples = sample_base(frames, base, width=width).checkpoint()
    return samples.unionByName(gap_fill(distinct, samples, F.lit(threshold), F.lit(fill), width=width))


def adaptive_interval(scenes: Column, base: Column) -> Column:
    """Base interval by number of scenes: more scenes, fewer base samples."""
    return F.when(scenes > 50, F.greatest(base, F.lit(30))).when(scenes > 20, F.greatest(base, F.lit(20))).otherwise(base)


def adaptive_threshold(scenes: Column, threshold: Column) -> Column:
    return F.when(scenes > 50, F.greatest(threshold, F.lit(60))).when(scenes > 20, F.greatest(threshold, F.lit(40))).otherwise(threshold)


def adaptive_fill(scenes: Column, fill: Column) -> Column:
    return F.when(scenes > 50, F.greatest(fill, F.lit(10))).when(scenes > 20, F.greatest(fill, F.lit(5))).otherwise(fill)


def nearest_frames(frames: DataFrame, targets: DataFrame, *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Frame nearest in time to every target of the same recording, the earlier one on a tie.

    Frames and targets share one ordered scan; the neighbours come from the scan in both directions.
    """
    shot = F.struct("timestamp", "id")
    points = frames.select(*REC, "timestamp", "id", shot.alias("_shot"), F.lit(0).alias("_kind"))
    asked = targets.select(*REC, "timestamp", F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(None).cast(points.schema["_shot"].dataType).alias("_shot"), F.lit(1).alias("_kind"))
    line = points.unionByName(asked)
    line = ordered.carry(line, REC, ["timestamp", "_kind"], {"_left": F.col("_shot")}, width=width)
    line = ordered.carry(line, REC, ["timestamp", "_kind"], {"_right": F.col("_shot")}, forward=True, width=width)
    at = F.col("timestamp")
    left_closer = F.col("_right").isNull() | (at - F.col("_left.timestamp") <= F.col("_right.timestamp") - at)
    best = F.when(F.col("_left").isNotNull() & left_closer, F.col("_left")).otherwise(F.col("_right"))
    return line.where("_kind = 1").select(*REC, at.alias("target"), best.alias("_best")).where("_best is not null").select(
        *REC, "target", F.col("_best.timestamp").alias("timestamp"), F.col("_best.id").alias("id")
    )


def sample_with_scenes(
    frames: DataFrame, scenes: DataFrame, base: float = 10.0, threshold: float = 15.0, fill: float = 3.0, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Frames at scene changes, base samples between them, and gap filling.

    The base clock restarts at every scene frame. Without scenes it starts at the first frame, which is
    then not sampled itself.
    """
    distinct = one_per_timestamp(frames)
    counts = scenes.groupBy(*REC).agg(F.count("*").alias("_scenes"))
    tuned = distinct.join(counts, REC, "left").na.fill(0, ["_scenes"])
    n = F.col("_scenes")
    at_scene = nearest_frames(distinct, scenes, width=width).select(*REC, *ORDER).distinct().withColumn("reason", F.lit("scene_change"))
    ensure_checkpoint_dir(frames.sparkSession)
    at_scene = at_scene.checkpoint()
    flagged = tuned.join(at_scene, [*REC, *ORDER], "left")
    between = _greedy(flagged, REC, adaptive_interval(n, F.lit(base)), F.col("reason").isNotNull(), False, max(width, SPANNED * base))
    samples = at_scene.unionByName(between.withColumn("reason", F.lit("base"))).checkpoint()
    filled = gap_fill(tuned, samples, adaptive_threshold(n, F.lit(threshold)), adaptive_fill(n, F.lit(fill)), width=width)
    return samples.unionByName(filled)


def required_timestamps(
    recordings: DataFrame, scenes: DataFrame, base: int = 10, threshold: int = 15, fill: int = 3, *, width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Whole seconds of a recording at which a frame is needed, without looking at frames.

    Times of the grid are only made, never shuffled: scene times that lie on it are left out by their remainder.
    No two planned times are further apart than the grid's step, so only recordings with a step above the
    threshold are looked through for gaps.
    """
    counts = scenes.groupBy(*REC).agg(F.count("*").alias("_scenes"))
    lengths = recordings.where("duration > 0").select(F.col("id").alias("recording_id"), "duration")
    tuned = lengths.join(counts, REC, "left").na.fill(0, ["_scenes"])
    n = F.col("_scenes")
    tuned = tuned.select(
        *REC,
        "duration",
        adaptive_interval(n, F.lit(base)).cast("long").alias("_base"),
        adaptive_threshold(n, F.lit(threshold)).alias("_threshold"),
        adaptive_fill(n, F.lit(fill)).cast("long").alias("_fill"),
    )
    marks = scenes.join(lengths, REC).withColumn("second", half_up(F.col("timestamp"))).where("second >= 0 and second <= duration").select(*REC, "second").distinct()

    def planned(rules: DataFrame) -> DataFrame:
        # A recording that is given twice has one grid, to its greater length.
        steps = rules.groupBy(*REC).agg(F.max(F.floor("duration")).cast("long").alias("_last"), F.first("_base").alias("_base"))
        grid = steps.select(*REC, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.col("_base"))).alias("second"))
        return grid.unionByName(marks.join(steps, REC).where(F.col("second") % F.col("_base") != 0).select(*REC, "second"))

    wide = tuned.where(F.col("_base") > F.col("_threshold"))
    ahead = planned(wide).withColumn("timestamp", F.col("second").cast("double"))
    ahead = ordered.carry(ahead, REC, ["timestamp", "second"], {"_next": F.col("second")}, forward=True, width=width)
    gaps = ahead.join(wide, REC).where(F.col("_next") - F.col("second") > F.col("_threshold"))
    extra = gaps.select(*REC, F.explode(F.sequence(F.col("second") + F.col("_fill"), F.col("_next") - 1, F.col("_fill"))).alias("second"))
    return planned(tuned).unionByName(extra)


def sampling_stats(frames: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts per reason and reduction in percent for every recording."""
    originals = frames.groupBy(*REC).agg(F.count("*").alias("original"))
    reason = F.col("reason")
    kept = samples.groupBy(*REC).agg(
        F.count("*").alias("sampled"),
        *[F.count_if(reason == r).alias(r) for r in ("base", "gap_fill", "scene_change")],
    )
    rows = originals.join(kept, REC, "left").na.fill(0)
    return rows.withColumn("reduction_percent", half_up((1 - F.col("sampled") / F.greatest("original", F.lit(1))) * 100))


def hash_delta(frames: DataFrame, keys: Sequence[str] = ("display_id",), *, width: float = ordered.CHUNK_SECONDS) -> DataFrame:
    """Differing bits to the previous frame of the display; null for the first."""
    rows = ordered.carry(frames, keys, ORDER, {"_prev": F.col("phash")}, width=width)
    return rows.withColumn("delta", hamming(F.col("phash"), F.col("_prev"))).drop("_prev")


def churn(frames: DataFrame, threshold: int = 4, window: float = 60.0, limit: int = 40, *, keys: Sequence[str] = ("display_id",)) -> DataFrame:
    """Number of large changes in the last ``window`` seconds and whether capture is throttled."""
    moved = F.coalesce(F.col("delta") > threshold, F.lit(False))
    width = max(ordered.CHUNK_SECONDS, window)  # at most one halo copy per row
    rows = ordered.trailing_count(hash_delta(frames, keys), keys, "timestamp", moved, window, "changes", width=width)
    return rows.withColumn("throttled", F.col("changes") > limit)


def _guard(frames: DataFrame, throttled: Column, keys: Sequence[str], threshold: int, interval: float, width: float) -> DataFrame:
    """Drop near duplicates of the last kept frame; under churn keep at most one frame per interval."""
    rows = frames.select(*keys, *ORDER, "phash", F.coalesce(throttled, F.lit(False)).alias("_throttled"))
    rule = Different("timestamp", "phash", "_throttled", threshold, interval)
    return kept_path(rows, keys, ORDER, ["phash", "_throttled"], rule, lambda kept, first: np.ones(len(kept), bool), _out(frames, keys), width=width)


def drop_near_duplicates(
    frames: DataFrame, threshold: int = 4, *, keys: Sequence[str] = ("display_id",), width: float = ordered.CHUNK_SECONDS
) -> DataFrame:
    """Frames that differ in more than ``threshold`` bits from the last kept one of the display.

    A frame without a hash differs from every other.
    """
    return _guard(frames, F.lit(False), list(keys), threshold, 0.0, width)


def throttle(
    frames: DataFrame, interval: float = 30.0, threshold: int = 4, window: float = 60.0, limit: int = 40, *,
    keys: Sequence[str] = ("display_id",), width: float = ordered.CHUNK_SECONDS,
) -> DataFrame:
    """Near-duplicate drop, and while the picture churns at most one kept frame per ``interval``."""
    watched = churn(frames, threshold, window, limit, keys=keys)
    return _guard(watched, F.col("throttled"), list(keys), threshold, interval, max(width, SPANNED * interval))


def similarity_pairs(hashes: DataFrame, max_dist: int = 4) -> DataFrame:
    """Pairs of distinct hashes at most ``max_dist`` bits apart, with the number of frames behind each.

    Copies are counted first, so a group of identical frames is one row. The hash is cut into
    ``max_dist + 2`` bands of every so many-th bit; two hashes within the distance agree in at least two of them,
    and the join key is the bits of a pair of bands. A pair is accepted only under its first two equal bands, so
    nothing is found twice. A hash becomes one row per pair of bands, so rows carry the hash and the number of
    the pair, from which keys follow, and both sides read one shuffle. The sides are merged: estimates do not see
    that rows multiply, so a side that is far too large for it would be broadcast.
    """
    bands = max_dist + 2
    bits = [sum(1 << b for b in range(64) if b % bands in pair) for pair in combinations(range(bands), 2)]
    masks = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in bits]
    copies = hashes.groupBy("phash").agg(F.count("*").alias("frames"))
    keyed = copies.select("phash", "frames", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("use"))
    a, b = (keyed.select(*[F.col(c).alias(f"{name}_{side}") for c, name in (("phash", "hash"), ("frames", "frames"), ("use", "_use"))]) for side in "ab")
    key_a, key_b = (F.col(f"hash_{side}").bitwiseAND(F.get(F.array(*masks), F.col(f"_use_{side}"))) for side in "ab")
    near = a.join(b.hint("merge"), (key_a == key_b) & (F.col("_use_a") == F.col("_use_b"))).where("hash_a < hash_b")
    near = near.withColumn("distance", hamming(F.col("hash_a"), F.col("hash_b"))).where(F.col("distance") <= max_dist)
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, F.lit(n)) for n, m in enumerate(masks)])
    return near.where(first == F.col("_use_a")).select("hash_a", "hash_b", "frames_a", "frames_b", "distance")


def scenario_stats(log: DataFrame) -> DataFrame:
    """Frames, idle share and distance ranges of a hash log per scenario; ranges over complete frames."""
    complete = F.col("sc_status") == "complete"
    idle = F.count_if(F.col("sc_status") == "idle")
    measures = [
        f(F.when(complete, F.col(c))).alias(f"{name}_{c}")
        for c in ("phash_hamming", "dhash_hamming", "vn_distance")
        for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))
    ]
    return log.groupBy("scenario").agg(
        F.count("*").alias("frames"),
        idle.alias("idle"),
        F.floor(idle * 100 / F.count("*")).cast("long").alias("idle_percent"),
        F.count_if(complete).alias("complete"),
        *measures,
    )


def frame_hashes(log: DataFrame) -> DataFrame:
    """Hash log with the perceptual hashes as bigints."""
    return log.withColumn("phash", hash_from_hex(F.col("phash_hex"))).withColumn("dhash", hash_from_hex(F.col("dhash_hex")))
