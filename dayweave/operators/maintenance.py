"""Table maintenance as set operations: every function returns the new content of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions.text import content_hash
from dayweave.plans.ordered import running_total


def dedup_observations(obs: DataFrame) -> DataFrame:
    """Keep the smallest id per recording, type, time and audio source; nulls are equal.

    The aggregate moves one id per group and is combined before the shuffle, so a large group of
    copies never meets in one task.
    """
    keep = obs.groupBy("recording_id", "type", "timestamp", "audio_source").agg(F.min("id").alias("id"))
    return obs.join(keep.select("id"), "id", "left_semi")


def enforce_audio_unique(obs: DataFrame) -> DataFrame:
    """Unique recording, time and source for audio rows; other rows are untouched.

    As in a unique index over audio rows of a recording, rows with a null in the key are all different.
    """
    key = ["recording_id", "timestamp", "audio_source"]
    bound = F.coalesce(F.col("type") == "audio", F.lit(False))
    for name in key:
        bound = bound & F.col(name).isNotNull()
    audio = obs.where(bound)
    keep = audio.groupBy(*key).agg(F.min("id").alias("id"))
    return audio.join(keep.select("id"), "id", "left_semi").unionByName(obs.where(~bound))


def _one_of_each(new: DataFrame, key: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One row per key of ``new``: the first or last by ``order``, then by the other columns.

    Picked by an aggregate that is combined before the shuffle. Keys that hold a null are all different, as
    in a unique index.
    """
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in new.columns if c not in key and c not in order])
    pick = F.max_by if last else F.min_by
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    one = new.where(whole).groupBy(*key).agg(pick(F.struct(*new.columns), rank).alias("_row")).select("_row.*")
    return one.unionByName(new.where(~whole))


def insert_or_ignore(base: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing keys win; of new rows that repeat a key the first by ``order`` does."""
    fresh = _one_of_each(new.select(base.columns), key, order, last=False)
    return base.unionByName(fresh.join(base.select(*key), list(key), "left_anti").select(base.columns))


def insert_or_replace(base: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """New keys win; of new rows that repeat a key the last by ``order`` does."""
    fresh = _one_of_each(new.select(base.columns), key, order, last=True)
    return base.join(new.select(*key), list(key), "left_anti").select(base.columns).unionByName(fresh)


def update_by_key(base: DataFrame, patch: DataFrame, key: Sequence[str], *, keep_on_null: bool = False) -> DataFrame:
    """Values of ``patch`` replace those of ``base``, nulls too; with ``keep_on_null`` a null keeps the old value.

    ``patch`` has one row per key.
    """
    changed = [c for c in patch.columns if c not in key]
    renamed = patch.select(*key, F.lit(True).alias("_met"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    new = lambda c: F.coalesce(f"_new_{c}", c) if keep_on_null else F.when(F.col("_met"), F.col(f"_new_{c}")).otherwise(F.col(c))
    values = [new(c).alias(c) if c in changed else F.col(c) for c in base.columns]
    return base.join(renamed, list(key), "left").select(*values)


def delete_cascade(tables: dict[str, DataFrame], recordings: DataFrame) -> dict[str, DataFrame]:
    """Remove the observations, blocks and subjects of ``recordings(id)`` together with their links."""
    gone = recordings.select(F.col("id").alias("recording_id"))
    left = {
        name: tables[name].join(gone, "recording_id", "left_anti")
        for name in ("observations", "topic_blocks", "subjects")
        if name in tables
    }
    if "subject_topic_blocks" in tables:
        dead = tables["subjects"].join(gone, "recording_id", "left_semi").select(F.col("id").alias("subject_id"))
        dead_blocks = tables["topic_blocks"].join(gone, "recording_id", "left_semi").select(F.col("id").alias("topic_block_id"))
        left["subject_topic_blocks"] = (
            tables["subject_topic_blocks"].join(dead, "subject_id", "left_anti").join(dead_blocks, "topic_block_id", "left_anti")
        )
    return left


def backfill_metadata(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Add a metadata key where it is missing; null and empty metadata become an object."""
    fields = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    added = F.map_concat(fields, F.create_map(F.lit(key), F.lit(value)))
    present = F.map_contains_key(fields, key)
    return runs.withColumn("metadata", F.when(present, F.col("metadata")).otherwise(F.to_json(added)))


FORMAT_LINKS = "array<struct<format string, url string, contentHash string>>"


def patch_format_links(links: Column, patch: Column) -> Column:
    """Replace the entry of the patch's format, or append it."""
    kept = F.filter(F.coalesce(links, F.array().cast(FORMAT_LINKS)), lambda x: x["format"] != patch["format"])
    return F.concat(kept, F.array(patch))


def changed_documents(new: DataFrame, published: DataFrame) -> DataFrame:
    """Documents whose content differs from the published hash of their format.

    ``published`` has one row per recording and format; a row with a null format is the older single
    link and is used where the format has none. Documents never published count as changed.
    """
    exact = published.where("format is not null").select("recording_id", "format", F.col("content_hash").alias("_exact"), F.lit(True).alias("_has"))
    legacy = published.where("format is null").select("recording_id", F.col("content_hash").alias("_legacy"))
    known = new.join(exact, ["recording_id", "format"], "left").join(legacy, "recording_id", "left")
    stored = F.when(F.col("_has"), F.col("_exact")).otherwise(F.col("_legacy"))
    return known.where(~content_hash(F.col("content")).eqNullSafe(stored)).drop("_exact", "_legacy", "_has")


def attempt_ledger(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Queue state per frame from its attempts: 0 pending, 1 done, 2 failed.

    A frame fails when another failure arrives after ``max_attempts`` earlier ones.
    """
    return (
        attempts.groupBy("frame_id")
        .agg(F.count_if(~F.col("ok")).alias("failures"), F.bool_or("ok").alias("_done"), F.max("at").alias("last_at"))
        .withColumn("state", F.when(F.col("_done"), 1).when(F.col("failures") > max_attempts, 2).otherwise(0))
        .drop("_done")
    )


def pending_backlog(frames: DataFrame) -> DataFrame:
    """Size and age range of the frames still to be described."""
    return frames.where("analyzed = 0").agg(
        F.count("*").alias("pending"), F.min("timestamp").alias("oldest_ts"), F.max("timestamp").alias("newest_ts")
    )


def oldest_pending(frames: DataFrame, n: int = 10) -> DataFrame:
    return frames.where("analyzed = 0").orderBy("timestamp", "id").limit(n)


def unclaimed(obs: DataFrame, n: int = 500) -> DataFrame:
    """Oldest described observations that belong to no block."""
    return obs.where("tb_id is null and vlm_description is not null").orderBy("timestamp", "id").limit(n)


def retention(frames: DataFrame, high: float, low: float) -> DataFrame:
    """Frames to delete: once the total exceeds ``high``, the oldest go until it is at most ``low``.

    The running size from the newest frame down is built from per-chunk sums, so the whole table is
    never sorted in one task.
    """
    total = frames.agg(F.sum("bytes")).scalar()
    sized = running_total(frames, [], ["timestamp", "id"], F.col("bytes"), "_kept", descending=True)
    return sized.where((total > high) & (F.col("_kept") > low)).drop("_kept")
