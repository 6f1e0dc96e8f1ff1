"""One vocabulary of application names over all records."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.functions.text import canonical_app, is_noise_app, name_similarity, trim_blank
from dayweave.plans.graphs import first_independent

SIMILAR = 0.85


def _errors(longer: int) -> int:
    """Edits two similar names may differ in, by the length of the longer one."""
    return math.floor((1 - SIMILAR) * longer + 1e-9)


def _pieces(length: int) -> list[tuple[int, int]]:
    """Even cuts of a name into one piece more than the edits a longer partner may have."""
    n = _errors(math.floor(length / SIMILAR + 1e-9)) + 1
    edges = [length * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _own_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda s: [f"{len(s)}|{i}|{s[a:b]}" for i, (a, b) in enumerate(_pieces(len(s)))])


def _probe_keys(names: pd.Series) -> pd.Series:
    """Pieces a shorter or equally long similar name would have to share."""

    def probes(s: str) -> list[str]:
        edits, keys = _errors(len(s)), set()
        for length in range(len(s) - edits, len(s) + 1):
            for i, (a, b) in enumerate(_pieces(length)):
                for start in range(max(0, a - edits), min(len(s) - (b - a), a + edits) + 1):
                    keys.add(f"{length}|{i}|{s[start:start + b - a]}")
        return sorted(keys)

    return names.map(probes)


def similar_names(names: DataFrame) -> DataFrame:
    """Pairs of different names at least 85 % similar, ``(name_a, name_b)`` in both directions.

    Two names within the allowed edits share one undamaged piece, so pairs come from a join on pieces.
    """
    strings = T.ArrayType(T.StringType())
    low = names.select("name", F.lower("name").alias("low"))
    own = low.select(F.col("name").alias("name_a"), F.explode(F.pandas_udf(_own_keys, strings)("low")).alias("key"))
    probe = low.select(F.col("name").alias("name_b"), F.explode(F.pandas_udf(_probe_keys, strings)("low")).alias("key"))
    found = own.join(probe, "key").where("name_a <> name_b").select("name_a", "name_b").distinct()
    found = found.where(name_similarity(F.col("name_a"), F.col("name_b")) >= SIMILAR)
    return found.unionByName(found.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"))).distinct()


def app_vocabulary(apps: DataFrame) -> DataFrame:
    """Mapping ``(raw, name)`` of all raw names; ``apps`` is ``(raw, seen)`` with the first place of use.

    Names are accepted shortest raw form first, then by first use; one similar to an accepted name is
    replaced by it, by the alphabetically first if there are several. Noise maps to null.
    """
    raws = apps.groupBy("raw").agg(F.min("seen").alias("seen")).withColumn("name", canonical_app(F.col("raw")))
    usable = raws.where((trim_blank(F.col("raw")) != "") & ~is_noise_app(F.col("name")))
    ranked = usable.groupBy("name").agg(F.min(F.struct(F.length("raw").alias("n"), "seen")).alias("rank")).checkpoint()
    pairs = similar_names(ranked).checkpoint()
    rank = lambda side: ranked.select(F.col("name").alias(side), F.col("rank").alias(f"_{side}"))
    ordered = pairs.join(rank("name_a"), "name_a").join(rank("name_b"), "name_b").where("_name_a < _name_b")
    nodes = ranked.select(F.col("name").alias("node"), "rank")
    accepted = first_independent(nodes, ordered.select(F.col("name_a").alias("earlier"), F.col("name_b").alias("later"))).select(F.col("node").alias("kept"))
    joined = pairs.join(accepted, pairs.name_b == accepted.kept).groupBy(F.col("name_a").alias("name")).agg(F.min("kept").alias("kept"))
    final = accepted.select(F.col("kept").alias("name"), "kept").unionByName(joined.join(accepted.select(F.col("kept").alias("name")), "name", "left_anti"))
    return raws.select("raw", "name").join(final, "name", "left").select("raw", F.col("kept").alias("name"))


def normalize_apps_global(records: DataFrame, key: str = "id", *, order: Column | None = None) -> DataFrame:
    """Records with their application names replaced through one vocabulary, distinct and sorted."""
    from dayweave.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(records.sparkSession)
    place = F.col(key) if order is None else order
    used = records.select(key, place.alias("_place"), F.posexplode("apps").alias("_i", "raw"))
    mapping = app_vocabulary(used.select("raw", F.struct("_place", "_i").alias("seen")))
    named = used.select(key, "raw").join(mapping, "raw").where("name is not null")
    lists = named.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("apps"))
    return records.drop("apps").join(lists, key, "left").withColumn("apps", F.coalesce("apps", F.array().cast("array<string>")))
