"""Stored tables and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.schemas import SORTED_BY, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema; filters and columns reach the parquet scan."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, *, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Write rows spread over even files, sorted by time inside, so that time ranges skip row groups."""
    columns = [F.col(f.split()[0]) for f in _fields(name)]
    rows = df.select(*columns)
    if name in SORTED_BY:
        lead = [c for c in ("recording_id", "display_id") if c in rows.columns][:1]
        rows = rows.repartitionByRange(*lead, SORTED_BY[name]).sortWithinPartitions(*partition_by, *lead, SORTED_BY[name])
    rows.write.mode(mode).partitionBy(*partition_by).parquet(f"{root}/{name}")


def _fields(name: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(TABLES[name])]


def write_documents(lines: DataFrame, path: str, keys: Sequence[str] = ("recording_id",), *, format_name: str = "card", buckets: int = 64) -> None:
    """Write report lines as text under ``format=.../bucket=...``; writing a format again replaces it.

    Every line starts with the keys of its document, tab-separated, so the many documents of a bucket share
    files. Inside a bucket the files in name order hold its documents one after another, each in order.
    Lines are spread by document and place, so a very long report fills several files instead of one task.
    """
    place = [*keys, "part", "n", "k", "at"]
    named = lines.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rows = named.repartitionByRange("bucket", *place).sortWithinPartitions("bucket", *place)
    text = F.concat_ws("\t", *[F.col(k).cast("string") for k in keys], "line")
    # The writer keeps this order because it starts with the folder column.
    rows.select("bucket", text.alias("value")).write.mode("overwrite").partitionBy("bucket").text(f"{path}/format={format_name}")


def artifact_rows(lines: DataFrame, created_at: float, keys: Sequence[str] = ("recording_id",), *, format_name: str = "card") -> DataFrame:
    """A row per written document: its id, type, file name, size and time."""
    size = lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum(F.length("line") + 1).alias("chars"))
    name = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(format_name), F.lit(int(created_at)).cast("string"))
    return size.select(*keys, name.alias("id"), F.lit(format_name).alias("type"), F.concat(name, F.lit(".md")).alias("file_name"), "lines", "chars", F.lit(float(created_at)).alias("created_at"))
