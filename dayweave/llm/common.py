"""Small helpers the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.session import prepare, stored  # noqa: F401


#: Rows of an Arrow batch: whole texts of any length travel in them, so they are fewer than Spark's default.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by a session that is set for whole texts in Arrow batches."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def hash_share(key: Column, share: Column) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1_000_000)) < share * 1_000_000
