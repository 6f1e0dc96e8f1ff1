"""Views of the given tables in the shapes the operators expect, for Spark and as oracle SQL.

Every view is a projection of one given table, so the work of a query grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle SQL, which may name any view."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def with_views(sql: str) -> str:
    """Prefix the SQL with the views it uses, directly or through other views."""
    order: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in VIEWS and name not in order:
                add(re.sub(rf"\b{name}\b", "", VIEWS[name]))
                if name not in order:
                    order.append(name)

    add(sql)
    if not order:
        return sql
    clause = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {clause}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {clause}, {body[5:]}"
    return f"WITH {clause} {body}"


def oracles() -> dict[str, str]:
    """Oracle SQL of all registered queries, complete with their views."""
    return {name: with_views(sql) for name, sql in ORACLES.items()}


def seconds(column: str):
    """Epoch seconds of a timestamp column."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def prop_k():
    """The only property of an event, ``{"k": number}``."""
    return F.btrim(F.substring_index("props", ":", -1), F.lit(" }")).cast("long")


# The application names observations of the test tables mention.
APP_NAMES = ["VSCode", "Slack", "WhatsApp", "chrome", "Terminal", "Discord", "and more", "Figma"]
SECOND_APPS = ["Zoom", "a", "Ghosty"]

VIEWS["obs0"] = (
    "SELECT event_id AS id, user_id AS recording_id, epoch_us(ts) / 1e6 AS timestamp, event_type, value,"
    " CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events"
)
VIEWS["obs"] = (
    "SELECT id, recording_id, timestamp, value, k, 'visual' AS type, CAST(NULL AS DOUBLE) AS end_timestamp,"
    " CASE WHEN k % 2 = 0 THEN id END AS frame_id,"
    " CASE event_type WHEN 'click' THEN 'Writing Code' WHEN 'view' THEN 'Reading docs' WHEN 'signup' THEN 'Browsing web'"
    " WHEN 'purchase' THEN 'Deep  Work' END AS activity_type,"
    " CASE WHEN k % 23 = 0 THEN NULL ELSE 'Fixing bug ' || k || ' in ' || ['VSCode','Slack','WhatsApp','chrome','Terminal','Discord','and more','Figma'][k % 8 + 1] END AS vlm_description,"
    " [['VSCode','Slack','WhatsApp','chrome','Terminal','Discord','and more','Figma'][k % 8 + 1],"
    " ['Zoom','a','Ghosty'][k % 3 + 1]] AS apps,"
    " ['topic ' || (k % 7), 'x'] AS topics, CASE WHEN k % 5 = 0 THEN 'spoken ' || k END AS text,"
    " CAST(NULL AS VARCHAR) AS audio_source, CASE WHEN k % 4 = 0 THEN k END AS tb_id FROM obs0"
)
VIEWS["frames"] = (
    "SELECT id, recording_id, recording_id % 20 AS display_id, timestamp, timestamp + 0.5 AS captured_ts,"
    " (k * 2654435761 + CAST(value * 100 AS BIGINT) * 40503) AS phash, CAST(value * 1000 AS BIGINT) AS bytes,"
    " CAST(k % 3 AS INTEGER) AS analyzed FROM obs0"
)
VIEWS["blocks"] = (
    "SELECT id, recording_id, timestamp AS from_ts, timestamp + value * 60 AS to_ts, value * 60 AS duration,"
    " k % 9 AS observation_count, timestamp AS created_at, activity_type, vlm_description AS key_description,"
    " apps, topics FROM obs"
)
VIEWS["audio"] = (
    "SELECT conv_id * 1000 + turn AS id, conv_id AS recording_id, 'audio' AS type,"
    " CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS audio_source, text,"
    " CAST(turn * 10 AS DOUBLE) AS timestamp, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE CAST(turn * 10 AS DOUBLE) + length(text) / 20 END AS end_timestamp"
    " FROM conversations"
)
VIEWS["segs"] = (
    "SELECT id, recording_id, audio_source AS source, id AS seg_id, timestamp AS start,"
    " coalesce(end_timestamp, timestamp + 5) AS \"end\", text FROM audio"
)
VIEWS["windows"] = (
    "SELECT recording_id, id AS segment_id, timestamp + 3 AS start_time, timestamp + 3 + length(text) % 40 AS end_time FROM audio"
)
VIEWS["recs"] = (
    "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'raw' WHEN 'MACHINERY' THEN 'processing'"
    " WHEN 'HOUSEHOLD' THEN 'error' WHEN 'AUTOMOBILE' THEN 'processed' ELSE 'published' END AS status,"
    " abs(c_acctbal) AS duration, CAST(788918400 + c_custkey % 1000 * 86400 AS DOUBLE) AS captured_at,"
    " '{\"outline\": {\"url\": \"doc/' || c_custkey || '\"}}' AS source_metadata FROM customer"
)
VIEWS["runs"] = (
    "SELECT o_orderkey AS id, o_custkey AS recording_id,"
    " CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,"
    " epoch_us(o_orderdate) / 1e6 AS started_at,"
    " CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE epoch_us(o_orderdate) / 1e6 + floor(o_totalprice) END AS completed_at,"
    " CAST(floor(o_totalprice * 10) AS BIGINT) AS total_duration_ms,"
    " CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '{\"llm_backend\":\"b' || (o_orderkey % 4) || '\",\"llm_model\":\"m' || (o_orderkey % 3) || '\"}' END AS metadata"
    " FROM orders"
)
VIEWS["stats"] = (
    "SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_orderkey AS run_id,"
    " CASE l_returnflag WHEN 'A' THEN 'vlm-batch-inference' WHEN 'N' THEN 'segmentation' ELSE 'alignment' END AS phase,"
    " CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'failed' END AS status, epoch_us(l_shipdate) / 1e6 AS started_at,"
    " CAST(l_quantity * 1000 AS BIGINT) AS duration_ms, CAST(floor(l_extendedprice) AS BIGINT) AS items_processed"
    " FROM lineitem"
)
VIEWS["arts"] = (
    "SELECT o_orderkey AS id, o_custkey AS recording_id,"
    " CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'summary' WHEN '2' THEN 'card' WHEN '3' THEN 'standup' ELSE 'narrative' END AS type,"
    " epoch_us(o_orderdate) / 1e6 + 3600 AS created_at FROM orders"
)


class Tables:
    """The given tables and their views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def obs0(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("recording_id"),
            seconds("ts").alias("timestamp"),
            "event_type",
            "value",
            prop_k().alias("k"),
        )

    def obs(self) -> DataFrame:
        k = F.col("k")
        app = F.element_at(F.array(*map(F.lit, APP_NAMES)), (k % 8 + 1).cast("int"))
        second = F.element_at(F.array(*map(F.lit, SECOND_APPS)), (k % 3 + 1).cast("int"))
        kind = F.col("event_type")
        return self.obs0().select(
            "id",
            "recording_id",
            "timestamp",
            "value",
            "k",
            F.lit("visual").alias("type"),
            F.lit(None).cast("double").alias("end_timestamp"),
            F.when(k % 2 == 0, F.col("id")).alias("frame_id"),
            F.when(kind == "click", "Writing Code").when(kind == "view", "Reading docs").when(kind == "signup", "Browsing web")
            .when(kind == "purchase", "Deep  Work").alias("activity_type"),
            F.when(k % 23 != 0, F.concat(F.lit("Fixing bug "), k, F.lit(" in "), app)).alias("vlm_description"),
            F.array(app, second).alias("apps"),
            F.array(F.concat(F.lit("topic "), k % 7), F.lit("x")).alias("topics"),
            F.when(k % 5 == 0, F.concat(F.lit("spoken "), k)).alias("text"),
            F.lit(None).cast("string").alias("audio_source"),
            F.when(k % 4 == 0, k).alias("tb_id"),
        )

    def frames(self) -> DataFrame:
        return self.obs0().select(
            "id",
            "recording_id",
            (F.col("recording_id") % 20).alias("display_id"),
            "timestamp",
            (F.col("timestamp") + 0.5).alias("captured_ts"),
            (F.col("k") * F.lit(2654435761) + F.round(F.col("value") * 100).cast("long") * 40503).alias("phash"),
            F.round(F.col("value") * 1000).cast("long").alias("bytes"),
            (F.col("k") % 3).cast("int").alias("analyzed"),
        )

    def blocks(self) -> DataFrame:
        return self.obs().select(
            "id",
            "recording_id",
            F.col("timestamp").alias("from_ts"),
            (F.col("timestamp") + F.col("value") * 60).alias("to_ts"),
            (F.col("value") * 60).alias("duration"),
            (F.col("k") % 9).alias("observation_count"),
            F.col("timestamp").alias("created_at"),
            "activity_type",
            F.col("vlm_description").alias("key_description"),
            "apps",
            "topics",
        )

    def audio(self) -> DataFrame:
        length = F.length("text")
        start = F.col("turn") * F.lit(10.0)
        return self.raw("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("recording_id"),
            F.lit("audio").alias("type"),
            F.when(F.col("role") == "user", "mic").otherwise("system").alias("audio_source"),
            "text",
            start.alias("timestamp"),
            F.when(length % 7 != 0, start + length / 20.0).alias("end_timestamp"),
        )

    def segs(self) -> DataFrame:
        return self.audio().select(
            "id",
            "recording_id",
            F.col("audio_source").alias("source"),
            F.col("id").alias("seg_id"),
            F.col("timestamp").alias("start"),
            F.coalesce("end_timestamp", F.col("timestamp") + 5).alias("end"),
            "text",
        )

    def windows(self) -> DataFrame:
        start = F.col("timestamp") + 3
        return self.audio().select(
            "recording_id", F.col("id"), start.alias("start_time"), (start + F.length("text") % 40).alias("end_time")
        )

    def recs(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.when(segment == "BUILDING", "raw").when(segment == "MACHINERY", "processing").when(segment == "HOUSEHOLD", "error")
            .when(segment == "AUTOMOBILE", "processed").otherwise("published").alias("status"),
            F.abs("c_acctbal").alias("duration"),
            (F.lit(788918400.0) + F.col("c_custkey") % 1000 * 86400).alias("captured_at"),
            F.concat(F.lit('{"outline": {"url": "doc/'), F.col("c_custkey"), F.lit('"}}')).alias("source_metadata"),
        )

    def runs(self) -> DataFrame:
        key, start = F.col("o_orderkey"), seconds("o_orderdate")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("recording_id"),
            F.when(status == "F", "completed").when(status == "P", "failed").otherwise("running").alias("status"),
            start.alias("started_at"),
            F.when(key % 5 != 0, start + F.floor("o_totalprice")).alias("completed_at"),
            F.floor(F.col("o_totalprice") * 10).cast("long").alias("total_duration_ms"),
            F.when(
                key % 3 != 0,
                F.concat(F.lit('{"llm_backend":"b'), key % 4, F.lit('","llm_model":"m'), key % 3, F.lit('"}')),
            ).alias("metadata"),
        )

    def stats(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("run_id"),
            F.when(flag == "A", "vlm-batch-inference").when(flag == "N", "segmentation").otherwise("alignment").alias("phase"),
            F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"),
            seconds("l_shipdate").alias("started_at"),
            (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
            F.floor("l_extendedprice").cast("long").alias("items_processed"),
        )

    def arts(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("recording_id"),
            F.when(first == "1", "summary").when(first == "2", "card").when(first == "3", "standup").otherwise("narrative").alias("type"),
            (seconds("o_orderdate") + 3600).alias("created_at"),
        )
