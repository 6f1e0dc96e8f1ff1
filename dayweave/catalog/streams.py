"""Streaming forms, fed from the given tables and consumed until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dayweave.catalog.base import Tables, prop_k, query
from dayweave.catalog.capture import guard_sql
from dayweave.catalog.finding import PATTERN
from dayweave.catalog.sessions import canonical_sql
from dayweave.session import ensure_checkpoint_dir
from dayweave.streaming import live

DELAY = 600


def one_table(name: str) -> str:
    """A pattern of one table, as a single file or a folder of them; a plain name of a file is no stream source."""
    return f"[{name[0]}]{name[1:]}.parquet"


def stream(t: Tables, name: str, event_time: str, delay: str = f"{DELAY} seconds"):
    schema = t.raw(name).schema
    return live.stream_rows(t.spark, t.sf_dir, schema, event_time, delay, glob=one_table(name))


def events(t: Tables):
    rows = stream(t, "events", "ts")
    k = prop_k()
    kind = F.col("event_type")
    return rows.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("recording_id"), F.col("ts").alias("at"), (F.unix_micros("ts") / F.lit(1e6)).alias("timestamp"),
        k.alias("k"), "value",
        F.when(kind == "click", "Writing Code").when(kind == "view", "Reading docs").when(kind == "signup", "Browsing web").when(kind == "purchase", "Deep  Work").alias("activity_type"),
    )


@query(
    "stream_closed_blocks",
    f"""SELECT recording_id, from_ts, to_ts, observation_count FROM user_blocks WHERE to_ts + 21600 <= (SELECT max(timestamp) FROM obs) - {DELAY}""",
)
def _(t: Tables):
    rows = live.flush(live.closed_blocks(events(t), "21600 seconds"))
    at = lambda c: (F.unix_micros(c) / F.lit(1e6))
    return rows.select("recording_id", at("from_at").alias("from_ts"), at("to_at").alias("to_ts"), "observation_count")


@query("stream_open_blocks", "SELECT recording_id, from_ts, to_ts, observation_count, block_no = max(block_no) OVER (PARTITION BY recording_id) AS is_open FROM user_blocks")
def _(t: Tables):
    live.use_keyed_state(t.spark)
    target = f"{ensure_checkpoint_dir(t.spark)}/open-{uuid.uuid4().hex}"

    def merge(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    live.flush_updates(live.open_blocks(events(t), 21600.0), merge)
    changes = t.spark.read.parquet(target)
    latest = F.max_by(F.struct("to_ts", "observation_count", "is_open"), "version")
    blocks = changes.groupBy("recording_id", "from_ts").agg(latest.alias("b")).where("b.observation_count > 0")
    return blocks.select("recording_id", "from_ts", "b.to_ts", "b.observation_count", "b.is_open")


@query(
    "stream_capture_guard",
    guard_sql("changes > 30", 12, 9000.0) + f" AND id IN (SELECT id FROM obs0 WHERE timestamp <= (SELECT max(timestamp) FROM obs0) - {DELAY})",
)
def _(t: Tables):
    live.use_keyed_state(t.spark)
    rows = events(t).select(
        "id", "at", (F.col("recording_id") % 20).alias("display_id"), "timestamp", (F.col("k") * F.lit(2654435761) + F.round(F.col("value") * 100).cast("long") * 40503).alias("phash")
    )
    return live.flush(live.capture_guard(rows, 12, 200000.0, 30, 9000.0)).select("id")


@query(
    "stream_run_fold",
    """SELECT id AS run_id, started_at, CASE WHEN id % 3 > 0 THEN started_at + 3600 END AS completed_at, CASE WHEN id % 3 > 0 THEN status ELSE 'running' END AS status
    FROM runs WHERE id % 3 > 0 OR started_at + 86400 < (SELECT least(max(started_at), max(started_at) FILTER (id % 3 > 0) + 3600) FROM runs) - 86400""",
)
def _(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    starts = stream(t, "orders", "o_orderdate", "1 day").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"))
    raw = t.spark.readStream.schema(t.raw("orders").schema).parquet(f"{t.sf_dir.rstrip('/')}/{one_table('orders')}").where("o_orderkey % 3 > 0")
    ends = raw.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("at"), status.alias("status"), F.lit(3600000).alias("duration_ms")
    ).withWatermark("at", "1 day")
    rows = live.flush(live.fold_runs(starts, ends))
    at = lambda c: (F.unix_micros(c) / F.lit(1e6))
    return rows.select("run_id", at("started_at").alias("started_at"), at("completed_at").alias("completed_at"), "status")


@query("stream_unique", "SELECT DISTINCT recording_id, floor(timestamp / 86400) AS day, k % 5 AS part FROM obs0")
def _(t: Tables):
    rows = stream(t, "events", "ts", "2 days").select(
        F.col("user_id").alias("recording_id"), F.date_trunc("day", "ts").alias("day_at"), (prop_k() % 5).alias("part"), "ts"
    )
    seen = live.flush(live.unique_observations(rows, ("recording_id", "day_at", "part")))
    return seen.select("recording_id", F.floor(F.unix_micros("day_at") / 86400e6).cast("double").alias("day"), "part")


@query("stream_resumed", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS part FROM orders")
def _(t: Tables):
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/arriving-{uuid.uuid4().hex}"
    orders = t.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).cast("int").alias("part"))
    for part in (0, 1):
        # What arrives between two runs of a stream is consumed by the second one, and nothing twice.
        orders.where(F.col("part") == part).write.mode("append").parquet(f"{folder}/in")
        rows = live.flush(t.spark.readStream.schema(orders.schema).parquet(f"{folder}/in"), path=f"{folder}/out")
    return rows


@query(
    "stream_activity",
    f"""SELECT CAST(epoch(d) AS DOUBLE) AS window_start, activity, count(*) AS observations FROM (SELECT time_bucket(INTERVAL 6 HOUR, make_timestamp(CAST(timestamp * 1000000 AS BIGINT))) AS d,
    {canonical_sql("coalesce(activity_type, 'other')")} AS activity FROM obs) GROUP BY 1, 2
    HAVING window_start + 21600 <= (SELECT max(timestamp) FROM obs) - {DELAY}""",
)
def _(t: Tables):
    rows = live.flush(live.activity_digest(events(t), "6 hours"))
    return rows.select((F.unix_micros("window_start") / F.lit(1e6)).alias("window_start"), "activity", "observations")


@query(
    "stream_apps",
    f"""SELECT CAST(epoch(d) AS DOUBLE) AS window_start, app, count(*) AS observations FROM (SELECT time_bucket(INTERVAL 6 HOUR, make_timestamp(CAST(timestamp * 1000000 AS BIGINT))) AS d,
    unnest(list_distinct([CASE event_type WHEN 'click' THEN 'chrome' WHEN 'view' THEN 'Slack' ELSE event_type END, event_type])) AS app
    FROM (SELECT epoch(ts) AS timestamp, event_type FROM events)) GROUP BY 1, 2 HAVING window_start + 21600 <= (SELECT max(epoch(ts)) FROM events) - {DELAY}""",
)
def _(t: Tables):
    kind = F.col("event_type")
    app = F.when(kind == "click", "chrome").when(kind == "view", "Slack").otherwise(kind)
    rows = stream(t, "events", "ts").select(F.col("ts").alias("at"), F.array(app, kind).alias("apps"))
    found = live.flush(live.app_digest(rows, "6 hours"))
    return found.select((F.unix_micros("window_start") / F.lit(1e6)).alias("window_start"), "app", "observations")


@query("stream_index", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '{PATTERN}')) AS term FROM documents) GROUP BY 1, 2")
def _(t: Tables):
    raw = t.spark.readStream.schema(t.raw("documents").schema).parquet(f"{t.sf_dir.rstrip('/')}/{one_table('documents')}")
    target = f"{ensure_checkpoint_dir(t.spark)}/index-{uuid.uuid4().hex}"
    live.index_batches(raw.select("doc_id", "text", F.current_timestamp().alias("at")), target, stems=False)
    return live.read_index(t.spark, target).postings.select("term", "doc_id", "tf")
