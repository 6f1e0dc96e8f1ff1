"""Frame sampling and near-duplicate reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.functions import numbers
from dayweave.operators import frames

#: Events of one user lie hours apart, so the sampling steps are hours as well.
BASE, THRESHOLD, FILL = 50000.0, 80000.0, 7000.0

VIEWS["scenes"] = (
    "SELECT id * 4 + n AS id, recording_id, timestamp + 1234 + n * 3000 AS timestamp FROM obs0,"
    " (SELECT unnest([0, 1, 2, 3]) AS n) WHERE event_type = 'error' AND n <= CASE recording_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END"
)
VIEWS["n_scenes"] = "SELECT recording_id, count(*) AS n FROM scenes GROUP BY 1"
VIEWS["tuned"] = (
    "SELECT f.recording_id, f.id, f.timestamp, coalesce(n, 0) AS n,"
    f" CASE WHEN n > 50 THEN greatest({BASE}, 30) WHEN n > 20 THEN greatest({BASE}, 20) ELSE {BASE} END AS base"
    " FROM frames f LEFT JOIN n_scenes s USING (recording_id)"
)


def scenes(t: Tables):
    n = F.explode(F.sequence(F.lit(0), F.when(F.col("recording_id") % 3 == 0, 0).when(F.col("recording_id") % 3 == 1, 1).otherwise(3)))
    rows = t.obs0().where("event_type = 'error'").withColumn("n", n)
    return rows.select((F.col("id") * 4 + F.col("n")).alias("id"), "recording_id", (F.col("timestamp") + 1234 + F.col("n") * 3000).alias("timestamp"))


BASE_SAMPLES = f"""WITH RECURSIVE picked AS (SELECT recording_id, min(timestamp) AS timestamp FROM frames GROUP BY 1
    UNION ALL SELECT f.recording_id, min(f.timestamp) FROM picked p JOIN frames f ON f.recording_id = p.recording_id
    AND f.timestamp - p.timestamp >= {BASE} GROUP BY 1),
    samples AS (SELECT f.recording_id, f.id, f.timestamp, 'base' AS reason FROM frames f JOIN picked USING (recording_id, timestamp))"""


def fill_sql(threshold: str, fill: str) -> str:
    """Grid times inside the gaps of ``samples`` and the frame nearest to each."""
    return f"""gaps AS (SELECT s.recording_id, s.timestamp AS a, lead(s.timestamp) OVER (PARTITION BY s.recording_id ORDER BY s.timestamp, s.id) AS b,
    {threshold} AS threshold, {fill} AS fill FROM samples s JOIN tuned USING (recording_id, id)),
    grid AS (SELECT recording_id, a + fill * unnest(generate_series(1, CAST(floor((b - a) / fill - 1 + 1e-9) AS BIGINT))) AS t
    FROM gaps WHERE b - a > threshold),
    nearest AS (SELECT g.recording_id, g.t, arg_min(f.id, {{'d': abs(f.timestamp - g.t), 't': f.timestamp}}) AS id FROM grid g
    JOIN frames f ON f.recording_id = g.recording_id GROUP BY 1, 2),
    filled AS (SELECT DISTINCT recording_id, id, 'gap_fill' AS reason FROM nearest WHERE (recording_id, id) NOT IN (SELECT (recording_id, id) FROM samples))"""


@query("sample_base", f"{BASE_SAMPLES} SELECT recording_id, id, reason FROM samples")
def _(t: Tables):
    return frames.sample_base(t.frames(), BASE).select("recording_id", "id", "reason")


@query("gap_fill", f"{BASE_SAMPLES}, {fill_sql(str(THRESHOLD), str(FILL))} SELECT recording_id, id FROM filled")
def _(t: Tables):
    distinct = frames.one_per_timestamp(t.frames())
    samples = frames.sample_base(t.frames(), BASE)
    return frames.gap_fill(distinct, samples, F.lit(THRESHOLD), F.lit(FILL)).select("recording_id", "id")


@query(
    "adaptive_sample",
    f"""{BASE_SAMPLES}, {fill_sql(str(THRESHOLD), str(FILL))} SELECT recording_id, id, reason FROM samples
    UNION ALL SELECT recording_id, id, reason FROM filled""",
)
def _(t: Tables):
    return frames.adaptive_sample(t.frames(), BASE, THRESHOLD, FILL).select("recording_id", "id", "reason")


VIEWS["scene_frames"] = (
    "SELECT DISTINCT recording_id, id FROM (SELECT s.recording_id, s.timestamp,"
    " arg_min(f.id, {'d': abs(f.timestamp - s.timestamp), 't': f.timestamp}) AS id FROM scenes s"
    " JOIN frames f ON f.recording_id = s.recording_id GROUP BY 1, 2)"
)


@query("nearest_frames", """SELECT s.recording_id, s.timestamp AS target,
    arg_min(f.id, {'d': abs(f.timestamp - s.timestamp), 't': f.timestamp}) AS id FROM scenes s
    JOIN frames f ON f.recording_id = s.recording_id GROUP BY 1, 2""")
def _(t: Tables):
    return frames.nearest_frames(t.frames(), scenes(t)).select("recording_id", "target", "id").distinct()


SCENE_SAMPLES = f"""WITH RECURSIVE walk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp, id) AS i,
    (recording_id, id) IN (SELECT (recording_id, id) FROM scene_frames) AS scene FROM tuned),
    clock AS (SELECT recording_id, id, i, timestamp AS last, false AS taken FROM walk WHERE i = 1 UNION ALL
    SELECT w.recording_id, w.id, w.i, CASE WHEN w.scene OR w.timestamp - c.last >= w.base THEN w.timestamp ELSE c.last END,
    NOT w.scene AND w.timestamp - c.last >= w.base FROM clock c JOIN walk w ON w.recording_id = c.recording_id AND w.i = c.i + 1),
    samples AS (SELECT w.recording_id, w.id, w.timestamp, CASE WHEN w.scene THEN 'scene_change' ELSE 'base' END AS reason
    FROM walk w JOIN clock c USING (recording_id, id) WHERE w.scene OR c.taken),
    {fill_sql(f"CASE WHEN n > 50 THEN greatest({THRESHOLD}, 60) WHEN n > 20 THEN greatest({THRESHOLD}, 40) ELSE {THRESHOLD} END",
              f"CASE WHEN n > 50 THEN greatest({FILL}, 10) WHEN n > 20 THEN greatest({FILL}, 5) ELSE {FILL} END")}"""


@query(
    "sample_with_scenes",
    f"{SCENE_SAMPLES} SELECT recording_id, id, reason FROM samples UNION ALL SELECT recording_id, id, reason FROM filled",
)
def _(t: Tables):
    found = frames.sample_with_scenes(t.frames(), scenes(t), BASE, THRESHOLD, FILL)
    return found.select("recording_id", "id", "reason")


@query(
    "sampling_stats",
    f"""{BASE_SAMPLES}, {fill_sql(str(THRESHOLD), str(FILL))}, taken AS (SELECT recording_id, reason FROM samples UNION ALL
    SELECT recording_id, reason FROM filled)
    SELECT f.recording_id, f.n AS original, s.n AS sampled, s.base, s.gap_fill, s.scene_change,
    CAST(floor((1 - s.n / f.n) * 100 + 0.5) AS BIGINT) AS reduction_percent FROM (SELECT recording_id, count(*) AS n FROM frames GROUP BY 1) f
    JOIN (SELECT recording_id, count(*) AS n, count(*) FILTER (reason = 'base') AS base, count(*) FILTER (reason = 'gap_fill') AS gap_fill,
    count(*) FILTER (reason = 'scene_change') AS scene_change FROM taken GROUP BY 1) s USING (recording_id)""",
)
def _(t: Tables):
    return frames.sampling_stats(t.frames(), frames.adaptive_sample(t.frames(), BASE, THRESHOLD, FILL))


@query(
    "scene_dedup",
    """WITH RECURSIVE picked AS (SELECT recording_id, min(timestamp) AS ts FROM scenes GROUP BY 1
    UNION ALL SELECT f.recording_id, min(f.timestamp) FROM picked p JOIN scenes f ON f.recording_id = p.recording_id
    AND f.timestamp - p.ts >= 8000 GROUP BY 1) SELECT recording_id, ts FROM picked""",
)
def _(t: Tables):
    return frames.scene_dedup(scenes(t), 8000.0).select("recording_id", F.col("timestamp").alias("ts"))


@query(
    "adaptive_interval",
    """SELECT recording_id, n, CAST(CASE WHEN n > 50 THEN 30 WHEN n > 20 THEN 20 ELSE 10 END AS INTEGER) AS base,
    CAST(CASE WHEN n > 50 THEN 60 WHEN n > 20 THEN 40 ELSE 15 END AS INTEGER) AS threshold,
    CAST(CASE WHEN n > 50 THEN 10 WHEN n > 20 THEN 5 ELSE 3 END AS INTEGER) AS fill FROM n_scenes""",
)
def _(t: Tables):
    n = F.col("n")
    counts = scenes(t).groupBy("recording_id").agg(F.count("*").alias("n"))
    return counts.select(
        "recording_id", "n", frames.adaptive_interval(n, F.lit(10)).alias("base"),
        frames.adaptive_threshold(n, F.lit(15)).alias("threshold"), frames.adaptive_fill(n, F.lit(3)).alias("fill"),
    )


VIEWS["cuts"] = (
    "SELECT o_orderkey * 5 + n AS id, o_custkey AS recording_id, o_totalprice / 40 + n * 17.25 AS timestamp FROM orders,"
    " (SELECT unnest([0, 1, 2, 3, 4]) AS n) WHERE n <= o_custkey % 5"
)


def cuts(t: Tables):
    key = F.col("o_custkey")
    rows = t.raw("orders").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), key % 5)))
    return rows.select(
        (F.col("o_orderkey") * 5 + F.col("n")).alias("id"), key.alias("recording_id"), (F.col("o_totalprice") / 40 + F.col("n") * 17.25).alias("timestamp")
    )


@query(
    "required_timestamps",
    """WITH sized AS (SELECT r.id AS recording_id, r.duration, coalesce(c.n, 0) AS n FROM recs r LEFT JOIN (SELECT recording_id, count(*) AS n FROM cuts
    GROUP BY 1) c ON c.recording_id = r.id WHERE r.duration > 0),
    rules AS (SELECT *, CASE WHEN n > 50 THEN 30 WHEN n > 20 THEN 20 ELSE 10 END AS base, CASE WHEN n > 50 THEN 60 WHEN n > 20 THEN 40 ELSE 15 END AS threshold,
    CASE WHEN n > 50 THEN 10 WHEN n > 20 THEN 5 ELSE 3 END AS fill FROM sized),
    plan AS (SELECT recording_id, unnest(generate_series(0, CAST(floor(duration) AS BIGINT), base)) AS second FROM rules UNION
    SELECT c.recording_id, CAST(floor(c.timestamp + 0.5) AS BIGINT) FROM cuts c JOIN rules r USING (recording_id) WHERE floor(c.timestamp + 0.5) <= r.duration),
    gaps AS (SELECT p.*, lead(second) OVER (PARTITION BY recording_id ORDER BY second) AS nx FROM plan p)
    SELECT recording_id, second FROM plan UNION ALL SELECT recording_id, unnest(generate_series(second + fill, nx - 1, fill)) FROM gaps
    JOIN rules USING (recording_id) WHERE nx - second > threshold""",
)
def _(t: Tables):
    return frames.required_timestamps(t.recs(), cuts(t))


@query("hamming", "SELECT id, CAST(bit_count(xor(phash, id * 7919)) AS INTEGER) AS bits FROM frames")
def _(t: Tables):
    return t.frames().select("id", numbers.hamming(F.col("phash"), F.col("id") * 7919).alias("bits"))


VIEWS["deltas"] = (
    "SELECT id, display_id, timestamp, phash, bit_count(xor(phash, lag(phash) OVER (PARTITION BY display_id ORDER BY timestamp, id))) AS delta FROM frames"
)


@query("hash_delta", "SELECT id, CAST(delta AS INTEGER) AS delta FROM deltas")
def _(t: Tables):
    return frames.hash_delta(t.frames()).select("id", "delta")


VIEWS["churned"] = (
    "SELECT *, count(*) FILTER (delta > 12) OVER (PARTITION BY display_id ORDER BY timestamp RANGE BETWEEN 200000 PRECEDING AND CURRENT ROW) AS changes FROM deltas"
)


@query("churn", "SELECT id, changes, changes > 30 AS throttled FROM churned")
def _(t: Tables):
    return frames.churn(t.frames(), 12, 200000.0, 30).select("id", "changes", "throttled")


def guard_sql(throttled: str, bits: int, interval: float) -> str:
    return f"""WITH RECURSIVE walk AS (SELECT *, {throttled} AS thr, row_number() OVER (PARTITION BY display_id ORDER BY timestamp, id) AS i FROM churned),
    fold AS (SELECT display_id, i, id, phash AS kept, CASE WHEN thr THEN timestamp END AS held, true AS take FROM walk WHERE i = 1 UNION ALL
    SELECT display_id, i, id, CASE WHEN pass THEN phash ELSE kept END, CASE WHEN NOT thr THEN NULL WHEN pass THEN timestamp ELSE held END, pass FROM (SELECT *,
    fresh AND NOT (thr AND held IS NOT NULL AND timestamp - held < {interval}) AS pass FROM (SELECT w.*, f.kept, CASE WHEN w.thr THEN f.held END AS held,
    bit_count(xor(w.phash, f.kept)) > {bits} AS fresh FROM fold f JOIN walk w ON w.display_id = f.display_id AND w.i = f.i + 1)))
    SELECT id FROM fold WHERE take"""


@query("drop_near_duplicates", guard_sql("false", 12, 0.0))
def _(t: Tables):
    return frames.drop_near_duplicates(t.frames(), 12).select("id")


@query("throttle", guard_sql("changes > 30", 12, 9000.0))
def _(t: Tables):
    return frames.throttle(t.frames(), 9000.0, 12, 200000.0, 30).select("id")


@query(
    "fingerprint_median",
    """SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i] > m THEN CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (i - 1) END ELSE 0 END
    FOR i IN range(1, 65)]) AS BIGINT) AS phash FROM (SELECT *, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 AS m FROM embeddings)""",
)
def _(t: Tables):
    return t.raw("embeddings").select("vec_id", numbers.median_fingerprint(F.col("embedding")).alias("phash"))


@query(
    "fingerprint_gradient",
    """SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i + (i - 1) // 7] > embedding[i + (i - 1) // 7 + 1] THEN 1::HUGEINT << (i - 1) ELSE 0 END
    FOR i IN range(1, 57)]) AS BIGINT) AS phash FROM embeddings""",
)
def _(t: Tables):
    return t.raw("embeddings").select("vec_id", numbers.gradient_fingerprint(F.col("embedding"), 8, 8).alias("phash"))


# 63-bit hashes; three frames in a row share one but for two bits each.
VIEWS["hashes"] = "SELECT xor((id - id % 3) * 2654435761 % 1099511627689 * 8388607, CAST(3 AS BIGINT) << CAST(id % 3 * 9 AS INTEGER)) AS phash FROM obs0"


@query(
    "similarity_pairs",
    """WITH c AS (SELECT phash, count(*) AS frames FROM hashes GROUP BY 1) SELECT a.phash AS hash_a, b.phash AS hash_b, a.frames AS frames_a,
    b.frames AS frames_b, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance FROM c a JOIN c b ON a.phash < b.phash
    AND bit_count(xor(a.phash, b.phash)) <= 4""",
)
def _(t: Tables):
    low = F.col("id") % 3
    base = (F.col("id") - low) * F.lit(2654435761) % F.lit(1099511627689) * 8388607
    rows = t.obs0().select(base.bitwiseXOR(F.call_function("shiftleft", F.lit(3).cast("long"), (low * 9).cast("int"))).alias("phash"))
    return frames.similarity_pairs(rows, 4)


@query(
    "scenario_stats",
    """SELECT event_type AS scenario, count(*) AS frames, count(*) FILTER (k % 5 = 0) AS idle, CAST(floor(count(*) FILTER (k % 5 = 0) * 100 / count(*)) AS BIGINT) AS idle_percent,
    count(*) FILTER (k % 5 <> 0) AS complete, min(k) FILTER (k % 5 <> 0) AS min_hamming, max(k) FILTER (k % 5 <> 0) AS max_hamming,
    round(avg(k) FILTER (k % 5 <> 0), 4) AS avg_hamming, round(avg(value) FILTER (k % 5 <> 0), 4) AS avg_distance FROM obs0 GROUP BY 1""",
)
def _(t: Tables):
    log = t.obs0().select(
        F.col("event_type").alias("scenario"), F.when(F.col("k") % 5 == 0, "idle").otherwise("complete").alias("sc_status"),
        F.col("k").alias("phash_hamming"), F.col("k").alias("dhash_hamming"), F.col("value").alias("vn_distance"),
    )
    return frames.scenario_stats(log).select(
        "scenario", "frames", "idle", "idle_percent", "complete", F.col("min_phash_hamming").alias("min_hamming"), F.col("max_phash_hamming").alias("max_hamming"),
        F.round("avg_phash_hamming", 4).alias("avg_hamming"), F.round("avg_vn_distance", 4).alias("avg_distance"),
    )
