"""Streaming queries, run to the end of their input; the SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline import shared
from reefline.functions.expr import parse_time
from reefline.plans import proxies
from reefline.plans.q_depth import r6
from reefline.sources import logs
from reefline.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return jobs.read_events(spark, path if not path.endswith(".parquet") else f"{d}/events*.parquet", spark.read.parquet(path).schema)


def _flat(df: DataFrame) -> DataFrame:
    w = F.col("w")
    return r6(df.select(*[c for c in df.columns if c != "w"], w["start"].cast("timestamp_ntz").alias("w_start"), w["end"].cast("timestamp_ntz").alias("w_end")))


@query("""SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, time_bucket(INTERVAL 5 MINUTE, ts) AS w_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS w_end FROM events GROUP BY user_id, w_start, w_end""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _flat(jobs.run_once(jobs.tumbling(_events(spark, d)), spark, "complete", "tumbling"))


@query("""WITH k AS (SELECT unnest(range(4)) AS k), w AS (SELECT user_id, ts, value, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS w_start FROM events, k)
SELECT user_id, count(*)::BIGINT AS n, round(arg_max(value, ts) - arg_min(value, ts), 6) AS change, w_start, w_start + INTERVAL 2 HOUR AS w_end FROM w GROUP BY user_id, w_start""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _flat(jobs.run_once(jobs.sliding(_events(spark, d)), spark, "complete", "sliding"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 6) AS total, min(ts) AS w_start, max(ts) + INTERVAL 1 HOUR AS w_end FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _flat(jobs.run_once(jobs.sessions(_events(spark, d)), spark, "complete", "sessions"))


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    twice = _events(spark, d)
    both = twice.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return jobs.run_once(jobs.deduplicated(both).select("event_id", "user_id", "event_type"), spark, "append", "dedup")


_SEEN = "epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - 600000"


@query(f"""WITH e AS (SELECT user_id, event_id, ts, floor(value / 10)::BIGINT AS gp, lag(floor(value / 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, CASE WHEN event_type = 'error' THEN 0.05 ELSE 0.000001 END AS std FROM events) SELECT user_id, event_id, gp FROM e WHERE gp = prev AND std < 0.00001 AND {_SEEN}""")
def stream_stateful_dup(spark: SparkSession, d: str) -> DataFrame:
    """All that the watermark has passed."""
    std = F.when(F.col("event_type") == "error", 0.05).otherwise(0.000001)
    return jobs.run_once(jobs.repeats(_events(spark, d), std=std), spark, "append", "repeats")


@query("""SELECT event_id, user_id FROM events WHERE hour(ts) BETWEEN 8 AND 17""")
def stream_daylight(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_once(jobs.daylight(_events(spark, d)).select("event_id", "user_id"), spark, "append", "daylight")


@query("""SELECT 'U' || user_id % 10 AS project_id, 'Frames/F_' || event_id || '.npy' AS npy_file, ts AS time, floor(value * 100)::BIGINT AS gp FROM events""")
def stream_log(spark: SparkSession, d: str) -> DataFrame:
    """Log lines written as text files by project, read as a stream, and their frame records."""
    path = shared.place(spark, "logs")
    proxies.log_lines(spark, d).repartition("project_id").write.partitionBy("project_id").text(path)
    lines = jobs.log_stream(spark, f"{path}/*/*.txt")
    fields = logs.fields_of(F.col("value"))
    rows = lines.where(F.col("value").startswith("FrameCaptured:")).select(F.regexp_replace("project_id", "^project_id=", "").alias("project_id"), fields.alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return jobs.run_once(rows.select("project_id", get("NpyFile").alias("npy_file"), parse_time(get("Time")).alias("time"), get("GP").cast("bigint").alias("gp")), spark, "append", "log")


@query(None)
def stream_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The tracker as a stream over boxes that drift, a video for each supplier; tests hold it against the batch."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    frame = (F.col("l_orderkey") % 200).cast("int")
    boxes = x.groupBy(F.col("l_suppkey").cast("string").alias("base_name"), frame.alias("frame"), (F.col("l_partkey") % 8).alias("k")).agg(F.avg("l_discount").alias("s"), F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"))
    left, top = F.col("k") * 150.0 + F.col("frame") * 0.5 + F.col("q") / 5, F.col("k") * 90.0 + F.col("frame") * 0.25 + F.col("t") * 50
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame") * 60)
    made = shared.written(boxes.select("base_name", "frame", ts.alias("ts"), left.alias("x1"), top.alias("y1"), (left + 60).alias("x2"), (top + 40).alias("y2"), (1 - F.col("s")).alias("score"), (F.col("k") % 2).cast("double").alias("class_id")), "boxes")
    stream = spark.readStream.schema(made.schema).parquet(made.inputFiles()[0].rsplit("/", 1)[0])
    return jobs.run_once(jobs.online_tracks(stream), spark, "append", "tracks")


@query("""SELECT user_id, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 25 MINUTE""")
def stream_silence(spark: SparkSession, d: str) -> DataFrame:
    """The last report of each key: all that fell silent before the watermark's end."""
    rows = jobs.run_once(jobs.silence_alerts(_events(spark, d)), spark, "append", "silence")
    return rows.groupBy("user_id").agg(F.max("last_us").alias("last_us"))
