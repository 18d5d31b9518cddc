"""Views of the driver's tables in the shape of the engine's inputs, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES_PER_PROJECT = 250


def cells(spark: SparkSession, d: str) -> DataFrame:
    """An 8x8 depth grid for each embedding, an hour apart, 250 frames to a project."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    depth = F.when((31 * F.col("vec_id") + 17 * F.col("pos")) % 23 != 0, 55 + 10 * F.col("v").cast("double"))
    ts = F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id % {FRAMES_PER_PROJECT} AS int))")
    rows = e.select(
        F.concat(F.lit("P"), F.floor(F.col("vec_id") / FRAMES_PER_PROJECT).cast("string")).alias("project_id"), (F.col("vec_id") % FRAMES_PER_PROJECT).cast("int").alias("frame_idx"),
        F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), depth.alias("depth"), ts.alias("ts"),
    )
    return rows.withColumn("lof", F.hour("ts").between(8, 17)).withColumn("day", F.to_date("ts"))


CELLS = f"""cells AS (
  SELECT 'P' || (vec_id // {FRAMES_PER_PROJECT}) AS project_id, (vec_id % {FRAMES_PER_PROJECT})::INT AS frame_idx, (pos // 8)::INT AS y, (pos % 8)::INT AS x,
    CASE WHEN (31 * vec_id + 17 * pos) % 23 = 0 THEN NULL ELSE 55 + 10 * v::DOUBLE END AS depth,
    TIMESTAMP '2024-01-01' + to_hours(vec_id % {FRAMES_PER_PROJECT}) AS ts,
    (vec_id % {FRAMES_PER_PROJECT}) % 24 BETWEEN 8 AND 17 AS lof, CAST(TIMESTAMP '2024-01-01' + to_hours(vec_id % {FRAMES_PER_PROJECT}) AS DATE) AS day
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
)"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Classified events: the user is the project, the event type the behaviour."""
    e = spark.read.parquet(f"{d}/events.parquet")
    bid = F.try_element_at(F.create_map(*[F.lit(x) for x in ("click", "c", "view", "p", "purchase", "b", "signup", "f")]), F.col("event_type"))
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("project_id"), F.col("event_id").alias("LID"), (F.col("user_id") % 10).cast("string").alias("VideoID"),
        F.col("ts").alias("TimeStamp"), (F.col("event_id") % 69).cast("double").alias("t"), F.pmod(F.col("value"), F.lit(100.0)).alias("X"), F.get_json_object("props", "$.k").cast("double").alias("Y"),
        (F.pmod(F.col("value"), F.lit(7.0)) + 1).alias("X_span"), (F.pmod(F.col("value"), F.lit(5.0)) + 1).alias("Y_span"), bid.alias("Prediction"), F.when(F.col("event_id") % 10 == 0, "Yes").otherwise("No").alias("ClipCreated"),
    )


CLUSTERS = """clusters AS (
  SELECT 'U' || user_id AS project_id, event_id AS "LID", (user_id % 10)::VARCHAR AS "VideoID", ts AS "TimeStamp", (event_id % 69)::DOUBLE AS t,
    value % 100.0 AS "X", json_extract_string(props, '$.k')::DOUBLE AS "Y", value % 7.0 + 1 AS "X_span", value % 5.0 + 1 AS "Y_span",
    CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'p' WHEN 'purchase' THEN 'b' WHEN 'signup' THEN 'f' END AS "Prediction",
    CASE WHEN event_id % 10 = 0 THEN 'Yes' ELSE 'No' END AS "ClipCreated"
  FROM events
)"""


def reference_events(spark: SparkSession, d: str) -> DataFrame:
    """The reference event of each project: its last event; kind by parity."""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("dissection_time"))
    return e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("pid"), "dissection_time", F.when(F.col("user_id") % 2 == 0, "B").otherwise("C").alias("behave_or_control"))


REFERENCE = """ref AS (
  SELECT 'U' || user_id AS pid, max(ts) AS dissection_time, CASE WHEN user_id % 2 = 0 THEN 'B' ELSE 'C' END AS behave_or_control FROM events GROUP BY user_id
)"""


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Track points: ten videos, forty tracks each."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return x.select(
        (F.col("l_suppkey") % 10).cast("string").alias("base_name"), (F.col("l_partkey") % 40).alias("track_id"), (F.col("l_orderkey") % 2000).cast("int").alias("frame"),
        (F.col("l_quantity") * 20).alias("xc"), F.pmod(F.col("l_extendedprice"), F.lit(972.0)).alias("yc"), (F.col("l_tax") * 400 + 10).alias("w"), (F.col("l_discount") * 300 + 10).alias("h"),
        (F.col("l_returnflag") == "R").cast("double").alias("class_id"), (1 - F.col("l_discount")).alias("p_value"),
    )


TRACKS = """tracks AS (
  SELECT (l_suppkey % 10)::VARCHAR AS base_name, l_partkey % 40 AS track_id, (l_orderkey % 2000)::INT AS frame, l_quantity * 20 AS xc, l_extendedprice % 972.0 AS yc,
    l_tax * 400 + 10 AS w, l_discount * 300 + 10 AS h, (l_returnflag = 'R')::INT::DOUBLE AS class_id, 1 - l_discount AS p_value
  FROM lineitem
)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Frame records, and start and stop records of movies, written as log lines."""
    e = spark.read.parquet(f"{d}/events.parquet")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    pid, n = F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")), F.col("event_id").cast("string")
    frame = F.concat(F.lit("FrameCaptured: NpyFile: Frames/F_"), n, F.lit(".npy,,PicFile: Frames/F_"), n, F.lit(".jpg,,Time: "), time, F.lit(",,NFrames: 30,,AvgMed: "), F.format_string("%.2f", "value"), F.lit(",,AvgStd=0.05,,GP: "), F.floor(F.col("value") * 100).cast("long").cast("string"), F.lit(",,LOF: "), F.when(F.hour("ts").between(8, 17), "True").otherwise("False"))
    start = F.concat(F.lit("PiCameraStarted: FrameRate: 30,,Resolution: 1296x972,,Time: "), time, F.lit(",,VideoFile: Videos/"), n, F.lit("_vid.h264,,PicFile: Videos/"), n, F.lit("_pic.jpg"))
    old = F.concat(F.lit("PiCameraStarted: Time: "), time, F.lit(",,File: Videos/"), n, F.lit("_vid.h264"))
    stop = F.concat(F.lit("PiCameraStopped: Time: "), F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss"), F.lit(",,File: Videos/"), n, F.lit("_vid.h264"))
    lines = F.array(frame, F.when(F.col("event_id") % 50 == 0, F.when(F.col("event_id") % 100 == 0, old).otherwise(start)), F.when(F.col("event_id") % 150 == 0, stop))
    return e.select(pid.alias("project_id"), F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value"))


def states(spark: SparkSession, d: str) -> DataFrame:
    """Analysis states, one row for each order, with text booleans in mixed case."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    flag = lambda k: F.when(F.col("o_orderkey") % k == 0, "False").when(F.col("o_orderkey") % 7 == 0, "TRUE").otherwise("true")
    return o.select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("projectID"), F.when(F.col("o_orderkey") % 11 != 0, flag(3)).alias("RunAnalysis"), flag(7).alias("StartingFiles"), flag(5).alias("Prep"),
        flag(4).alias("Depth"), flag(9).alias("Cluster"), flag(6).alias("ClusterClassification"), flag(8).alias("TrackFish"),
    )


STATES = """states AS (
  SELECT 'O' || o_orderkey AS "projectID", CASE WHEN o_orderkey % 11 <> 0 THEN f(3) END AS "RunAnalysis", f(7) AS "StartingFiles", f(5) AS "Prep", f(4) AS "Depth", f(9) AS "Cluster", f(6) AS "ClusterClassification", f(8) AS "TrackFish" FROM orders
)"""
for _k in range(2, 10):
    STATES = STATES.replace(f"f({_k})", f"(CASE WHEN o_orderkey % {_k} = 0 THEN 'False' WHEN o_orderkey % 7 = 0 THEN 'TRUE' ELSE 'true' END)")
