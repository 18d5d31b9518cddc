"""Track, log and catalog queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.functions.expr import box_from_centre, box_shape, in_polygon, repair_year, round6, split_tag, typed
from reefline.operators import catalog, tracks
from reefline.plans import proxies
from reefline.plans.q_depth import r6
from reefline.shared import place
from reefline.sources import files, logs

QUERIES, ORACLES = {}, {}
TR, CL, ST = proxies.TRACKS, proxies.CLUSTERS, proxies.STATES


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TR} SELECT base_name, track_id, count(p_value)::BIGINT AS track_length, round(avg(class_id), 6) AS "Reflection", round(avg(p_value), 6) AS p_value, round(avg((xc < 600)::INT), 6) AS "InBounds" FROM tracks GROUP BY ALL""")
def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(tracks.track_summary(proxies.tracks(spark, d).withColumn("in_bounds", F.col("xc") < 600)))


@query(f"""WITH {TR}, n AS (SELECT base_name, track_id, count(p_value) AS track_length FROM tracks GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (PARTITION BY base_name ORDER BY track_id) - 1 AS new_id FROM n WHERE track_length > 150)
SELECT base_name, track_id, new_id::INT AS new_id, any_value(track_length)::BIGINT AS track_length, count(*)::BIGINT AS n FROM k JOIN tracks USING (base_name, track_id) GROUP BY ALL""")
def track_renumber(spark: SparkSession, d: str) -> DataFrame:
    return tracks.renumber(proxies.tracks(spark, d), 150).groupBy("base_name", "track_id", "new_id").agg(F.first("track_length").alias("track_length"), F.count("*").alias("n"))


@query(f"""WITH {TR} SELECT track_length::BIGINT AS track_length, count(*)::BIGINT AS n_tracks FROM (SELECT base_name, track_id, count(p_value) AS track_length FROM tracks GROUP BY ALL) GROUP BY ALL""")
def track_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return tracks.length_histogram(proxies.tracks(spark, d))


@query(f"""WITH {TR}, {CL}, e AS (SELECT * FROM clusters WHERE "ClipCreated" = 'Yes'), m AS (
  SELECT "LID", "VideoID", frame, track_id, (yc - "X") * (yc - "X") + (xc - "Y") * (xc - "Y") AS dd, row_number() OVER (PARTITION BY "VideoID", "LID" ORDER BY (yc - "X") * (yc - "X") + (xc - "Y") * (xc - "Y"), frame, track_id) AS r
  FROM e JOIN tracks ON base_name = "VideoID" AND frame > (t - 0.5) * 29 AND frame < (t + 0.5) * 29
) SELECT e."LID", e."VideoID", track_id, frame, round(dd, 6) AS distance2 FROM e LEFT JOIN m ON m."LID" = e."LID" AND m."VideoID" = e."VideoID" AND r = 1""")
def event_track_association(spark: SparkSession, d: str) -> DataFrame:
    return r6(tracks.associate(proxies.clusters(spark, d), proxies.tracks(spark, d)))


@query(f"""WITH {TR}, n AS (SELECT *, count(p_value) OVER (PARTITION BY base_name, track_id) AS len FROM tracks), k AS (SELECT *, count(*) OVER (PARTITION BY base_name, frame) AS c FROM n WHERE len > 150)
SELECT base_name, frame, count(*)::BIGINT AS n, min(track_id) AS first_track, max(track_id) AS last_track FROM k WHERE c > 1 GROUP BY ALL""")
def cooccurring_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tracks.cooccurring(proxies.tracks(spark, d), 150).groupBy("base_name", "frame").agg(F.count("*").alias("n"), F.min("track_id").alias("first_track"), F.max("track_id").alias("last_track"))


@query(f"""WITH {TR}, s AS (SELECT base_name, track_id, count(p_value) AS len FROM tracks GROUP BY ALL), l AS (SELECT unnest(range(8)) AS lv), c AS (
  SELECT b.base_name, lv, (SELECT count(*) FROM s WHERE s.base_name = b.base_name AND len > 190 - lv * 10) AS n FROM (SELECT DISTINCT base_name FROM s) b, l
), p AS (SELECT base_name, coalesce(min(lv) FILTER (WHERE n >= 15), max(lv)) AS lv FROM c GROUP BY ALL)
SELECT base_name, (190 - lv * 10)::INT AS min_length, n::BIGINT AS n_tracks FROM p JOIN c USING (base_name, lv)""")
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = proxies.tracks(spark, d).groupBy("base_name", "track_id").agg(F.count("p_value").alias("track_length"))
    return tracks.adaptive_threshold(s, 15, 190, 10, 8)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("xc", "yc", "w", "h")]
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    t = x.select((F.col("l_suppkey") % 10).cast("string").alias("base_name"), (F.col("l_orderkey") % 2000).cast("int").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), (F.col("l_quantity") * 20).alias("xc"), F.pmod(F.col("l_extendedprice"), F.lit(972.0)).alias("yc"), (F.col("l_tax") * 400 + 100).alias("w"), (F.col("l_discount") * 300 + 100).alias("h"))
    return t.select("base_name", "frame", "box_id", *box_from_centre(*c))


@query("""WITH b AS (SELECT (l_suppkey % 10)::VARCHAR AS base_name, (l_orderkey % 2000)::INT AS frame, l_orderkey * 10 + l_linenumber AS id, l_quantity * 20 - (l_tax * 400 + 100) / 2 AS x1, l_extendedprice % 972.0 - (l_discount * 300 + 100) / 2 AS y1, l_quantity * 20 + (l_tax * 400 + 100) / 2 AS x2, l_extendedprice % 972.0 + (l_discount * 300 + 100) / 2 AS y2 FROM lineitem
), p AS (SELECT a.base_name, a.frame, a.id AS a_id, b.id AS b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM b a JOIN b ON a.base_name = b.base_name AND a.frame = b.frame AND a.id < b.id)
SELECT base_name, frame, a_id, b_id, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) > 0.3""")
def box_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tracks.iou_pairs(_boxes(spark, d), least=0.3).withColumn("iou", round6(F.col("iou")))


@query("""WITH b AS (SELECT (l_suppkey % 10)::VARCHAR AS base_name, (l_orderkey % 2000)::INT AS frame, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS id, l_quantity * 20 - (l_tax * 400 + 100) / 2 AS x1, l_extendedprice % 972.0 - (l_discount * 300 + 100) / 2 AS y1, l_quantity * 20 + (l_tax * 400 + 100) / 2 AS x2, l_extendedprice % 972.0 + (l_discount * 300 + 100) / 2 AS y2 FROM lineitem
), p AS (SELECT a.base_name, a.frame, a.id AS a_id, b.id AS b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM b a JOIN b ON a.base_name = b.base_name AND a.frame = b.frame AND a.line > 3 AND b.line <= 3)
SELECT base_name, frame, a_id, b_id, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) > 0.3""")
def box_iou_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of one table against those of another, whatever the order of their ids."""
    b = _boxes(spark, d)
    return tracks.iou_pairs(b.where(F.col("box_id") % 10 > 3), b.where(F.col("box_id") % 10 <= 3), 0.3).withColumn("iou", round6(F.col("iou")))


_LONG = f"""{TR}, p AS (SELECT base_name, track_id, frame, xc / 1000 * 1296 AS xc, yc / 972 * 972 AS yc, class_id, p_value FROM tracks
), n AS (SELECT *, count(p_value) OVER (PARTITION BY base_name, track_id) AS len, CASE WHEN (xc > 200 AND xc < 1000 AND yc > 100 AND yc < 900) THEN 1.0 ELSE 0.0 END AS inb FROM p
), s AS (SELECT base_name, track_id, count(p_value) AS track_length, avg(class_id) AS r, avg(p_value) AS pv, avg(inb) AS ib FROM n WHERE len > 100 GROUP BY ALL)"""


def _summarized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = proxies.tracks(spark, d).withColumns({"xc": F.col("xc") / 1000, "yc": F.col("yc") / 972, "w": F.col("w") / 1296, "h": F.col("h") / 972})
    sizes = points.select("base_name").distinct().withColumns({"width": F.lit(1296), "height": F.lit(972)})
    inside = in_polygon(F.col("xc"), F.col("yc"), [(200.0, 100.0), (1000.0, 100.0), (1000.0, 900.0), (200.0, 900.0)])
    return tracks.summarize(points, sizes, inside, 100)


@query(f"""WITH {_LONG} SELECT base_name, track_id, track_length::BIGINT AS track_length, round(r, 6) AS "Reflection", round(pv, 6) AS p_value, round(ib, 6) AS "InBounds" FROM s""")
def tracks_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    return r6(_summarized(spark, d)[1])


@query(f"""WITH {_LONG}, lv AS (SELECT unnest(range(7)) AS level), k AS (SELECT level, base_name, frame, track_id FROM n, lv WHERE len > 190 - 15 * level
), sh AS (SELECT level, base_name, frame FROM k GROUP BY ALL HAVING count(*) > 1
), c AS (SELECT level, base_name, track_id FROM k JOIN sh USING (level, base_name, frame) GROUP BY ALL HAVING count(*) > 40
), f AS (SELECT c.level, s.* FROM c JOIN s USING (base_name, track_id) WHERE ib > 0.3 AND track_length > 190 - 15 * level
), pk AS (SELECT coalesce(min(level) FILTER (WHERE n >= 30), 6) AS level FROM (SELECT level, count(*) AS n FROM f GROUP BY level))
SELECT base_name, track_id, track_length::BIGINT AS track_length, round(r, 6) AS "Reflection", round(pv, 6) AS p_value, round(ib, 6) AS "InBounds", (190 - 15 * level)::INT AS min_length FROM f JOIN pk USING (level)""")
def video_candidates(spark: SparkSession, d: str) -> DataFrame:
    points, summary = _summarized(spark, d)
    return r6(tracks.video_candidates(points, summary, 30, 190, 15, 40, 0.3))


@query(None)
def sort_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Drifting boxes made from line items: a video for each supplier, whose rows of a part move along with the frame."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    frame = (F.col("l_orderkey") % 200).cast("int")
    boxes = x.groupBy(F.col("l_suppkey").cast("string").alias("base_name"), frame.alias("frame"), (F.col("l_partkey") % 8).alias("k")).agg(F.avg("l_discount").alias("s"), F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"))
    left, top = F.col("k") * 150.0 + F.col("frame") * 0.5 + F.col("q") / 5, F.col("k") * 90.0 + F.col("frame") * 0.25 + F.col("t") * 50
    return tracks.track_objects(boxes.select("base_name", "frame", left.alias("x1"), top.alias("y1"), (left + 60).alias("x2"), (top + 40).alias("y2"), (1 - F.col("s")).alias("score"), (F.col("k") % 2).cast("double").alias("class_id")))


@query("""SELECT 'U' || user_id % 10 AS project_id, (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, 'Frames/F_' || event_id || '.npy') - 1)::INT AS frame_idx, 'Frames/F_' || event_id || '.npy' AS npy_file, ts AS time, round(round(value, 2), 6) AS med, 0.05::DOUBLE AS std, floor(value * 100)::BIGINT AS gp,
  hour(ts) BETWEEN 8 AND 17 AS lof, (dense_rank() OVER (PARTITION BY user_id % 10 ORDER BY CAST(ts AS DATE)))::INT AS rel_day FROM events""")
def log_frames(spark: SparkSession, d: str) -> DataFrame:
    return r6(logs.frames(proxies.log_lines(spark, d)).select("project_id", "frame_idx", "npy_file", "time", "med", "std", "gp", "lof", "rel_day"))


@query("""SELECT 'U' || user_id % 10 AS project_id, 'FrameCaptured' AS type, count(*)::BIGINT AS n, sum(floor(value * 100))::BIGINT AS gp FROM events GROUP BY ALL
UNION ALL SELECT 'U' || user_id % 10, 'PiCameraStarted', count(*), 0 FROM events WHERE event_id % 50 = 0 GROUP BY ALL UNION ALL SELECT 'U' || user_id % 10, 'PiCameraStopped', count(*), 0 FROM events WHERE event_id % 150 = 0 GROUP BY ALL""")
def log_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.records(proxies.log_lines(spark, d))
    return rows.groupBy("project_id", "type").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.try_element_at("fields", F.lit("GP")).cast("bigint")), F.lit(0)).alias("gp"))


@query("""WITH l AS (SELECT 'U' || user_id % 10 AS project_id, max(ts) AS last FROM events GROUP BY ALL)
SELECT project_id, event_id || '_vid' AS base_name, ts AS start_time, CASE WHEN event_id % 150 = 0 THEN date_trunc('second', ts + INTERVAL 1 HOUR) ELSE last END AS end_time, 30.0::DOUBLE AS framerate, 1296 AS width, 972 AS height,
  CASE WHEN event_id % 100 = 0 THEN 'Unknown' ELSE 'Videos/' || event_id || '_pic.jpg' END AS pic_file FROM events JOIN l ON project_id = 'U' || user_id % 10 WHERE event_id % 50 = 0""")
def movie_sessions(spark: SparkSession, d: str) -> DataFrame:
    lines = proxies.log_lines(spark, d)
    return logs.movies(lines, logs.frames(lines)).select("project_id", "base_name", "start_time", "end_time", "framerate", "width", "height", "pic_file")


@query("""WITH f AS (SELECT user_id AS project, ts, floor(value) AS gp, CASE WHEN event_type = 'error' THEN 0.000001 ELSE 0.05 END AS std, row_number() OVER o AS r, lag(floor(value)) OVER o AS prev, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts))
SELECT project, gp::BIGINT AS gp, std < 0.00001 AND gp = prev AS duplicate FROM f WHERE r = n AND prev IS NOT NULL""")
def duplicate_sensor(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    o = W.partitionBy("user_id").orderBy("ts")
    f = e.select(F.col("user_id").alias("project"), F.floor("value").alias("gp"), F.when(F.col("event_type") == "error", 0.000001).otherwise(0.05).alias("std"), F.lag(F.floor("value")).over(o).alias("prev"), F.lead("ts").over(o).alias("next"))
    return f.where("next IS NULL AND prev IS NOT NULL").select("project", "gp", ((F.col("std") < 1e-5) & (F.col("gp") == F.col("prev"))).alias("duplicate"))


@query("""WITH p AS (SELECT user_id, arg_max(event_type, ts) AS status, max(ts) AS ping FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, ping FROM p, n WHERE status <> 'error' AND now - ping > INTERVAL 15 MINUTE""")
def stale_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    from reefline.streaming.jobs import stale

    e = spark.read.parquet(f"{d}/events.parquet")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_type")).alias("m")).select("user_id", F.col("m.ts").alias("Ping"), F.when(F.col("m.event_type") != "error", "Running").otherwise("Stopped").alias("Status"))
    now = e.agg(F.max("ts").alias("now"))
    return stale(last.crossJoin(F.broadcast(now)), F.col("now")).select("user_id", F.col("Ping").alias("ping"))


def _true(c: str) -> str:
    return f"upper(\"{c}\") = 'TRUE'"


@query(f"""WITH {ST} SELECT "projectID", stage FROM states, (VALUES ('Depth'), ('TrackFish'), ('ClusterClassification')) v(stage)
WHERE upper(coalesce("RunAnalysis", 'TRUE')) = 'TRUE' AND {_true("StartingFiles")} AND {_true("Prep")} AND (stage <> 'ClusterClassification' OR {_true("Cluster")})
  AND NOT (CASE stage WHEN 'Depth' THEN {_true("Depth")} WHEN 'TrackFish' THEN {_true("TrackFish")} ELSE {_true("ClusterClassification")} END)""")
def eligible_projects(spark: SparkSession, d: str) -> DataFrame:
    return catalog.eligible(proxies.states(spark, d), ["Depth", "TrackFish", "ClusterClassification"])


@query(f"""WITH {ST} SELECT "projectID", CASE WHEN substr("projectID", 2)::INT % 13 = 0 THEN 'TRUE' ELSE "Depth" END AS "Depth", coalesce("RunAnalysis", 'TRUE') AS "RunAnalysis" FROM states""")
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = catalog.fill_defaults(proxies.states(spark, d), ["RunAnalysis"])
    done = s.where(F.substring("projectID", 2, 20).cast("int") % 13 == 0).select("projectID", F.lit("TRUE").alias("value"))
    return catalog.upsert(s, done, "projectID", "Depth").select("projectID", "Depth", "RunAnalysis")


@query("""SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    old, new = (c.where(F.col("c_custkey") % k == 0).select(F.col("c_custkey").alias("id"), F.lit(o).alias("origin")) for k, o in ((3, "old"), (2, "new")))
    return catalog.insert_absent(old, new, "id")


@query("""WITH r AS (SELECT 'C' || o_custkey AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Depth' ELSE 'Cluster' END AS stage, o_orderkey FROM orders), l AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT project_id, stage, bool_and(l.l_orderkey IS NOT NULL) AS complete, count(*)::BIGINT AS n_required FROM r LEFT JOIN l ON l.l_orderkey = r.o_orderkey GROUP BY ALL""")
def stage_complete(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    required = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("project_id"), F.when(F.col("o_orderkey") % 2 == 0, "Depth").otherwise("Cluster").alias("stage"), F.lit("d").alias("dir"), F.col("o_orderkey").cast("string").alias("name"))
    there = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k")).distinct()
    listing = o.join(there, F.col("k") == F.col("o_orderkey")).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("project_id"), F.lit("d").alias("dir"), F.col("o_orderkey").cast("string").alias("name"))
    return catalog.stage_complete(required, listing)


@query("""WITH m AS (SELECT DISTINCT o_orderkey % 1200 AS idx FROM orders), r(annotator, lo, hi) AS (VALUES (0, 750, 99999), (1, 0, 249), (2, 551, 749))
SELECT l_linenumber % 3 AS annotator, l_orderkey % 1000 AS frame, 'f' || (l_orderkey % 1000) AS name, CASE WHEN l_returnflag = 'R' THEN 'Reflection' ELSE 'Fish' END AS label, round((l_quantity * 10 + l_quantity * 10 + 40) / 2 / 1296, 6) AS xc, count(*)::BIGINT AS n
FROM lineitem JOIN r ON annotator = l_linenumber % 3 AND l_orderkey % 1000 BETWEEN lo AND hi JOIN m ON idx = l_orderkey % 1000 GROUP BY ALL""")
def annotation_join(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    left, top = F.col("l_quantity") * 10, F.col("l_quantity") * 5
    shapes = x.select((F.col("l_linenumber") % 3).alias("annotator"), (F.col("l_orderkey") % 1000).alias("frame"), F.when(F.col("l_returnflag") == "R", "Reflection").otherwise(F.col("l_returnflag")).alias("label"), F.array(left, top, left + 40, top + 30).alias("points"))
    manifest = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 1200).alias("index")).distinct().select("index", F.concat(F.lit("f"), F.col("index").cast("string")).alias("name"), F.lit(1296).alias("width"), F.lit(972).alias("height"))
    ranges = spark.createDataFrame([(0, 750, 99999), (1, 0, 249), (2, 551, 749)], "annotator int, lo int, hi int")
    return r6(catalog.annotation_rows(shapes, manifest, F.broadcast(ranges)).groupBy("annotator", "frame", "name", "label", F.round("xc", 6).alias("xc")).agg(F.count("*").alias("n")))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split({text}, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN {crc32_sql("l_orderkey || '_' || l_linenumber")} % 11 = 0 THEN 'val' ELSE 'train' END AS split FROM lineitem""")
def split_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags by hash; tests check them against zlib too."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", split_tag(F.concat_ws("_", "l_orderkey", "l_linenumber"), 11).alias("split"))


@query("""SELECT 'clip' || event_id AS "ClipName", CASE WHEN event_id % 3 <> 0 THEN event_type END AS "Prediction", CASE WHEN event_id % 3 <> 0 THEN round(value / 500, 6) END AS "Confidence", 'm1' AS "modelID" FROM events""")
def classify_merge(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    clip = F.concat(F.lit("clip"), F.col("event_id").cast("string"))
    p = e.where("event_id % 3 <> 0").select(F.concat(clip, F.lit(".mp4")).alias("VideoFile"), F.col("event_type").alias("Prediction"), (F.col("value") / 500).alias("Confidence"))
    return r6(catalog.classify_merge(e.select(clip.alias("ClipName")), p, "m1"))


@query("""SELECT 'j' || o_orderkey AS file, o_orderkey::VARCHAR AS job_id, 'job' || o_custkey AS job_name, (o_orderkey % 4 + 1)::VARCHAR AS nodes, (o_orderkey % 8 + 1)::VARCHAR AS ppn, CASE WHEN o_orderkey % 10 = 0 THEN 'killed' ELSE 'successful' END AS outcome, floor(o_totalprice)::BIGINT::VARCHAR || 'kb' AS used_mem FROM orders""")
def job_log_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey").cast("string")
    lines = F.array(F.concat(F.lit("Job id: "), k), F.concat(F.lit("Job name: job"), F.col("o_custkey").cast("string")), F.concat(F.lit("Resources: nodes="), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(":ppn="), (F.col("o_orderkey") % 8 + 1).cast("string")), F.concat(F.lit("Rsrc Used: mem="), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("kb,cput=01:02:03")), F.when(F.col("o_orderkey") % 10 == 0, "=>> PBS: job killed: walltime exceeded"))
    text = o.select(F.concat(F.lit("j"), k).alias("file"), F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value"))
    return logs.job_logs(text).select("file", "job_id", "job_name", "nodes", "ppn", "outcome", "used_mem")


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS box_id, l_quantity * 20 AS xc, l_extendedprice % 972.0 AS yc, l_tax * 400 + 100 AS w, l_discount * 300 + 100 AS h FROM lineitem)
SELECT box_id, round(xc, 6) AS u, round(yc, 6) AS v, round(w * h, 6) AS s, round(w / h, 6) AS r FROM b""")
def box_shapes(spark: SparkSession, d: str) -> DataFrame:
    return r6(_boxes(spark, d).select("box_id", *box_shape(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '(' || event_id || ', 2)' WHEN 2 THEN 'True' WHEN 3 THEN event_id::VARCHAR WHEN 4 THEN event_id || '.5' WHEN 5 THEN event_id || 'x972' ELSE event_type END AS v FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'date' WHEN 1 THEN 'tuple' WHEN 2 THEN 'bool' WHEN 3 THEN 'int' WHEN 4 THEN 'float' WHEN 5 THEN 'resolution' ELSE 'text' END AS kind FROM e""")
def typed_values(spark: SparkSession, d: str) -> DataFrame:
    e, n, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id").cast("string"), F.col("event_id") % 7
    v = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.lit("("), n, F.lit(", 2)"))).when(k == 2, "True").when(k == 3, n).when(k == 4, F.concat(n, F.lit(".5"))).when(k == 5, F.concat(n, F.lit("x972"))).otherwise(F.col("event_type"))
    return e.select("event_id", typed(v).alias("kind"))


@query("""SELECT event_id, date_trunc('second', ts) AS time FROM events""")
def year_repair(spark: SparkSession, d: str) -> DataFrame:
    """Times of day, dated by the folder that names the day."""
    from reefline.functions.expr import parse_time

    e = spark.read.parquet(f"{d}/events.parquet")
    path = F.concat(F.date_format("ts", "MMMM-dd-yyyy"), F.lit("/F.npy"))
    return e.select("event_id", repair_year(parse_time(F.date_format("ts", "HH:mm:ss")), path).alias("time"))


def _all_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log lines, with a header for each user and other records."""
    e = spark.read.parquet(f"{d}/events.parquet")
    pid = F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string"))
    swapped = F.col("user_id") % 2 == 0
    tank, project = F.concat(F.lit("Tk"), F.col("user_id").cast("string")), F.concat(F.lit("P_"), F.col("user_id").cast("string"))
    head = F.concat(F.lit("MasterStart: System: pi,,Device: kinect,,Uname: u,,TankID: "), F.when(swapped, project).otherwise(tank), F.lit(",,ProjectID: "), F.when(swapped, tank).otherwise(project), F.lit(",,AnalysisID: A"))
    heads = e.groupBy("user_id").agg(F.count("*").alias("_n")).select(pid.alias("project_id"), head.alias("value"))
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    back = F.concat(F.lit("BackgroundCaptured: NpyFile: B_"), F.col("event_id").cast("string"), F.lit(".npy,,PicFile: b.jpg,,Time: "), time, F.lit(",,AvgMed: 1.5,,AvgStd: 0.5,,GP: 7,,LOF: True"))
    reset = F.concat(F.lit("TankResetStart: Time: "), time, F.lit(",,Time: "), time)
    more = e.where("event_id % 20 = 0").select(pid.alias("project_id"), F.explode(F.array(back, reset)).alias("value"))
    return proxies.log_lines(spark, d).unionByName(heads).unionByName(more)


@query("""SELECT 'U' || user_id % 10 AS project_id, 'Tk' || user_id AS tank_id, 'P_' || user_id AS log_project, count(*) OVER (PARTITION BY user_id % 10)::BIGINT AS n_headers FROM (SELECT DISTINCT user_id FROM events)""")
def log_headers(spark: SparkSession, d: str) -> DataFrame:
    return logs.headers(_all_lines(spark, d)).select("project_id", "tank_id", "log_project", "n_headers")


@query("""SELECT 'U' || user_id % 10 AS project_id, 'B_' || event_id || '.npy' AS npy_file, date_trunc('second', ts) AS time, 1.5::DOUBLE AS med, 7::BIGINT AS gp, true AS lof FROM events WHERE event_id % 20 = 0""")
def log_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    return logs.frames(_all_lines(spark, d), "BackgroundCaptured").select("project_id", "npy_file", "time", "med", "gp", "lof")


@query("""SELECT 'U' || user_id % 10 AS project_id, 'TankResetStart' AS type, date_trunc('second', ts) AS time FROM events WHERE event_id % 20 = 0""")
def log_others(spark: SparkSession, d: str) -> DataFrame:
    return logs.other_records(_all_lines(spark, d)).select("project_id", "type", "time")


@query("""WITH m AS (SELECT 'U' || user_id % 10 AS project_id, ts, CASE WHEN event_id % 100 = 0 THEN 'Unknown' ELSE 'Videos/' || event_id || '_pic.jpg' END AS pic, event_id FROM events WHERE event_id % 50 = 0
), f AS (SELECT project_id, arg_min(pic, ts) FILTER (WHERE hour(ts) BETWEEN 8 AND 20) AS a, min(ts) FILTER (WHERE hour(ts) BETWEEN 8 AND 20) AS t, arg_max(pic, ts) AS b FROM m GROUP BY project_id HAVING t IS NOT NULL
), e AS (SELECT f.project_id, arg_min('Frames/F_' || event_id || '.npy', ts) AS c, arg_max('Frames/F_' || event_id || '.npy', ts) AS d FROM f JOIN events ON 'U' || user_id % 10 = f.project_id AND ts > t AND hour(ts) BETWEEN 8 AND 17 GROUP BY ALL)
SELECT f.project_id, a AS first_picture, b AS last_picture, c AS first_depth, d AS last_depth FROM f LEFT JOIN e USING (project_id)""")
def first_last_images(spark: SparkSession, d: str) -> DataFrame:
    lines = proxies.log_lines(spark, d)
    frames = logs.frames(lines)
    return catalog.first_last_images(logs.movies(lines, frames), frames)


@query("""SELECT DISTINCT 'C' || o_custkey AS project_id FROM orders UNION SELECT 'C' || c_custkey FROM customer""")
def project_ids(spark: SparkSession, d: str) -> DataFrame:
    name = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.concat(F.lit("C"), F.col(c).cast("string")).alias("project_id"))
    return catalog.project_ids(name("orders", "o_custkey"), name("customer", "c_custkey"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('0/' || o_orderkey), o_orderkey) - 1 AS place FROM orders""")
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.shuffled(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("""SELECT base_name, count(*)::BIGINT AS n FROM (SELECT DISTINCT (l_suppkey % 10)::VARCHAR AS base_name, l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL""".replace("count(*)", "least(count(*), 50)"))
def sampled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Fifty boxes of each video, the same each time."""
    return tracks.sample(_boxes(spark, d), "box_id", 50, ["base_name"]).groupBy("base_name").count().withColumnRenamed("count", "n")


# --- tables written to files and read again ----------------------------------------------------------


@query(f"""WITH {TR} SELECT base_name, track_id, frame, round(xc, 6) AS xc, round(p_value, 6) AS p_value FROM tracks""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "csv")
    files.write_csv(proxies.tracks(spark, d).select("base_name", "track_id", "frame", "xc", "p_value"), path)
    return r6(files.read_csv(spark, path, "base_name string, track_id long, frame int, xc double, p_value double"))


@query("""SELECT l_orderkey % 1200 AS index, 'f' || (l_orderkey % 1200) AS name, 1296 AS width, 972 AS height, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "manifest")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 1200).cast("int").alias("index"), F.lit(1296).alias("width"), F.lit(972).alias("height"))
    header = rows.limit(1).select(F.lit(None).cast("int").alias("index"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("name"))
    rows.withColumn("name", F.concat(F.lit("f"), F.col("index").cast("string"))).unionByName(header).write.json(path)
    return files.read_manifest(spark, path).groupBy(F.col("index").cast("long").alias("index"), "name", "width", "height").agg(F.count("*").alias("n"))


@query("""SELECT (l_orderkey % 1000)::INT AS frame, l_returnflag AS label, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS x FROM lineitem GROUP BY ALL""")
def annotations_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "annotations")
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    shape = F.struct(F.lit("rectangle").alias("type"), F.array(F.col("l_quantity").cast("double"), F.lit(1.0)).alias("points"), (F.col("l_orderkey") % 1000).cast("int").alias("frame"), F.array(F.lit("a")).alias("attributes"), F.col("l_returnflag").alias("label"))
    x.groupBy("l_orderkey").agg(F.collect_list(shape).alias("shapes")).select("shapes").write.json(path)  # an order's own lines
    return files.read_annotations(spark, path, lines=True).groupBy("frame", "label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("points")[0]), 2).alias("x"))


@query(f"""WITH {TR} SELECT base_name AS project_id, count(*)::BIGINT AS n, round(sum(xc), 4) AS x FROM tracks GROUP BY ALL""")
def by_project_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "cubes")
    files.write_by_project(proxies.tracks(spark, d).withColumnRenamed("base_name", "project_id").repartition("project_id"), path)
    rows = spark.read.parquet(path).groupBy(F.col("project_id").cast("string").alias("project_id")).agg(F.count("*").alias("n"), F.round(F.sum("xc"), 4).alias("x"))
    return rows


@query(f"""WITH {TR} SELECT DISTINCT 'project_id=' || base_name AS dir FROM tracks""")
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "listed")
    files.write_by_project(proxies.tracks(spark, d).withColumnRenamed("base_name", "project_id").repartition("project_id"), path)
    return files.read_listing(spark, path).where(F.col("name").endswith(".parquet")).select("dir").distinct()


@query("""SELECT 'Orders' AS sheet, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'Customers', count(*) FROM customer""")
def sheets_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "sheets")
    key = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("key"))
    files.write_sheets({"Orders": key("orders", "o_orderkey"), "Customers": key("customer", "c_custkey")}, path)
    return spark.read.parquet(path).groupBy("sheet").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS key, o_custkey AS customer, NULL::VARCHAR AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer""")
def append_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"))
    return files.append_merge(orders, spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))


@query(f"""WITH r(annotator, lo, hi) AS (VALUES (0, 750, 99999), (1, 0, 249), (2, 551, 749)), m AS (SELECT DISTINCT o_orderkey % 1200 AS idx FROM orders), t AS (SELECT idx AS frame, CASE WHEN {crc32_sql("'f' || idx")} % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM m)
SELECT annotator, label, split, count(*)::BIGINT AS n FROM (SELECT l_linenumber % 3 AS annotator, l_orderkey % 1000 AS frame, CASE WHEN l_returnflag = 'R' THEN 'Reflection' ELSE 'Fish' END AS label FROM lineitem) JOIN r USING (annotator) JOIN m ON idx = frame JOIN t USING (frame) WHERE frame BETWEEN lo AND hi GROUP BY ALL""")
def annotation_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Three annotators' batches joined, ranged, boxed, tagged, written by tag and read again."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    left, top = F.col("l_quantity") * 10, F.col("l_quantity") * 5
    shapes = x.select((F.col("l_linenumber") % 3).cast("int").alias("annotator"), (F.col("l_orderkey") % 1000).alias("frame"), F.when(F.col("l_returnflag") == "R", "Reflection").otherwise(F.col("l_returnflag")).alias("label"), F.array(left, top, left + 40, top + 30).alias("points"))
    manifest = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 1200).alias("index")).distinct().select("index", F.concat(F.lit("f"), F.col("index").cast("string")).alias("name"), F.lit(1296).alias("width"), F.lit(972).alias("height"))
    ranges = spark.createDataFrame([(0, 750, 99999), (1, 0, 249), (2, 551, 749)], "annotator int, lo int, hi int")
    whole = catalog.annotation_dataset([shapes.where(F.col("annotator") == k) for k in range(3)], manifest, F.broadcast(ranges))
    path = place(spark, "dataset")
    files.write_split(whole, path)
    return spark.read.parquet(path).groupBy("annotator", "label", "split").agg(F.count("*").alias("n"))


@query(f"""WITH {ST}, f AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag <> 'R') AS listed FROM lineitem GROUP BY ALL
), r AS (SELECT 'O' || l_orderkey AS project_id, bool_and(listed) AS complete FROM f GROUP BY ALL
), s AS (SELECT "projectID", upper(coalesce("RunAnalysis", 'TRUE')) = 'TRUE' AND {_true("StartingFiles")} AND {_true("Prep")} AS go, {_true("Depth")} OR coalesce(complete, false) AS depth, {_true("TrackFish")} AS track FROM states LEFT JOIN r ON project_id = "projectID")
SELECT "projectID", depth AS depth_done, CASE WHEN go AND NOT depth AND NOT track THEN 'Depth,TrackFish' WHEN go AND NOT depth THEN 'Depth' WHEN go AND NOT track THEN 'TrackFish' ELSE '' END AS next FROM s""")
def project_state(spark: SparkSession, d: str) -> DataFrame:
    """States with the stage whose files are all listed set, and what each project may run next."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    need = x.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("project_id"), F.lit("Depth").alias("stage"), F.lit("d").alias("dir"), F.col("l_linenumber").cast("string").alias("name"), "l_returnflag")
    out = catalog.project_state(proxies.states(spark, d), ["Depth", "TrackFish"], need.drop("l_returnflag"), need.where("l_returnflag <> 'R'"))
    return out.select("projectID", (F.upper("Depth") == "TRUE").alias("depth_done"), F.array_join("next_stages", ",").alias("next"))
