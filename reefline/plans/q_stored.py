"""Queries of stored cubes, versioned tables, file contents, camera-scale densities and the live view, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline import shared
from reefline.functions.expr import approx_radius, project
from reefline.operators import catalog, depth, events, tracks
from reefline.plans import proxies
from reefline.plans.q_depth import _INTERP, KEYS, LEAST, _change, _change_sql, _recursive, _regions_sql, r6
from reefline.plans.q_depth import ORACLES as DEPTH
from reefline.plans.q_events import _DET, MATRIX
from reefline.schemas import PARAMS
from reefline.sources import arrays, cubes, files
from reefline.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def stored_cube(spark: SparkSession, d: str, filled: bool = False) -> DataFrame:
    """The cells as a stored cube, in tiles of 4 by 4."""
    c = proxies.cells(spark, d)
    if filled:
        c = c.withColumn("depth", F.coalesce("depth", F.lit(55.0)))
    name = f"cube_{uuid.uuid4().hex}"
    return cubes.write_cube(c, name, shared.place(spark, "cube"), 8, 4)


@query(DEPTH["savgol_smooth"])
def tiled_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Smoothing of a stored cube: nothing is shuffled after the scan."""
    return r6(depth.savgol(stored_cube(spark, d, True)).select("project_id", "y", "x", "frame_idx", "depth"))


@query(f"""{_INTERP} SELECT project_id, frame_idx, y, x, round(depth, 6) AS depth FROM filled""")
def tiled_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.gap_interpolate(stored_cube(spark, d)).select("project_id", "frame_idx", "y", "x", "depth"))


@query(f"""{_change_sql()} SELECT project_id, window_id, y, x, round(change, 6) AS change FROM change""")
def tiled_change(spark: SparkSession, d: str) -> DataFrame:
    cube = stored_cube(spark, d)
    frames = shared.written(depth.frame_times(cube), "frames")
    return r6(depth.height_change(cube, depth.calendar_windows(frames), frames=frames))


@query(DEPTH["smooth_depth"])
def tiled_smooth_depth(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning of a stored cube."""
    return r6(depth.smooth_depth(stored_cube(spark, d)).select("project_id", "y", "x", "frame_idx", "depth"))


HEIGHT, WIDTH, SCALE = 480, 640, 4
_PROJECTED = f"""ev AS (SELECT "VideoID" AS project_id, ({MATRIX[3]} * "Y" + {MATRIX[4]} * "X" + {MATRIX[5]}) / ({MATRIX[6]} * "Y" + {MATRIX[7]} * "X" + {MATRIX[8]}) * {SCALE} AS px,
  ({MATRIX[0]} * "Y" + {MATRIX[1]} * "X" + {MATRIX[2]}) / ({MATRIX[6]} * "Y" + {MATRIX[7]} * "X" + {MATRIX[8]}) * {SCALE} AS py, ("X_span" + "Y_span") * sqrt({_DET}) / 2 AS radius FROM clusters WHERE "Prediction" = 'p' AND "X" IS NOT NULL AND "Y" IS NOT NULL)"""


@query(f"""WITH {proxies.CLUSTERS}, {_PROJECTED}, h AS (SELECT project_id, greatest(0.25, avg(radius) / 2) AS h, count(*) AS n FROM ev GROUP BY ALL
), x AS (SELECT ev.*, h, n, unnest(range(greatest(0, ceil(px - {events.REACH} * h))::BIGINT, least({WIDTH - 1}, floor(px + {events.REACH} * h))::BIGINT + 1)) AS x FROM ev JOIN h USING (project_id)
), c AS (SELECT *, unnest(range(greatest(0, ceil(py - {events.REACH} * h))::BIGINT, least({HEIGHT - 1}, floor(py + {events.REACH} * h))::BIGINT + 1)) AS y FROM x
), z AS (SELECT project_id, y, x, any_value(n) AS n, sum(exp(-((px - x) * (px - x) + (py - y) * (py - y)) / (2 * h * h))) AS z FROM c GROUP BY ALL
), s AS (SELECT *, z * n / (sum(z) OVER (PARTITION BY project_id) * {PARAMS.area}) AS d FROM z)
SELECT project_id, (y // 32)::INT AS tile_y, (x // 32)::INT AS tile_x, round(sum(d), 3) AS density, round(max(d), 3) AS peak FROM s GROUP BY ALL""")
def kde_camera(spark: SparkSession, d: str) -> DataFrame:
    """Densities of projected events on a camera's grid of 480 by 640 cells, summed up by tile."""
    c = proxies.clusters(spark, d).where("Prediction = 'p'")
    x, y = project(F.col("X"), F.col("Y"), MATRIX)
    e = c.select(F.col("VideoID").alias("project_id"), (x * SCALE).alias("X"), (y * SCALE).alias("Y"), approx_radius(F.col("X_span"), F.col("Y_span"), MATRIX).alias("radius"))
    n = spark.range(HEIGHT * WIDTH)
    grid = n.select(F.floor(F.col("id") / WIDTH).cast("int").alias("y"), (F.col("id") % WIDTH).cast("int").alias("x"))
    z = events.density_cells(e, grid, ["project_id"])
    tile = lambda c: F.floor(F.col(c) / 32).cast("int").alias(f"tile_{c}")
    return z.groupBy("project_id", tile("y"), tile("x")).agg(F.round(F.sum("z"), 3).alias("density"), F.round(F.max("z"), 3).alias("peak"))


_TRIM = """m AS (SELECT project_id, w, y, x, raw, count(*) AS m FROM s WHERE raw IS NOT NULL GROUP BY ALL
), r AS (SELECT *, row_number() OVER o AS r, max(m) OVER (PARTITION BY project_id, w, y, x ORDER BY raw ROWS UNBOUNDED PRECEDING) AS worst FROM m WINDOW o AS (PARTITION BY project_id, w, y, x ORDER BY raw)
), k AS (SELECT s.* FROM s JOIN r USING (project_id, w, y, x, raw) WHERE NOT (r.r <= 3 AND r.worst <= 3)
), a AS (SELECT project_id, w, y, x, median(raw) AS median, stddev_pop(raw) AS std, count(*) AS kept FROM k GROUP BY ALL
), t AS (SELECT project_id, w, y, x, count(*) AS n FROM s GROUP BY ALL)"""
_STATS = "round(avg(median), 6) AS avg_med, round(avg(std), 6) AS avg_std, count(median)::BIGINT AS gp, coalesce(sum(kept), 0)::BIGINT AS pixels_good, sum({due} - coalesce(kept, 0))::BIGINT AS pixels_bad FROM t LEFT JOIN a USING (project_id, w, y, x) GROUP BY ALL"


@query(f"""WITH {proxies.CELLS}, s AS (SELECT project_id, frame_idx // 40 AS w, y, x, floor(depth)::BIGINT AS raw FROM cells), {_TRIM} SELECT project_id, w::BIGINT AS w, {_STATS.format(due="n")}""")
def frame_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What frame records say of windows of forty samples."""
    s = proxies.cells(spark, d).select("project_id", F.floor(F.col("frame_idx") / 40).alias("w"), "y", "x", F.floor("depth").alias("raw"))
    return r6(depth.frame_statistics(depth.cell_medians(s, ["project_id", "w", "y", "x"]), ["project_id", "w"]))


def _written_stream(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = shared.place(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(f"""WITH {proxies.CELLS}, s AS (SELECT project_id, time_bucket(INTERVAL 20 HOUR, ts, TIMESTAMP '1970-01-01') AS w, y, x, floor(depth)::BIGINT AS raw FROM cells), {_TRIM}, o AS (SELECT project_id, w, {_STATS.format(due="40")})
SELECT project_id, w AS w_start, avg_med, avg_std, gp, pixels_good, pixels_bad FROM o WHERE w + INTERVAL 20 HOUR <= (SELECT max(ts) FROM cells) - INTERVAL 10 MINUTE""")
def stream_captures(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed medians and frame statistics as a stream: all windows that the watermark has passed."""
    s = proxies.cells(spark, d).select("project_id", F.col("ts").cast("timestamp").alias("ts"), "y", "x", F.floor("depth").alias("raw"))
    rows = jobs.run_once(jobs.captures(_written_stream(spark, s, "samples"), "20 hours", due=40), spark, "append", "captures")
    return r6(rows.select("project_id", F.col("w.start").cast("timestamp_ntz").alias("w_start"), *[c for c in rows.columns if c not in ("project_id", "w")]))


@query("""WITH e AS (SELECT 'U' || user_id % 10 AS project_id, event_id, ts FROM events), l AS (SELECT project_id, max(ts) AS last FROM e GROUP BY ALL)
SELECT project_id, 'Videos/' || event_id || '_vid.h264' AS h264_file, ts AS start_time, CASE WHEN event_id % 150 = 0 THEN ts + INTERVAL 1 HOUR ELSE last END AS end_time, event_id % 150 <> 0 AS open FROM e JOIN l USING (project_id) WHERE event_id % 50 = 0""")
def stream_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Starts and stops paired as two streams; those still open end with the project's last frame."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("project_id"), F.concat(F.lit("Videos/"), F.col("event_id").cast("string"), F.lit("_vid.h264")).alias("h264_file"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    starts = e.where("event_id % 50 = 0").select("project_id", "h264_file", F.col("ts").alias("start_time"))
    stops = e.where("event_id % 150 = 0").select("project_id", "h264_file", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("stop_time"))
    pairs = jobs.run_once(jobs.recordings(_written_stream(spark, starts, "starts"), _written_stream(spark, stops, "stops")), spark, "append", "recordings")
    rows = jobs.close_recordings(starts, pairs, e.select("project_id", F.col("ts").alias("time")))
    return rows.select("project_id", "h264_file", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")], "open")


@query(_recursive(f"""WITH {proxies.CELLS}, c AS (SELECT cells.* REPLACE (coalesce(depth, -1e9) AS depth), max(ts) OVER (PARTITION BY project_id) AS last, hour(ts) BETWEEN 8 AND 17 AS light FROM cells
), dy AS (SELECT project_id, day, y, x, arg_min(depth, ts) AS a, arg_max(depth, ts) AS b FROM c WHERE light GROUP BY ALL
), ng AS (SELECT *, lag(b) OVER (PARTITION BY project_id, y, x ORDER BY day) AS p FROM dy
), v AS (SELECT project_id, 'last 1 h' AS window_id, y, x, arg_min(depth, ts) AS a, arg_max(depth, ts) AS b FROM c WHERE ts > last - INTERVAL 1 HOUR GROUP BY ALL
  UNION ALL SELECT project_id, 'last 2 h', y, x, arg_min(depth, ts), arg_max(depth, ts) FROM c WHERE ts > last - INTERVAL 2 HOUR GROUP BY ALL
  UNION ALL SELECT project_id, 'day ' || strftime(day, '%Y-%m-%d'), y, x, a, b FROM dy
  UNION ALL SELECT project_id, 'night ' || strftime(day, '%Y-%m-%d'), y, x, p, a FROM ng WHERE p IS NOT NULL
  UNION ALL SELECT project_id, 'trial', y, x, arg_min(depth, ts) FILTER (WHERE light), arg_max(depth, ts) FROM c GROUP BY ALL
), change AS (SELECT project_id, window_id, y, x, CASE WHEN a > -1e8 AND b > -1e8 THEN b - a END AS change, CASE WHEN window_id LIKE 'last%' THEN 0.8 ELSE 1.2 END AS lv FROM v){_regions_sql("abs", "lv")}
SELECT project_id, window_id, round(coalesce(sum(abs(c.change)), 0), 6) AS absolute, round(coalesce(sum(c.change), 0), 6) AS summed, count(c.change)::BIGINT AS n, count(r.y)::BIGINT AS n_region FROM change c LEFT JOIN (SELECT project_id, window_id, y, x FROM reg) r USING (project_id, window_id, y, x) GROUP BY ALL"""))
def live_view(spark: SparkSession, d: str) -> DataFrame:
    """The live monitor over all frames as they come, in six batches: the last view of each window."""
    c = proxies.cells(spark, d).select("project_id", "frame_idx", "y", "x", "depth", "ts")
    part = F.floor(F.col("frame_idx") * 6 / proxies.FRAMES_PER_PROJECT).cast("int")
    path, out, log, whole = (shared.place(spark, k) for k in ("frames", "live", "live-log", "cells"))
    c.withColumn("part", part).repartition("project_id", "y", "x").write.partitionBy("part").parquet(whole)
    for k in range(6):  # one after another, as a recording writes them; a batch may have many files
        spark.read.parquet(whole).where(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        stream = spark.readStream.schema(c.schema).parquet(path)
        jobs.live_monitor(stream, out, log, (0.8, 1.2), LEAST, (1, 2)).awaitTermination()
    changes, found = (spark.read.parquet(f"{out}/{k}") for k in ("changes", "regions"))
    last = changes.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    n = found.groupBy(*KEYS, "batch").agg(F.count("*").alias("n_region"))
    rows = changes.join(last, [*KEYS, "batch"]).join(n, [*KEYS, "batch"], "left")
    return r6(rows.select(*KEYS, "absolute", "summed", "n", F.coalesce("n_region", F.lit(0)).alias("n_region")))


@query("""WITH f AS (SELECT 'U' || user_id % 10 AS project_id, ts, floor(value / 100)::BIGINT AS gp, CASE WHEN event_type = 'error' THEN 0.05 ELSE 0.000001 END AS std FROM events
), r AS (SELECT *, lead(gp) OVER o AS prev, row_number() OVER o AS k, (SELECT max(ts) FROM f) AS now FROM f WINDOW o AS (PARTITION BY project_id ORDER BY ts DESC))
SELECT project_id, ts AS last_frame, gp, coalesce(std < 0.00001 AND gp = prev, false) AS stuck, now - ts > INTERVAL 15 MINUTE AS silent FROM r WHERE k = 1""")
def live_status(spark: SparkSession, d: str) -> DataFrame:
    """Stuck and silent projects by their frame records."""
    e = spark.read.parquet(f"{d}/events.parquet")
    std = F.when(F.col("event_type") == "error", 0.05).otherwise(0.000001)
    return jobs.live_status(e.select(F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("project_id"), "ts", F.floor(F.col("value") / 100).cast("long").alias("gp"), std.alias("std")))


@query(f"""WITH {proxies.CELLS}, e AS (SELECT project_id, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM cells GROUP BY ALL
), m AS (SELECT c.project_id, median(depth) AS middle FROM cells c JOIN e ON e.project_id = c.project_id AND c.frame_idx = f0 GROUP BY ALL
), b AS (SELECT a.project_id, a.y, a.x, a.depth AS a, z.depth AS b, middle, coalesce((a.depth + z.depth) / 2, a.depth, z.depth) AS mean FROM e JOIN cells a ON a.project_id = e.project_id AND a.frame_idx = f0 JOIN cells z ON z.project_id = e.project_id AND z.frame_idx = f1 AND z.y = a.y AND z.x = a.x JOIN m ON m.project_id = e.project_id)
SELECT project_id, y, x, CASE WHEN NOT coalesce(mean > middle + {PARAMS.max_depth} OR mean < middle - {PARAMS.max_height}, false) THEN round(b - a, 6) END AS change FROM b""")
def two_frame_difference(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d)
    ends = c.groupBy("project_id").agg(F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"))
    return r6(depth.two_frame_difference(c, ends))


@query(f"""{_change_sql()}, s AS (SELECT project_id, window_id, round(max(abs(change)), 6) AS vmax, round(0.75 * max(abs(change)), 6) AS scale, round(quantile_cont(abs(change), 0.99), 6) AS q99, round(median(change), 6) AS middle FROM change GROUP BY ALL)
SELECT *, max(q99) OVER (PARTITION BY project_id ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS q99_so_far FROM s""")
def map_scales(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.scales(_change(spark, d), KEYS, order="window_id"))


@query("""WITH b AS (SELECT (l_suppkey % 10)::VARCHAR AS base_name, l_orderkey * 10 + l_linenumber AS box_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY md5('0/' || box_id), box_id) AS k FROM b) SELECT base_name, box_id FROM r WHERE k <= 50""")
def box_sample(spark: SparkSession, d: str) -> DataFrame:
    """The fifty boxes of each video whose digests are least."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 10).cast("string").alias("base_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"))
    return tracks.sample(x, "box_id", 50, ["base_name"])


# --- contents of files ---------------------------------------------------------------------------------


@query("""SELECT vec_id AS id, (pos // 8)::INT AS y, (pos % 8)::INT AS x, round(v::DOUBLE, 6) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)""")
def array_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as the content of an array file of 8 by 8, decoded to cells."""

    def encode(batches):
        import io

        for batch in batches:
            out = []
            for v in batch["embedding"].to_pylist():
                sink = io.BytesIO()
                np.save(sink, np.array(v, np.float32).reshape(8, 8))
                out.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.string()), pa.array(out, pa.binary())], names=["file", "content"])

    content = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(encode, "file string, content binary")
    return r6(files.array_cells(content).select(F.col("file").cast("long").alias("id"), "y", "x", "value"))


@query("""SELECT vec_id AS id, (pos // 8)::INT AS y, (pos % 8)::INT AS x, round(v::DOUBLE, 6) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)""")
def array_source(spark: SparkSession, d: str) -> DataFrame:
    """Every fifty embeddings written as one array file to the shared folder, read through the data source in bands and batches."""
    arrays.register(spark)
    path = shared.place(spark, "arrays")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).cast("long").alias("g"), (F.col("vec_id") % 50).alias("k"), "embedding")

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root)
        for batch in batches:
            for g, rows in zip(batch["g"].to_pylist(), batch["rows"].to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{g}.npy") as f:
                    np.save(f, np.array([r["embedding"] for r in rows], np.float32))
            yield pa.RecordBatch.from_arrays([batch["g"]], names=["g"])

    e.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "embedding"))).alias("rows")).mapInArrow(write, "g long").count()  # fifty rows a group
    cells = spark.read.format("npy").option("band_bytes", "4096").load(path)
    g = F.regexp_extract("file", r"(\d+)\.npy$", 1).cast("long")
    return r6(cells.select((g * 50 + F.col("y")).alias("id"), F.floor(F.col("x") / 8).cast("int").alias("y"), (F.col("x") % 8).cast("int").alias("x"), "value"))


@query("""SELECT 'v' || l_suppkey % 10 AS base_name, (l_orderkey % 2000)::INT AS frame, round((l_tax - l_discount / 2) * 1296, 4) AS x1, round((l_discount - l_tax / 2) * 972, 4) AS y1, round((l_tax + l_discount / 2) * 1296, 4) AS x2, round((l_discount + l_tax / 2) * 972, 4) AS y2, 0.5::DOUBLE AS score, (l_linenumber % 2)::DOUBLE AS class_id FROM lineitem""")
def detection_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of box files, one for each line item."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    s = lambda c: F.col(c).cast("string")
    line = F.concat_ws(" ", (F.col("l_linenumber") % 2).cast("string"), s("l_tax"), s("l_discount"), s("l_discount"), s("l_tax"), F.lit("0.5"))
    name = F.concat(F.lit("/boxes/v"), (F.col("l_suppkey") % 10).cast("string"), F.lit("_"), (F.col("l_orderkey") % 2000).cast("string"), F.lit(".txt"))
    rows = files.detection_rows(x.select(name.alias("file"), line.alias("value")))
    return rows.select("base_name", "frame", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")], "score", "class_id")


@query("""SELECT 'P' || o_orderkey AS project_id, [least(o_custkey % 50, o_orderkey % 70), least(o_custkey % 40, o_orderkey % 60), greatest(o_custkey % 50, o_orderkey % 70), greatest(o_custkey % 40, o_orderkey % 60)]::INT[]::VARCHAR AS tray, 3::BIGINT AS n_vertices, round(o_custkey % 50 + 0.5, 6) AS first_x FROM orders""")
def geometry_rows(spark: SparkSession, d: str) -> DataFrame:
    """A tray file and a polygon file for each order."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = lambda c, k: (F.col(c) % k).cast("string")
    file = lambda name: F.concat(F.lit("/data/P"), F.col("o_orderkey").cast("string"), F.lit(f"/{name}.txt")).alias("file")
    trays = files.tray_rows(o.select(file("tray"), F.concat_ws(",", s("o_custkey", 50), s("o_custkey", 40), s("o_orderkey", 70), s("o_orderkey", 60)).alias("value")))
    shapes = files.polygon_rows(o.select(file("crop"), F.concat(s("o_custkey", 50), F.lit(".5,1\n\n3,4\n5,"), s("o_orderkey", 60), F.lit("\n")).alias("value")))
    text = F.concat(F.lit("["), F.array_join("tray", ", "), F.lit("]"))
    return trays.join(shapes, "project_id").select("project_id", text.alias("tray"), F.size("vertices").cast("long").alias("n_vertices"), F.element_at("vertices", 1)["x"].alias("first_x"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'changed' WHEN c_custkey % 3 = 0 THEN 'old' WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'late' END AS origin, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 THEN c_nationkey END AS nation
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 OR c_custkey % 7 = 0""")
def stored_updates(spark: SparkSession, d: str) -> DataFrame:
    """A stored table begun, inserted into, updated and appended to, a version each time."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    root = shared.place(spark, "table")
    part = lambda cond, origin: c.where(cond).select(F.col("c_custkey").alias("id"), F.lit(origin).alias("origin"))
    catalog.store_insert(spark, root, part("c_custkey % 3 = 0", "old"), "id")
    catalog.store_insert(spark, root, part("c_custkey % 2 = 0", "new"), "id")
    catalog.store_update(spark, root, c.where("c_custkey % 15 = 0").select(F.col("c_custkey").alias("id"), F.lit("changed").alias("value")), "id", "origin")
    late = c.where("c_custkey % 7 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 2 <> 0").select(F.col("c_custkey").alias("id"), F.lit("late").alias("origin"), F.col("c_nationkey").alias("nation"))
    return catalog.store_append(spark, root, late)
