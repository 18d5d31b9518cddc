"""Event, density and report queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.expr import approx_radius, arg_max, category, crop_box, hour_bin, in_polygon, in_polygon_array, minutes_to, project, seconds_to, softmax, unit_colour
from reefline.operators import events, reports, tracks
from reefline.plans import proxies
from reefline.plans.q_depth import _INSIDE, _POLYGON, _windows_sql, r6, summary_in
from reefline.schemas import CATEGORIES, PARAMS

QUERIES, ORACLES = {}, {}
CL, REF = proxies.CLUSTERS, proxies.REFERENCE
BIDS = ["c", "p", "b", "f"]
MATRIX = [0.9, 0.05, 3.0, -0.02, 1.1, 2.0, 0.0005, 0.0002, 1.0]
_DET = 0.9 * (1.1 * 1.0 - 2.0 * 0.0002) - 0.05 * (-0.02 * 1.0 - 2.0 * 0.0005) + 3.0 * (-0.02 * 0.0002 - 1.1 * 0.0005)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CL} SELECT "LID", "TimeStamp", "Prediction", round("X" - 10, 6) AS "X", round("Y" - 5, 6) AS "Y" FROM clusters
WHERE "Prediction" IN ('c', 'p') AND "TimeStamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND "X" > 10 AND "X" < 90 AND "Y" > 5 AND "Y" < 80""")
def event_slice(spark: SparkSession, d: str) -> DataFrame:
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return r6(events.event_slice(proxies.clusters(spark, d), t("2024-01-05"), t("2024-01-20"), ["c", "p"], (10, 5, 90, 80), ["LID", "TimeStamp", "Prediction", "X", "Y"]))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE \"Prediction\" = '{b}')::BIGINT AS n_{b}" for b in BIDS)


@query(f"""WITH {CL} SELECT project_id, {_COUNTS}, count("Prediction")::BIGINT AS n_all FROM clusters GROUP BY ALL""")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.event_counts(proxies.clusters(spark, d), ["project_id"], BIDS)


@query(f"""WITH {CL} SELECT "VideoID", CAST("TimeStamp" AS DATE) AS day, {_COUNTS}, count("Prediction")::BIGINT AS n_all FROM clusters GROUP BY ALL""")
def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.clusters(spark, d).withColumn("day", F.to_date("TimeStamp"))
    return events.event_counts(c, ["VideoID", "day"], BIDS)


_M = MATRIX


@query(f"""WITH {CL} SELECT "LID", round(({_M[3]} * "Y" + {_M[4]} * "X" + {_M[5]}) / ({_M[6]} * "Y" + {_M[7]} * "X" + {_M[8]}), 6) AS x_depth,
  round(({_M[0]} * "Y" + {_M[1]} * "X" + {_M[2]}) / ({_M[6]} * "Y" + {_M[7]} * "X" + {_M[8]}), 6) AS y_depth, round(("X_span" + "Y_span") * sqrt({_DET}) / 2, 6) AS radius FROM clusters""")
def project_coords(spark: SparkSession, d: str) -> DataFrame:
    x, y = project(F.col("X"), F.col("Y"), MATRIX)
    return r6(proxies.clusters(spark, d).select("LID", x.alias("x_depth"), y.alias("y_depth"), approx_radius(F.col("X_span"), F.col("Y_span"), MATRIX).alias("radius")))


@query(f"""WITH {CL}, pts AS (SELECT "LID" AS id, ("X" + "X_span" / 2) / 14 AS px, ("Y" + "Y_span" / 2) / 14 AS py FROM clusters), {_INSIDE}
SELECT id AS "LID", odd AND NOT edge AS inside FROM t""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    px, py = (F.col("X") + F.col("X_span") / 2) / 14, (F.col("Y") + F.col("Y_span") / 2) / 14
    return proxies.clusters(spark, d).select("LID", in_polygon(px, py, _POLYGON).alias("inside"))


GRID = 10


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(GRID * GRID).select(F.floor(F.col("id") / GRID).cast("int").alias("y"), (F.col("id") % GRID).cast("int").alias("x"))


def video_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by video, with places on the grid and a radius."""
    return proxies.clusters(spark, d).select(F.col("VideoID").alias("project_id"), "TimeStamp", "Prediction", (F.col("X") / 10).alias("X"), (F.col("Y") / 10).alias("Y"), ((F.col("X_span") + F.col("Y_span")) / 4).alias("radius"))


EVENTS = """ev AS (SELECT "VideoID" AS project_id, "TimeStamp", "Prediction", "X" / 10 AS px, "Y" / 10 AS py, ("X_span" + "Y_span") / 4 AS radius FROM clusters)"""


def density_in(name: str, bid: str) -> str:
    """CTEs of the density ``name`` of one behaviour in each of the windows w; needs ev."""
    return f"""{name}_e AS (SELECT w.project_id, w.window_id, px, py, radius FROM ev JOIN w ON w.project_id = ev.project_id AND "TimeStamp" BETWEEN t0 AND t1 WHERE "Prediction" = '{bid}' AND px IS NOT NULL AND py IS NOT NULL
), {name}_h AS (SELECT project_id, window_id, greatest(0.25, avg(radius) / 2) AS h, count(*) AS n FROM {name}_e GROUP BY ALL
), {name}_z AS (SELECT project_id, window_id, (g // {GRID})::INT AS y, (g % {GRID})::INT AS x, any_value(n) AS n, sum(exp(-((px - g % {GRID}) * (px - g % {GRID}) + (py - g // {GRID}) * (py - g // {GRID})) / (2 * h * h))) AS z FROM {name}_e JOIN {name}_h USING (project_id, window_id), (SELECT unnest(range({GRID * GRID})) AS g) GROUP BY ALL
), {name} AS (SELECT w.project_id, w.window_id, (g // {GRID})::INT AS y, (g % {GRID})::INT AS x, coalesce(k.z, 0) AS z FROM w CROSS JOIN (SELECT unnest(range({GRID * GRID})) AS g)
  LEFT JOIN (SELECT project_id, window_id, y, x, z * n / (sum(z) OVER (PARTITION BY project_id, window_id) * {PARAMS.area}) AS z FROM {name}_z) k ON k.project_id = w.project_id AND k.window_id = w.window_id AND k.y = g // {GRID} AND k.x = g % {GRID})"""


#: Density thresholds of the proxies.
DENSITY, DENSE = (0.5, 2.0, 20.0), 3


def densities_in() -> str:
    """CTEs of the cluster summary ``d_s`` of the windows w."""
    return f"""{density_in("spit", "p")}, {density_in("scoop", "c")}, df AS (SELECT project_id, window_id, y, x, spit.z - scoop.z AS change FROM spit JOIN scoop USING (project_id, window_id, y, x)), {summary_in("df", "w", "d_", DENSITY, str(GRID * GRID), DENSE, 4)}"""


@query(f"""WITH {CL}, {EVENTS}, w AS (SELECT DISTINCT project_id, 'total' AS window_id, TIMESTAMP '2000-01-01' AS t0, TIMESTAMP '2100-01-01' AS t1 FROM ev), {density_in("k", "p")} SELECT project_id, y, x, round(z, 4) AS z FROM k""")
def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    e = video_events(spark, d)
    return events.density_grid(e.where("Prediction = 'p'"), _grid(spark), ["project_id"], windows=e).withColumn("z", F.round("z", 4))


def _clusters_sql(grain: str) -> str:
    return f"""WITH RECURSIVE {CL}, {EVENTS}, fr AS (SELECT project_id, "TimeStamp" AS ts FROM ev), w AS ({_windows_sql(grain)}), {densities_in()}
SELECT s.*, t0 AS start_time, make_timestamp(epoch_us(t0) + (epoch_us(t1) - epoch_us(t0)) // 2) AS midpoint, '{grain}' AS grain FROM d_s s JOIN w USING (project_id, window_id)"""


def r4(df: DataFrame) -> DataFrame:
    """Doubles at four places; no negative zero."""
    return df.select(*[(F.round(F.col(c), 4) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _report(spark: SparkSession, d: str, grains: tuple[str, ...]) -> DataFrame:
    e = video_events(spark, d)
    return r4(reports.cluster_report(e, e.select("project_id", F.col("TimeStamp").alias("ts")), _grid(spark), grains, DENSE, DENSITY))


@query(_clusters_sql("daily"))
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, ("daily",))


@query(" UNION ALL ".join(f"SELECT * FROM ({_clusters_sql(g)})" for g in ("total", "two_hourly")))
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, ("total", "two_hourly"))


GROUPS = {"building": ["c", "p", "b"], "feeding": ["f", "t", "m"], "scoop": ["c"], "spit": ["p"]}
_STEPS = f"""{REF}, w AS (SELECT pid AS project_id, k::INT AS window_id, dissection_time AS ev, dissection_time - INTERVAL 5 MINUTE - to_minutes((9 - k) * 10) AS t0, dissection_time - INTERVAL 5 MINUTE - to_minutes((8 - k) * 10) AS t1 FROM ref, (SELECT unnest(range(9)) AS k))"""
_GROUPS = ", ".join(f"('{g}', '{b}')" for g, bs in GROUPS.items() for b in bs)


@query(f"""WITH {CL}, {_STEPS}, g(grp, bid) AS (VALUES {_GROUPS}), n AS (
  SELECT w.project_id, w.window_id, g.grp, count(*) AS n FROM w JOIN clusters c ON c.project_id = w.project_id AND c."TimeStamp" BETWEEN t0 AND t1 JOIN g ON g.bid = c."Prediction" GROUP BY ALL
)
SELECT w.project_id, w.window_id, x.grp, coalesce(n.n, 0)::BIGINT AS n, round(epoch(ev - t0) / 60.0, 6) AS minutes_start, round(epoch(ev - t1) / 60.0, 6) AS minutes_stop
FROM w CROSS JOIN (SELECT DISTINCT grp FROM g) x LEFT JOIN n ON n.project_id = w.project_id AND n.window_id = w.window_id AND n.grp = x.grp""")
def cohort_cluster_detail(spark: SparkSession, d: str) -> DataFrame:
    return r6(reports.cluster_detail(proxies.clusters(spark, d), reports.steps_before(proxies.reference_events(spark, d)), GROUPS))


@query(f"""WITH {CL}, {REF} SELECT behave_or_control, bin::INT AS bin, "Prediction", count(*)::BIGINT AS n, round(min(minutes), 3) AS least_minutes FROM (
  SELECT behave_or_control, "Prediction", floor(epoch(dissection_time - "TimeStamp") / 7200) * 2 AS bin, (epoch_us(dissection_time) - epoch_us("TimeStamp")) % 86400000000 / 60000000.0 AS minutes FROM clusters JOIN ref ON pid = project_id WHERE "Prediction" IS NOT NULL
) GROUP BY ALL""")
def time_bins(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.clusters(spark, d).where(F.col("Prediction").isNotNull()).join(proxies.reference_events(spark, d).withColumnRenamed("pid", "project_id"), "project_id")
    s = seconds_to(F.col("dissection_time"), F.col("TimeStamp"))
    rows = c.select("behave_or_control", "Prediction", hour_bin(s).alias("bin"), minutes_to(F.col("dissection_time"), F.col("TimeStamp")).alias("m"))
    return r6(rows.groupBy("behave_or_control", "bin", "Prediction").agg(F.count("*").alias("n"), F.round(F.min("m"), 3).alias("least_minutes")))


_CASE = "CASE \"Prediction\" " + " ".join(f"WHEN '{b}' THEN '{c}'" for b, c in CATEGORIES.items()) + " END"


@query(f"""WITH {CL} SELECT "VideoID", coalesce({_CASE}, 'Other') AS category, count(*)::BIGINT AS n, round(avg(CASE WHEN "X" > 50 THEN 1.0 ELSE 0.0 END), 6) AS mean_class, CASE WHEN avg(CASE WHEN "X" > 50 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'Male' ELSE 'Female' END AS sex FROM clusters GROUP BY ALL""")
def sex_summary(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.clusters(spark, d).withColumn("category", F.coalesce(category(F.col("Prediction"), CATEGORIES), F.lit("Other")))
    mean = F.avg((F.col("X") > 50).cast("double"))
    return r6(c.groupBy("VideoID", "category").agg(F.count("*").alias("n"), mean.alias("mean_class"), F.when(mean > 0.5, "Male").otherwise("Female").alias("sex")))


@query(f"""WITH {CL} SELECT project_id, round(count(*) FILTER (WHERE coalesce({_CASE}, 'Other') = 'Other') / count(*), 6) AS other_share, count(*)::BIGINT AS n FROM clusters GROUP BY ALL""")
def category_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.clusters(spark, d).withColumn("category", F.coalesce(category(F.col("Prediction"), CATEGORIES), F.lit("Other")))
    return r6(events.category_ratio(c, ["project_id"]))


@query("""SELECT user_id % 20 AS pid, count(*) FILTER (WHERE event_type || '/' || (event_id % 2) = 'click/0')::BIGINT AS "MM", count(*) FILTER (WHERE event_type || '/' || (event_id % 2) = 'click/1')::BIGINT AS "MF",
  count(*) FILTER (WHERE event_type || '/' || (event_id % 2) = 'view/0')::BIGINT AS "FM", count(*) FILTER (WHERE event_type || '/' || (event_id % 2) = 'view/1')::BIGINT AS "FF" FROM events GROUP BY ALL""")
def label_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("pid"), "event_type", (F.col("event_id") % 2).alias("s"))
    kind = F.when(F.col("event_type") == "click", F.when(F.col("s") == 0, "MM").otherwise("MF")).when(F.col("event_type") == "view", F.when(F.col("s") == 0, "FM").otherwise("FF"))
    return events.label_pairs(e, "pid", kind, ["MM", "MF", "FM", "FF"])


@query("""SELECT width_bucket_::INT AS bin, count(*)::BIGINT AS n FROM (SELECT least(30, floor((value - 0) * 30 / 500.0) + 1) AS width_bucket_ FROM events WHERE value BETWEEN 0 AND 500) GROUP BY ALL""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(spark.read.parquet(f"{d}/events.parquet"), "value", 0, 500, 30)


@query("""WITH e AS (SELECT vec_id, [exp(v::DOUBLE * 8) for v in embedding] AS p FROM embeddings)
SELECT vec_id, (list_position(p, list_max(p)) - 1)::INT AS sex_class, round(list_max(p) / list_sum(p), 6) AS sex_p_value FROM e""")
def softmax_class(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 8).alias("l"))
    return r6(e.select("vec_id", softmax(F.col("l")).alias("p")).select("vec_id", arg_max(F.col("p")).alias("sex_class"), F.array_max("p").alias("sex_p_value")))


@query(f"""WITH {proxies.TRACKS}, t AS (SELECT *, floor(greatest(trunc(w)::INT + 1, trunc(h)::INT + 1) / 2)::INT + 10 AS d FROM tracks)
SELECT base_name, track_id, frame, greatest(0, trunc(xc)::INT - d)::INT AS "left", greatest(0, trunc(yc)::INT - d)::INT AS top, least(1296, trunc(xc)::INT + d)::INT AS "right", least(972, trunc(yc)::INT + d)::INT AS bottom FROM t""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    return proxies.tracks(spark, d).select("base_name", "track_id", "frame", *crop_box(F.col("xc"), F.col("yc"), F.col("w"), F.col("h")))


_BOX = "\"X\" BETWEEN 10 AND 90 AND \"Y\" BETWEEN 5 AND 95"
_SEX = f"""{CL}, {proxies.TRACKS}, sx AS (SELECT base_name, track_id, count(*) AS frames, avg(class_id) AS cls FROM tracks WHERE p_value > 0.95 GROUP BY ALL
), ev AS (SELECT * FROM clusters WHERE "ClipCreated" = 'Yes'
), m AS (
  SELECT "LID", "VideoID", track_id, row_number() OVER (PARTITION BY "VideoID", "LID" ORDER BY (yc - "X") * (yc - "X") + (xc - "Y") * (xc - "Y"), frame, track_id) AS r
  FROM ev JOIN tracks ON base_name = "VideoID" AND frame > (t - 0.5) * 29 AND frame < (t + 0.5) * 29
), j AS (SELECT ev.*, m.track_id, frames, cls FROM ev JOIN m ON m."LID" = ev."LID" AND m."VideoID" = ev."VideoID" AND r = 1 JOIN sx ON base_name = ev."VideoID" AND sx.track_id = m.track_id)"""


@query(f"""WITH {_SEX}, {REF} SELECT project_id, {_CASE} AS category, CASE WHEN cls > 0.5 THEN 'Male' ELSE 'Female' END AS sex, (floor(-epoch(dissection_time - "TimeStamp") / 7200) * 2)::INT AS time_bin, count(*)::BIGINT AS n
FROM j JOIN ref ON pid = project_id WHERE frames > 10 AND {_CASE} IN ('Construction', 'Feeding') AND {_BOX} GROUP BY ALL""")
def sex_behaviour(spark: SparkSession, d: str) -> DataFrame:
    c, points = proxies.clusters(spark, d), proxies.tracks(spark, d)
    sexed = points.withColumns({"sex_p_value": F.col("p_value"), "sex_class": F.col("class_id")})
    inside = F.col("X").between(10, 90) & F.col("Y").between(5, 95)
    return events.sex_behaviour(c, tracks.associate(c, points), sexed, proxies.reference_events(spark, d), CATEGORIES, inside, 0.95, 10)


@query(f"""WITH {CL}, e AS (SELECT project_id, coalesce({_CASE}, 'Other') = 'Other' AS other, {_BOX} AS ins FROM clusters)
SELECT project_id, round(count(*) FILTER (WHERE NOT ins AND other) / nullif(count(*) FILTER (WHERE NOT ins), 0), 6) AS out_other_ratio, round(count(*) FILTER (WHERE ins AND other) / nullif(count(*) FILTER (WHERE ins), 0), 6) AS in_other_ratio FROM e GROUP BY ALL""")
def association_ratios(spark: SparkSession, d: str) -> DataFrame:
    inside = F.col("X").between(10, 90) & F.col("Y").between(5, 95)
    return r6(events.association_ratios(proxies.clusters(spark, d), CATEGORIES, inside))


@query("""SELECT vec_id, pos::INT AS pos, round((greatest(-5, least(5, v::DOUBLE * 20)) + 5) / 10, 6) AS colour FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)""")
def unit_colours(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return r6(e.select("vec_id", "pos", unit_colour(F.col("v").cast("double") * 20).alias("colour")))


@query(f"""WITH {CL}, pts AS (SELECT "LID" AS id, "X" / 14 AS px, "Y" / 14 AS py FROM clusters), {_INSIDE}
SELECT id AS "LID", odd AS inside FROM t""")
def point_in_row_polygon(spark: SparkSession, d: str) -> DataFrame:
    shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _POLYGON])
    rows = proxies.clusters(spark, d).select("LID", (F.col("X") / 14).alias("px"), (F.col("Y") / 14).alias("py"), shape.alias("shape"))
    return rows.select("LID", in_polygon_array(F.col("px"), F.col("py"), F.col("shape")).alias("inside"))
