"""Composite reports and the model hook, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.operators import depth, reports, scoring
from reefline.plans import proxies
from reefline.plans.q_depth import FRAMES, GOOD, KEYS, LEAST, LEVELS, _change_sql, _recursive, _regions_sql, _windows_sql, change_in, level_sql, r6, summary_in
from reefline.plans.q_events import DENSITY, _grid, densities_in, density_in
from reefline.schemas import PARAMS

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sheet(grain: str) -> str:
    body = f"{_change_sql(grain)}, {GOOD}, {summary_in()}"
    return f"SELECT * FROM ({_recursive(body)} SELECT s.*, t0 AS start_time, make_timestamp(epoch_us(t0) + (epoch_us(t1) - epoch_us(t0)) // 2) AS midpoint, '{grain}' AS grain FROM s JOIN w USING (project_id, window_id))"


@query(" UNION ALL ".join(map(_sheet, reports.GRAINS)))
def depth_report(spark: SparkSession, d: str) -> DataFrame:
    return r6(reports.depth_report(proxies.cells(spark, d), min_pixels=LEAST, levels=LEVELS))


BIDS = "cpbf"
_CASES = ", ".join(f"count(*) FILTER (WHERE e.\"Prediction\" = '{b}')::BIGINT AS n_{b}" for b in BIDS)
_NEAR = f"""{proxies.CELLS}, {FRAMES}, ref AS (SELECT project_id, max(ts) + INTERVAL 37 MINUTE AS ev_at FROM fr GROUP BY ALL
), ev AS (SELECT 'P' || user_id % (SELECT ceil(count(*) / {proxies.FRAMES_PER_PROJECT}.0)::BIGINT FROM embeddings) AS project_id, ts AS "TimeStamp", CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'p' WHEN 'purchase' THEN 'b' WHEN 'signup' THEN 'f' END AS "Prediction",
  (value % 100.0) / 10 AS px, json_extract_string(props, '$.k')::DOUBLE / 10 AS py, (value % 7.0 + 1 + value % 5.0 + 1) / 4 AS radius FROM events
), steps AS (SELECT project_id, k::INT AS window_id, ev_at, ev_at - INTERVAL 5 MINUTE - to_minutes((9 - k) * 10) AS t0, ev_at - INTERVAL 5 MINUTE - to_minutes((8 - k) * 10) AS t1 FROM ref, (SELECT unnest(range(9)) AS k)
), span AS (SELECT project_id, -1 AS window_id, ev_at, ev_at - INTERVAL 95 MINUTE AS t0, ev_at - INTERVAL 5 MINUTE AS t1 FROM ref)"""


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, events and a reference event for each project, shortly after its last frame."""
    c = proxies.cells(spark, d)
    ref = c.groupBy(F.col("project_id").alias("pid")).agg((F.max("ts") + F.expr("INTERVAL '37' MINUTE")).alias("dissection_time"))
    ref = ref.withColumn("behave_or_control", F.when(F.substring("pid", 2, 9).cast("long") % 2 == 0, "B").otherwise("C"))
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    projects = -(-n // proxies.FRAMES_PER_PROJECT)
    e = proxies.clusters(spark, d).withColumn("project_id", F.concat(F.lit("P"), (F.substring("project_id", 2, 9).cast("long") % projects).cast("string")))
    e = e.withColumns({"radius": (F.col("X_span") + F.col("Y_span")) / 4, "X": F.col("X") / 10, "Y": F.col("Y") / 10})
    return c, e, ref


#: Agreement of the regions behind the two summaries of the windows w.
_AGREE_SUMMARY = """j AS (SELECT project_id, window_id, count(*) FILTER (WHERE a.label = b.label) AS n_same, count(*) AS n
  FROM (SELECT project_id, window_id, y, x, label FROM reg) a FULL JOIN (SELECT project_id, window_id, y, x, label FROM d_reg) b USING (project_id, window_id, y, x) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_NEAR}, w AS (SELECT * FROM steps UNION ALL SELECT * FROM span), {change_in()}, {GOOD}, {summary_in()}, {densities_in()}, {_AGREE_SUMMARY}
, n AS (SELECT w.project_id, w.window_id, {_CASES}, count(e."Prediction")::BIGINT AS n_all FROM w LEFT JOIN ev e ON e.project_id = w.project_id AND e."TimeStamp" BETWEEN w.t0 AND w.t1 GROUP BY ALL)
SELECT w.project_id, w.window_id, round(epoch(ev_at - t0) / 60, 6) AS minutes_start, round(epoch(ev_at - t1) / 60, 6) AS minutes_stop, s.absolute_volume, s.summed_volume, s.bower_index, d_s.absolute_volume AS kde_absolute_volume, d_s.summed_volume AS kde_summed_volume, d_s.bower_index AS kde_bower_index, round(CASE WHEN j.n IS NULL THEN 1.0 ELSE j.n_same / j.n END, 6) AS agreement, n_c, n_p, n_b, n_f, n_all
FROM w JOIN s USING (project_id, window_id) JOIN n USING (project_id, window_id) JOIN d_s USING (project_id, window_id) LEFT JOIN j USING (project_id, window_id)""")
def pre_event_detail(spark: SparkSession, d: str) -> DataFrame:
    c, e, ref = _near(spark, d)
    rows = reports.pre_event_report(c, e, ref, list(BIDS), _grid(spark), LEAST, LEVELS, DENSITY)
    kde = ("kde_absolute_volume", "kde_summed_volume", "kde_bower_index")
    return r6(rows.select(*KEYS, "minutes_start", "minutes_stop", "absolute_volume", "summed_volume", "bower_index", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in kde], "agreement", "n_c", "n_p", "n_b", "n_f", "n_all"))


_MASK = f"""wf AS (SELECT * REPLACE (0 AS window_id) FROM span), {change_in("wf", "fw", True)}, ft AS (SELECT c.*, {level_sql(LEVELS)} AS lv FROM fw c JOIN wf USING (project_id, window_id)){_regions_sql("signed", "lv", "ft", "f_")}"""
_VOLUMES = f"round(coalesce(sum(CASE WHEN r.y IS NOT NULL THEN abs(c.change) END), 0) * {PARAMS.area}, 6) AS inside, round(coalesce(sum(abs(c.change)), 0) * {PARAMS.area}, 6) AS overall"


@query(f"""WITH RECURSIVE {_NEAR}, {_MASK}, {change_in("wf")}, v AS (SELECT c.project_id, {_VOLUMES} FROM change c LEFT JOIN f_reg r USING (project_id, y, x) GROUP BY ALL
), n AS (SELECT wf.project_id, {_CASES}, count(*) FILTER (WHERE e."Prediction" IN ('c', 'p', 'b'))::BIGINT AS n_building, count(*) FILTER (WHERE e."Prediction" IN ('f', 't', 'm'))::BIGINT AS n_feeding FROM wf LEFT JOIN ev e ON e.project_id = wf.project_id AND e."TimeStamp" BETWEEN t0 AND t1 GROUP BY ALL)
SELECT n.*, CASE WHEN substr(n.project_id, 2)::INT % 2 = 0 THEN 'B' ELSE 'C' END AS behave_or_control, inside, overall FROM n LEFT JOIN v USING (project_id)""")
def cohort_total(spark: SparkSession, d: str) -> DataFrame:
    c, e, ref = _near(spark, d)
    return r6(reports.cohort_total(e, c, ref, list(BIDS), LEAST, LEVELS))


@query(f"""WITH RECURSIVE {_NEAR}, {_MASK}, {change_in("steps")}, v AS (SELECT c.project_id, c.window_id, {_VOLUMES} FROM change c LEFT JOIN (SELECT project_id, y, x FROM f_reg) r USING (project_id, y, x) GROUP BY ALL)
SELECT project_id, window_id, round(epoch(ev_at - t0) / 60, 6) AS minutes_start, round(epoch(ev_at - t1) / 60, 6) AS minutes_stop, inside, overall, round(sum(inside) OVER (PARTITION BY project_id ORDER BY window_id ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM v JOIN steps USING (project_id, window_id)""")
def cohort_depth_detail(spark: SparkSession, d: str) -> DataFrame:
    c, _, ref = _near(spark, d)
    return r6(reports.cohort_depth_detail(c, ref, LEAST, LEVELS))


_AGREE = """reg_d AS (SELECT project_id, window_id, y, x, label FROM reg), reg_k AS (SELECT project_id, window_id, y, x, label FROM k_reg
), j AS (SELECT project_id, window_id, count(a.label) AS n_depth, count(b.label) AS n_density, count(*) FILTER (WHERE a.label = b.label) AS n_same, count(*) AS n FROM reg_d a FULL JOIN reg_k b USING (project_id, window_id, y, x) GROUP BY ALL)"""
_FAMILIES = f"""{change_in()}, dt AS (SELECT c.*, {level_sql(LEVELS)} AS lv FROM change c JOIN w USING (project_id, window_id)){_regions_sql("signed", "lv", "dt", "", LEAST)}
, {density_in("spit", "p")}, {density_in("scoop", "c")}, kt AS (SELECT spit.project_id, spit.window_id, spit.y, spit.x, spit.z - scoop.z AS change, {level_sql(DENSITY)} AS lv FROM spit JOIN scoop USING (project_id, window_id, y, x) JOIN w USING (project_id, window_id)){_regions_sql("signed", "lv", "kt", "k_", LEAST)}"""


@query(f"""WITH RECURSIVE {_NEAR}, wd AS ({_windows_sql("daily")}), w AS (SELECT * FROM wd UNION ALL SELECT project_id, 'trial', min(t0), max(t1) FROM wd GROUP BY project_id), {_FAMILIES}, {_AGREE}
SELECT w.project_id, w.window_id, coalesce(n_depth, 0)::BIGINT AS n_depth, coalesce(n_density, 0)::BIGINT AS n_density, coalesce(n_same, 0)::BIGINT AS n_same, round(CASE WHEN n IS NULL THEN 1.0 ELSE n_same / n END, 6) AS agreement FROM w LEFT JOIN j USING (project_id, window_id)""")
def region_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Regions of height change against regions of event density, by day and over the trial."""
    c, e, _ = _near(spark, d)
    frames = depth.frame_times(c)
    return r6(reports.region_consistency(c, e, reports.trial_windows(frames), _grid(spark), LEAST, LEVELS, DENSITY, frames))


def _load():
    """A stand-in for a trained model: two logits from a box's size."""

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"logit_0": batch["w"] / 10, "logit_1": batch["h"] / 10})

    return model


@query("""SELECT l_orderkey, l_linenumber, round((l_tax * 400 + 10) / 10, 6) AS logit_0, round((l_discount * 300 + 10) / 10, 6) AS logit_1 FROM lineitem""")
def score_hook(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 400 + 10).alias("w"), (F.col("l_discount") * 300 + 10).alias("h"))
    return r6(scoring.score(x, _load, ["w", "h"], ["l_orderkey", "l_linenumber"], "logit_0 double, logit_1 double"))
