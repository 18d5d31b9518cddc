"""Depth and region queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.expr import in_polygon, savgol_coefficients
from reefline.operators import depth, regions, reports
from reefline.plans import proxies
from reefline.schemas import PARAMS
from reefline.shared import written

QUERIES, ORACLES = {}, {}
CELLS = proxies.CELLS
AREA = PARAMS.area
KEYS = ["project_id", "window_id"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles at six places, as both engines compare them."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _windows_sql(grain: str) -> str:
    if grain == "total":
        return "SELECT project_id, 'total' AS window_id, min(ts) AS t0, max(ts) AS t1 FROM fr GROUP BY project_id"
    days = "SELECT project_id, CAST(unnest(generate_series(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP), CAST(CAST(max(ts) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM fr GROUP BY project_id"
    if grain == "daily":
        return f"SELECT project_id, strftime(d, '%Y-%m-%d') AS window_id, CAST(d AS TIMESTAMP) AS t0, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AS t1 FROM ({days})"
    n = 2 if grain == "two_hourly" else 1
    return f"SELECT project_id, strftime(d, '%Y-%m-%d') || ' ' || lpad(h::VARCHAR, 2, '0') AS window_id, CAST(d AS TIMESTAMP) + to_hours(h) AS t0, CAST(d AS TIMESTAMP) + to_hours(h + {n}) AS t1 FROM ({days}), (SELECT unnest(range(8, 18, {n})) AS h)"


FRAMES = "fr AS (SELECT DISTINCT project_id, frame_idx, ts FROM cells)"


def change_in(windows: str = "w", name: str = "change", forward: bool = False) -> str:
    """CTEs of the change in each of ``windows`` (project_id, window_id, t0, t1); needs cells and fr."""
    asof = lambda t: f"coalesce((SELECT max(frame_idx) FROM fr WHERE fr.project_id = {windows}.project_id AND fr.ts <= {windows}.{t}), (SELECT min(frame_idx) FROM fr WHERE fr.project_id = {windows}.project_id))"
    first = f"(SELECT min(frame_idx) FROM fr WHERE fr.project_id = {windows}.project_id AND fr.ts >= {windows}.t0)" if forward else asof("t0")
    return f"""{name}_b AS (SELECT {windows}.*, {first} AS f0, {asof("t1")} AS f1 FROM {windows}),
{name} AS (
  SELECT b.project_id, b.window_id, p.y, p.x, p.depth - q.depth AS change FROM {name}_b b
  JOIN cells p ON p.project_id = b.project_id AND p.frame_idx = b.f0
  JOIN cells q ON q.project_id = b.project_id AND q.frame_idx = b.f1 AND q.y = p.y AND q.x = p.x
)"""


def _change_sql(grain: str = "daily", forward: bool = False) -> str:
    return f"WITH {CELLS}, {FRAMES}, w AS ({_windows_sql(grain)}), {change_in('w', 'change', forward)}"


def _change(spark: SparkSession, d: str, grain: str = "daily", forward: bool = False) -> DataFrame:
    c = proxies.cells(spark, d)
    return depth.height_change(c, depth.calendar_windows(c, grain), forward)


@query(f"""{_change_sql()}
SELECT project_id, window_id, round(coalesce(sum(abs(change)), 0) * {AREA}, 6) AS absolute_volume, round(coalesce(sum(change), 0) * {AREA}, 6) AS summed_volume,
  count(change)::BIGINT AS n_pixels FROM change GROUP BY project_id, window_id""")
def height_change(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("change")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) * AREA
    return r6(_change(spark, d).groupBy(*KEYS).agg(total(F.abs(v)).alias("absolute_volume"), total(v).alias("summed_volume"), F.count(v).alias("n_pixels")))


@query(f"""{_change_sql("hourly", True)} SELECT project_id, window_id, y, x, round(change, 6) AS change FROM change""")
def force_window_change(spark: SparkSession, d: str) -> DataFrame:
    return r6(_change(spark, d, "hourly", True))


@query(f"""WITH {CELLS}, fr AS (SELECT DISTINCT project_id, frame_idx, ts FROM cells), q AS (
  SELECT project_id, k, t FROM (SELECT DISTINCT project_id FROM cells), (SELECT unnest(range(0, 12)) AS k) z, LATERAL (SELECT TIMESTAMP '2023-12-31 12:30:00' + to_hours(z.k * 23) AS t)
), a AS (SELECT q.*, coalesce((SELECT max(frame_idx) FROM fr WHERE fr.project_id = q.project_id AND fr.ts <= q.t), (SELECT min(frame_idx) FROM fr WHERE fr.project_id = q.project_id)) AS frame_idx FROM q)
SELECT a.project_id, a.k::BIGINT AS k, a.frame_idx, y, x, round(depth, 6) AS depth FROM a JOIN cells USING (project_id, frame_idx)""")
def asof_height(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d)
    times = c.select("project_id").distinct().crossJoin(F.broadcast(spark.range(12).withColumnRenamed("id", "k")))
    times = times.withColumn("t", F.expr("TIMESTAMP_NTZ '2023-12-31 12:30:00' + make_dt_interval(0, cast(k * 23 AS int))"))
    return r6(depth.height_at(c, times).select("project_id", "k", "frame_idx", "y", "x", "depth"))


@query(f"""WITH {CELLS} SELECT project_id, frame_idx, y, x, round(CASE WHEN depth IS NULL THEN NULL ELSE floor(depth * 10) * 0.001 * 100 END, 6) AS depth_cm FROM cells""")
def zero_to_null(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d)
    raw = F.coalesce(F.floor(F.col("depth") * 10), F.lit(0)).cast("bigint")
    return r6(c.select("project_id", "frame_idx", "y", "x", depth.zero_to_null(raw, 0.001).alias("depth_cm")))


@query(f"""WITH {CELLS}, s AS (SELECT project_id, frame_idx // 40 AS win, y, x, floor(depth)::BIGINT AS raw FROM cells
), m AS (SELECT project_id, win, y, x, raw, count(*) AS m FROM s WHERE raw IS NOT NULL GROUP BY ALL
), r AS (SELECT *, row_number() OVER o AS r, max(m) OVER (PARTITION BY project_id, win, y, x ORDER BY raw ROWS UNBOUNDED PRECEDING) AS worst FROM m WINDOW o AS (PARTITION BY project_id, win, y, x ORDER BY raw)
), k AS (SELECT s.* FROM s JOIN r USING (project_id, win, y, x, raw) WHERE NOT (r.r <= 3 AND r.worst <= 3)
), a AS (SELECT project_id, win, y, x, median(raw) AS median, stddev_pop(raw) AS std, count(*) AS n_kept FROM k GROUP BY ALL
), t AS (SELECT project_id, win, y, x, count(raw) AS n_good, count(*) - count(raw) AS n_bad FROM s GROUP BY ALL)
SELECT project_id, win::BIGINT AS win, y, x, n_good::BIGINT AS n_good, n_bad::BIGINT AS n_bad, round(median, 6) AS median, round(std, 6) AS std, coalesce(n_kept, 0)::BIGINT AS n_kept
FROM t LEFT JOIN a USING (project_id, win, y, x)""")
def trimmed_median(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d).select("project_id", F.floor(F.col("frame_idx") / 40).alias("win"), "y", "x", F.floor("depth").alias("raw"))
    return r6(depth.trimmed_median(c, ["project_id", "win", "y", "x"]))


_INTERP = f"""WITH {CELLS}, span AS (SELECT project_id, day, min(frame_idx) AS a, max(frame_idx) AS b FROM cells WHERE lof GROUP BY ALL
), r AS (SELECT c.*, coalesce(frame_idx >= a AND frame_idx < b, false) AS ins FROM cells c LEFT JOIN span USING (project_id, day)
), g AS (
  SELECT *, max(CASE WHEN depth IS NOT NULL THEN frame_idx END) OVER back AS lf, min(CASE WHEN depth IS NOT NULL THEN frame_idx END) OVER ahead AS rf, count(depth) OVER whole AS n, count(*) OVER whole AS m
  FROM r WINDOW back AS (PARTITION BY project_id, y, x, day, ins ORDER BY frame_idx ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY project_id, y, x, day, ins ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), whole AS (PARTITION BY project_id, y, x, day, ins)
), filled AS (
  SELECT g.project_id, g.frame_idx, g.y, g.x, g.ts, g.lof, g.day, CASE WHEN g.depth IS NOT NULL THEN g.depth WHEN ins AND n > {PARAMS.good_fraction} * m THEN
    coalesce(l.depth + (q.depth - l.depth) * (g.frame_idx - lf) / nullif(rf - lf, 0), l.depth, q.depth) END AS depth
  FROM g LEFT JOIN cells l ON l.project_id = g.project_id AND l.y = g.y AND l.x = g.x AND l.frame_idx = g.lf
    LEFT JOIN cells q ON q.project_id = g.project_id AND q.y = g.y AND q.x = g.x AND q.frame_idx = g.rf
)"""


@query(f"""{_INTERP} SELECT project_id, frame_idx, y, x, round(depth, 6) AS depth FROM filled""")
def gap_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.gap_interpolate(proxies.cells(spark, d)).select("project_id", "frame_idx", "y", "x", "depth"))


@query(f"""WITH {CELLS}, e AS (SELECT project_id, day, min(frame_idx) AS a, max(frame_idx) AS b FROM cells WHERE lof GROUP BY ALL
), m0 AS (SELECT project_id, day, 0 AS side, a AS mark FROM e UNION ALL SELECT project_id, day, 1, b FROM e
), m AS (SELECT project_id, mark, row_number() OVER o AS k, lag(mark) OVER o AS bef, lead(mark) OVER o AS aft FROM m0 WINDOW o AS (PARTITION BY project_id ORDER BY day, side)
), f AS (SELECT DISTINCT project_id, frame_idx FROM cells WHERE NOT lof
), n AS (SELECT f.project_id, f.frame_idx, m.*, row_number() OVER (PARTITION BY f.project_id, f.frame_idx ORDER BY abs(f.frame_idx - mark), k) AS rn FROM f JOIN m ON m.project_id = f.project_id
), p AS (SELECT project_id, frame_idx, mark AS b1, CASE WHEN bef IS NULL OR aft IS NULL THEN mark WHEN frame_idx > mark THEN aft ELSE bef END AS b2 FROM n WHERE rn = 1
)
SELECT c.project_id, c.frame_idx, c.y, c.x, round(CASE WHEN c.lof THEN c.depth ELSE coalesce((v1.depth + v2.depth) / 2, v1.depth, v2.depth) END, 6) AS depth
FROM cells c LEFT JOIN p ON NOT c.lof AND p.project_id = c.project_id AND p.frame_idx = c.frame_idx
LEFT JOIN cells v1 ON v1.project_id = c.project_id AND v1.frame_idx = p.b1 AND v1.y = c.y AND v1.x = c.x
LEFT JOIN cells v2 ON v2.project_id = c.project_id AND v2.frame_idx = p.b2 AND v2.y = c.y AND v2.x = c.x""")
def night_fill(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.night_fill(proxies.cells(spark, d)).select("project_id", "frame_idx", "y", "x", "depth"))


@query(f"""WITH {CELLS}, s AS (SELECT project_id, y, x, count(*) FILTER (WHERE lof) AS n, count(depth) FILTER (WHERE lof) AS n_good, avg(depth) FILTER (WHERE lof) AS mean, stddev_pop(depth) FILTER (WHERE lof) AS std FROM cells GROUP BY ALL
), m AS (SELECT project_id, median(mean) AS mid FROM s GROUP BY ALL
), f AS (SELECT s.*, n_good < {PARAMS.sparse_fraction} * n AS sparse, coalesce(std > {PARAMS.max_std}, false) AS noisy, coalesce(mean > mid + {PARAMS.max_depth} OR mean < mid - {PARAMS.max_height}, false) AS out_of_range FROM s JOIN m USING (project_id))
SELECT project_id, y, x, n_good::BIGINT AS n_good, round(mean, 6) AS mean, round(std, 6) AS std, sparse, noisy, out_of_range, NOT (sparse OR noisy OR out_of_range) AS good FROM f""")
def pixel_masks(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.pixel_masks(proxies.cells(spark, d)))


_W, _H = PARAMS.savgol_window, PARAMS.savgol_window // 2
_COEFF = ", ".join(f"({i - _H}, {c!r}::DOUBLE)" for i, c in enumerate(savgol_coefficients(_W, PARAMS.savgol_order)))


@query(f"""WITH {CELLS}, k(o, c) AS (VALUES {_COEFF}), s AS (SELECT project_id, y, x, frame_idx, coalesce(depth, 55.0) AS v, count(*) OVER (PARTITION BY project_id, y, x) AS n FROM cells
), mir AS (SELECT s.*, k.c, (((frame_idx + o) % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) AS m FROM s, k)
SELECT mir.project_id, mir.y, mir.x, mir.frame_idx, round(sum(mir.c * q.v), 6) AS depth
FROM mir JOIN s q ON q.project_id = mir.project_id AND q.y = mir.y AND q.x = mir.x AND q.frame_idx = least(mir.m, 2 * (mir.n - 1) - mir.m) GROUP BY ALL""")
def savgol_smooth(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d)
    return r6(depth.savgol(c.withColumn("depth", F.coalesce("depth", F.lit(55.0)))))


_POLYGON = [(0.0, 0.0), (6.0, 1.0), (5.0, 6.0), (2.0, 5.0)]
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True))
_INSIDE = f"""e(x1, y1, x2, y2) AS (VALUES {_EDGES}), t AS (
  SELECT id, px, py, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS odd,
    bool_or((px - x1) * (y2 - y1) - (py - y1) * (x2 - x1) = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
  FROM pts, e GROUP BY id, px, py)"""


@query(f"""WITH {CELLS}, pts AS (SELECT DISTINCT y * 8 + x AS id, x::DOUBLE AS px, y::DOUBLE AS py FROM cells), {_INSIDE}
SELECT c.project_id, c.y, c.x, count(c.depth)::BIGINT AS n, round(avg(c.depth), 6) AS mean FROM cells c JOIN t ON t.id = c.y * 8 + c.x WHERE t.odd OR t.edge GROUP BY ALL""")
def polygon_mask(spark: SparkSession, d: str) -> DataFrame:
    inside = in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), _POLYGON, outline=True)
    return r6(proxies.cells(spark, d).where(inside).groupBy("project_id", "y", "x").agg(F.count("depth").alias("n"), F.avg("depth").alias("mean")))


TH, LEAST = 1.2, 3


#: Thresholds of the proxies for short, middle and long windows.
LEVELS = (0.8, 1.2, 1.6)


def level_sql(levels: tuple[float, float, float]) -> str:
    return f"CASE WHEN epoch(t1 - t0) < 7300 THEN {levels[0]} WHEN epoch(t1 - t0) < 129600 THEN {levels[1]} ELSE {levels[2]} END"


def _regions_sql(mode: str = "signed", th: str = str(TH), source: str = "change", p: str = "", least: int = LEAST) -> str:
    """CTEs of the regions ``{p}reg`` of ``source``; ``th`` may name its columns."""
    part = "0" if mode == "abs" else "sign"
    return f""", {p}mask AS (SELECT *, {part} AS part FROM (SELECT project_id, window_id, y, x, change, CASE WHEN change >= {th} THEN 1 WHEN change <= -({th}) THEN -1 END AS sign FROM {source}) WHERE sign IS NOT NULL
), {p}reach AS (
  SELECT project_id, window_id, part, y, x, y * 100 + x AS root FROM {p}mask
  UNION SELECT m.project_id, m.window_id, m.part, m.y, m.x, r.root FROM {p}reach r JOIN {p}mask m ON m.project_id = r.project_id AND m.window_id = r.window_id AND m.part = r.part AND abs(m.y - r.y) + abs(m.x - r.x) = 1
), {p}lab AS (SELECT project_id, window_id, part, y, x, min(root) AS root FROM {p}reach GROUP BY ALL
), {p}big AS (SELECT project_id, window_id, part, root, count(*) AS size FROM {p}lab GROUP BY ALL HAVING count(*) >= {least}
), {p}reg AS (SELECT l.project_id, l.window_id, l.y, l.x, m.sign AS label, b.size, m.change FROM {p}lab l JOIN {p}big b USING (project_id, window_id, part, root) JOIN {p}mask m USING (project_id, window_id, part, y, x))"""


GOOD = """good AS (SELECT c.project_id, count(depth) AS good FROM cells c JOIN (SELECT project_id, min(frame_idx) AS f FROM cells GROUP BY project_id) m ON m.project_id = c.project_id AND m.f = c.frame_idx GROUP BY c.project_id)"""


def summary_in(source: str = "change", windows: str = "w", p: str = "", levels: tuple[float, float, float] = LEVELS, good: str | None = None, least: int = LEAST, digits: int = 6) -> str:
    """CTEs of the volume summary ``{p}s`` of ``source``, with regions by each window's length."""
    total = lambda x: f"round(coalesce(sum({x}), 0) * {AREA}, {digits}) + 0::DOUBLE"
    beyond = lambda sign: f"coalesce(sum(abs(c.change)) FILTER (WHERE r.label = {sign} AND abs(c.change) > th), 0)"
    g = f"(SELECT {good} AS good)" if good else "good"
    on = "CROSS JOIN" if good else "JOIN"
    using = "" if good else " USING (project_id)"
    return f"""{p}t AS (SELECT c.*, {level_sql(levels)} AS lv FROM {source} c JOIN {windows} USING (project_id, window_id)){_regions_sql("signed", "lv", f"{p}t", p, least)}
, {p}v AS (SELECT project_id, window_id, abs(change) AS v, row_number() OVER (PARTITION BY project_id, window_id ORDER BY abs(change) DESC) AS r FROM {source} WHERE change IS NOT NULL
), {p}th AS (SELECT project_id, window_id, CASE WHEN any_value(floor(good * {PARAMS.index_fraction})) = 0 THEN min(v) ELSE coalesce(max(v) FILTER (WHERE r = floor(good * {PARAMS.index_fraction})), 0) END AS th FROM {p}v {on} {g}{using} GROUP BY ALL
), {p}s0 AS (SELECT c.project_id, c.window_id, {total("abs(c.change)")} AS absolute_volume, {total("c.change")} AS summed_volume, round(count(*) FILTER (WHERE r.label = 1) * {AREA}, {digits}) AS castle_area, round(count(*) FILTER (WHERE r.label = -1) * {AREA}, {digits}) AS pit_area,
    {total("CASE WHEN r.label = 1 THEN c.change END")} AS castle_volume, {total("CASE WHEN r.label = -1 THEN -c.change END")} AS pit_volume, {total("CASE WHEN r.label = 1 THEN c.change WHEN r.label = -1 THEN -c.change END")} AS bower_volume, {beyond(1)} AS tc, {beyond(-1)} AS tp
  FROM {source} c LEFT JOIN {p}reg r USING (project_id, window_id, y, x) LEFT JOIN {p}th USING (project_id, window_id) GROUP BY ALL
), {p}s AS (SELECT * EXCLUDE (tc, tp), round(tc, {digits}) AS threshold_castle_volume, round(tp, {digits}) AS threshold_pit_volume, round((tc - tp) / nullif(tc + tp, 0), {digits}) AS bower_index FROM {p}s0)"""


def _recursive(sql: str) -> str:
    return sql if "WITH RECURSIVE" in sql else sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(f"{_change_sql()}{_regions_sql()} SELECT project_id, window_id, y, x, label::INT AS label, size::BIGINT AS size, round(change, 6) AS change FROM reg"))
def bower_regions(spark: SparkSession, d: str) -> DataFrame:
    return r6(regions.bower_regions(_change(spark, d), KEYS, TH, LEAST))


@query(_recursive(f"{_change_sql()}{_regions_sql()} SELECT project_id, window_id, y, x, label::INT AS label, size::BIGINT AS size, round(change, 6) AS change FROM reg"))
def bower_regions_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return r6(regions.bower_regions(written(_change(spark, d), "change"), KEYS, TH, LEAST, how="fixpoint"))


@query(_recursive(f"{_change_sql()}{_regions_sql('abs')} SELECT project_id, window_id, y, x, label::INT AS label, size::BIGINT AS size, round(change, 6) AS change FROM reg"))
def abs_regions(spark: SparkSession, d: str) -> DataFrame:
    return r6(regions.bower_regions(_change(spark, d), KEYS, TH, LEAST, mode="abs"))


@query(f"""{_change_sql()}, a AS (SELECT project_id, window_id, y, x, CASE WHEN change >= 1.0 THEN 1 WHEN change <= -1.0 THEN -1 END AS l FROM change WHERE abs(change) >= 1.0
), bb AS (SELECT project_id, window_id, y, x, CASE WHEN change >= 1.5 THEN 1 WHEN change <= -1.5 THEN -1 END AS l FROM change WHERE abs(change) >= 1.5
), j AS (SELECT project_id, window_id, count(*) FILTER (WHERE a.l = bb.l) AS same, count(*) AS n FROM a FULL JOIN bb USING (project_id, window_id, y, x) GROUP BY ALL)
SELECT w.project_id, w.window_id, round(CASE WHEN n IS NULL THEN 1.0 ELSE same / n END, 6) AS agreement FROM w LEFT JOIN j USING (project_id, window_id)""")
def region_jaccard(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d)
    windows = depth.calendar_windows(c)
    change = depth.height_change(c, windows)
    a, b = (regions.signed_mask(change, KEYS, th).withColumnRenamed("sign", "label") for th in (1.0, 1.5))
    return r6(regions.jaccard(a, b, KEYS, windows.select(*KEYS)))


def _volume_sql(grain: str) -> str:
    return _recursive(f"{_change_sql(grain)}, {GOOD}, {summary_in()} SELECT * FROM s")


def _volumes(spark: SparkSession, d: str, grain: str) -> DataFrame:
    c = proxies.cells(spark, d)
    return r6(reports.window_volumes(c, depth.calendar_windows(c, grain), LEAST, LEVELS))


@query(_volume_sql("daily"))
def volume_summary_daily(spark: SparkSession, d: str) -> DataFrame:
    return _volumes(spark, d, "daily")


@query(_volume_sql("hourly"))
def volume_summary_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _volumes(spark, d, "hourly")


@query(_volume_sql("total"))
def volume_summary_total(spark: SparkSession, d: str) -> DataFrame:
    return _volumes(spark, d, "total")


@query(_recursive(f"""{_change_sql()}, {GOOD}, {summary_in()} SELECT project_id, window_id, (SELECT count(v) FROM v WHERE v.project_id = th.project_id AND v.window_id = th.window_id)::BIGINT AS n_pixels, round(th, 6) AS threshold FROM th"""))
def kth_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.kth_threshold(_change(spark, d), KEYS, depth.good_pixels(proxies.cells(spark, d))))


@query(f"""{_change_sql()} SELECT project_id, window_id, round(max(abs(change)), 6) AS vmax, round(0.75 * max(abs(change)), 6) AS scale, round(quantile_cont(abs(change), 0.99), 6) AS q99, round(median(change), 6) AS middle FROM change GROUP BY ALL""")
def quantile99(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.scales(_change(spark, d), KEYS))


@query(f"""WITH {CELLS}, e AS (SELECT project_id, day, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM cells WHERE lof GROUP BY ALL
), f AS (SELECT *, lag(f1) OVER (PARTITION BY project_id ORDER BY day) AS fp FROM e)
SELECT f.project_id, f.day, a.y, a.x, round(a.depth - b.depth, 6) AS day_change, round(p.depth - a.depth, 6) AS night_change FROM f
JOIN cells a ON a.project_id = f.project_id AND a.frame_idx = f.f0 JOIN cells b ON b.project_id = f.project_id AND b.frame_idx = f.f1 AND b.y = a.y AND b.x = a.x
LEFT JOIN cells p ON p.project_id = f.project_id AND p.frame_idx = f.fp AND p.y = a.y AND p.x = a.x""")
def day_first_last(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.day_first_last(proxies.cells(spark, d)))


@query(f"""WITH {CELLS}, m AS (SELECT project_id, max(ts) AS last FROM cells GROUP BY ALL), h AS (SELECT project_id, y, x, arg_min(frame_idx, ts) AS f0, arg_max(frame_idx, ts) AS f1 FROM cells JOIN m USING (project_id) WHERE ts > last - INTERVAL 2 HOUR AND lof = lof GROUP BY ALL)
SELECT h.project_id, h.y, h.x, round(b.depth - a.depth, 6) AS change FROM h JOIN cells a ON a.project_id = h.project_id AND a.y = h.y AND a.x = h.x AND a.frame_idx = h.f0 JOIN cells b ON b.project_id = h.project_id AND b.y = h.y AND b.x = h.x AND b.frame_idx = h.f1""")
def last_hours_change(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d)
    recent = depth.last_hours(c, "project_id", 2)
    ends = recent.groupBy("project_id", "y", "x").agg(F.min(F.struct("ts", "depth")).alias("a"), F.max(F.struct("ts", "depth")).alias("b"))
    return r6(ends.select("project_id", "y", "x", (F.col("b.depth") - F.col("a.depth")).alias("change")))


@query(f"""WITH {CELLS}, p AS (SELECT project_id, frame_idx, max(CASE WHEN frame_idx % 7 <> 3 THEN frame_idx END) OVER (PARTITION BY project_id ORDER BY frame_idx) AS src FROM (SELECT DISTINCT project_id, frame_idx FROM cells))
SELECT p.project_id, p.frame_idx, q.y, q.x, round(q.depth, 6) AS depth FROM p JOIN cells q ON q.project_id = p.project_id AND q.frame_idx = p.src""")
def carry_missing_frames(spark: SparkSession, d: str) -> DataFrame:
    c = proxies.cells(spark, d).select("project_id", "frame_idx", "y", "x", "depth")
    present = c.select("project_id", "frame_idx").distinct().withColumn("has_file", F.col("frame_idx") % 7 != 3)
    return r6(depth.carry_missing_frames(c, present).select("project_id", "frame_idx", "y", "x", "depth"))


@query(f"""{_INTERP}, mk AS (SELECT project_id, y, x, count(*) FILTER (WHERE lof) AS n, count(depth) FILTER (WHERE lof) AS n_good, avg(depth) FILTER (WHERE lof) AS mean, stddev_pop(depth) FILTER (WHERE lof) AS std FROM filled GROUP BY ALL
), md AS (SELECT project_id, median(mean) AS mid FROM mk GROUP BY ALL
), ok AS (SELECT project_id, y, x FROM mk JOIN md USING (project_id) WHERE NOT (n_good < {PARAMS.sparse_fraction} * n) AND NOT coalesce(std > {PARAMS.max_std}, false) AND NOT coalesce(mean > mid + {PARAMS.max_depth} OR mean < mid - {PARAMS.max_height}, false)
), cl AS (SELECT f.* REPLACE (CASE WHEN ok.y IS NOT NULL THEN f.depth END AS depth) FROM filled f LEFT JOIN ok USING (project_id, y, x)
), e AS (SELECT project_id, day, min(frame_idx) AS a, max(frame_idx) AS b FROM cl WHERE lof GROUP BY ALL
), m0 AS (SELECT project_id, day, 0 AS side, a AS mark FROM e UNION ALL SELECT project_id, day, 1, b FROM e
), m AS (SELECT project_id, mark, row_number() OVER o AS k, lag(mark) OVER o AS bef, lead(mark) OVER o AS aft FROM m0 WINDOW o AS (PARTITION BY project_id ORDER BY day, side)
), nf AS (SELECT DISTINCT project_id, frame_idx FROM cl WHERE NOT lof
), nn AS (SELECT nf.project_id, nf.frame_idx, m.*, row_number() OVER (PARTITION BY nf.project_id, nf.frame_idx ORDER BY abs(nf.frame_idx - mark), k) AS rn FROM nf JOIN m ON m.project_id = nf.project_id
), pl AS (SELECT project_id, frame_idx, mark AS b1, CASE WHEN bef IS NULL OR aft IS NULL THEN mark WHEN frame_idx > mark THEN aft ELSE bef END AS b2 FROM nn WHERE rn = 1
), whole AS (SELECT c.project_id, c.frame_idx, c.y, c.x, CASE WHEN c.lof THEN c.depth ELSE coalesce((v1.depth + v2.depth) / 2, v1.depth, v2.depth) END AS depth
  FROM cl c LEFT JOIN pl ON NOT c.lof AND pl.project_id = c.project_id AND pl.frame_idx = c.frame_idx
  LEFT JOIN cl v1 ON v1.project_id = c.project_id AND v1.frame_idx = pl.b1 AND v1.y = c.y AND v1.x = c.x
  LEFT JOIN cl v2 ON v2.project_id = c.project_id AND v2.frame_idx = pl.b2 AND v2.y = c.y AND v2.x = c.x
), kk(o, c) AS (VALUES {_COEFF}), sr AS (SELECT *, count(*) OVER (PARTITION BY project_id, y, x) AS n FROM whole
), mir AS (SELECT sr.*, kk.c, (((frame_idx + o) % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) AS m FROM sr, kk)
SELECT mir.project_id, mir.y, mir.x, mir.frame_idx, CASE WHEN count(q.depth) = {_W} THEN round(sum(mir.c * q.depth), 6) END AS depth
FROM mir JOIN sr q ON q.project_id = mir.project_id AND q.y = mir.y AND q.x = mir.x AND q.frame_idx = least(mir.m, 2 * (mir.n - 1) - mir.m) GROUP BY ALL""")
def smooth_depth(spark: SparkSession, d: str) -> DataFrame:
    return r6(depth.smooth_depth(proxies.cells(spark, d)).select("project_id", "y", "x", "frame_idx", "depth"))


@query(f"""{_change_sql()}, c AS (SELECT project_id, window_id, coalesce(sum(abs(change)), 0) AS v FROM change GROUP BY ALL)
SELECT project_id, window_id, round(sum(v) OVER (PARTITION BY project_id ORDER BY window_id ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM c""")
def cumulative_change(spark: SparkSession, d: str) -> DataFrame:
    v = _change(spark, d).groupBy(*KEYS).agg(F.coalesce(F.sum(F.abs("change")), F.lit(0.0)).alias("v"))
    return r6(reports.cumulative(v, "project_id", "window_id", "v").select("project_id", "window_id", "cumulative"))


@query(f"""{_change_sql()}, c AS (SELECT project_id, window_id, coalesce(sum(change), 0) AS v FROM change GROUP BY ALL
), s AS (SELECT project_id, window_id, sum(v) OVER (PARTITION BY project_id ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY project_id ORDER BY window_id DESC) AS r FROM c)
SELECT project_id, round(c, 6) AS final, CASE WHEN substr(project_id, 2)::INT % 2 = 0 THEN 'control' ELSE 'behave' END AS kind,
  CASE WHEN substr(project_id, 2)::INT % 2 = 0 THEN c > 0 ELSE c < 0.1 END AS flagged FROM s WHERE r = 1""")
def outcome_flags(spark: SparkSession, d: str) -> DataFrame:
    v = _change(spark, d).groupBy(*KEYS).agg(F.coalesce(F.sum("change"), F.lit(0.0)).alias("v"))
    kind = F.when(F.substring("project_id", 2, 9).cast("int") % 2 == 0, "control").otherwise("behave")
    return r6(reports.outcome(reports.cumulative(v, "project_id", "window_id", "v"), "project_id", "window_id", kind))
