"""Depth cubes in long form (project_id, frame_idx, y, x, depth, ts, lof, day): cleaning, smoothing,
look-ups in time, height change and its summaries. Missing values are null.

Per-pixel work shuffles once on (project_id, y, x); a pixel's series is at most a trial long, so no
group grows with the number of projects. Small per-frame tables join by hash on (project_id, frame).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.functions.expr import savgol_coefficients
from reefline.schemas import PARAMS
from reefline.shared import sized

PIXEL = ["project_id", "y", "x"]


def cell_keys(cells: DataFrame) -> list[str]:
    """A cell's keys. A stored cube has its tile too: with it among the keys, work by cell needs no shuffle."""
    return [*PIXEL, *(c for c in ("tile_y", "tile_x") if c in cells.columns)]


def zero_to_null(raw: Column, units: float = 1.0) -> Column:
    """Zero means missing; centimetres from sensor units."""
    return F.nullif(raw, F.lit(0).cast("bigint")) * units * 100


def trimmed_median(samples: DataFrame, keys: list[str], value: str = "raw") -> DataFrame:
    """Median, population deviation and counts by ``keys`` after the lowest value was taken out up to
    three times, each time only if it occurs three times at most.
    """
    v = F.col(value)
    counts = samples.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_m"))
    up = W.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_r", F.row_number().over(up)).withColumn("_worst", F.max("_m").over(up.rowsBetween(W.unboundedPreceding, 0)))
    kept = ranked.where(~((F.col("_r") <= 3) & (F.col("_worst") <= 3))).select(*keys, value, F.explode(F.array_repeat(F.lit(1), F.col("_m").cast("int"))).alias("_one"))
    stats = kept.groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.count("*").alias("n_kept"))
    total = samples.groupBy(*keys).agg(F.count(value).alias("n_good"), F.count_if(v.isNull()).alias("n_bad"))
    return total.join(stats, keys, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trimmed(samples: Column) -> Column:
    """``median``, ``std`` (of the population) and ``kept`` of an array of samples without nulls, by the rule of ``trimmed_median``."""

    def without_lowest(v: Column) -> Column:
        return _let(F.array_min(v), lambda low: F.when(F.size(F.filter(v, lambda x: x == low)) <= 3, F.filter(v, lambda x: x != low)).otherwise(v))

    kept = samples
    for _ in range(3):
        kept = _let(kept, without_lowest)

    def stats(v: Column) -> Column:
        n = F.size(v)
        half = F.floor((n - 1) / 2).cast("int")
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        square = _let(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        return F.struct(F.when(n > 0, (F.get(v, half) + F.get(v, F.floor(n / 2).cast("int"))) / 2).alias("median"), F.when(n > 0, F.sqrt(square / n)).alias("std"), n.cast("long").alias("kept"))

    return _let(F.array_sort(F.transform(kept, lambda x: x.cast("double"))), stats)


def cell_medians(samples: DataFrame, keys: list[str | Column], value: str = "raw") -> DataFrame:
    """By ``keys`` (a capture window and a cell): trimmed median, deviation and counts of its samples, of which a window has a few
    dozen. One aggregation that Spark can merge, so the frame may be a stream; the state of a cell is its samples.
    """
    held = samples.groupBy(*keys).agg(F.collect_list(value).alias("_v"), F.count(value).alias("n_good"), F.count_if(F.col(value).isNull()).alias("n_bad"))  # nulls are not collected
    names = [c for c in held.columns if c not in ("_v", "n_good", "n_bad")]
    return held.select(*names, "n_good", "n_bad", trimmed(F.col("_v")).alias("_s")).select(*names, "n_good", "n_bad", "_s.median", "_s.std", F.col("_s.kept").alias("n_kept"))


def frame_statistics(medians: DataFrame, keys: list[str | Column], samples: int | None = None) -> DataFrame:
    """What a frame record says of the cells' medians: ``avg_med`` and ``avg_std`` over the cells that have one, their number ``gp``,
    and samples kept (``pixels_good``) and not (``pixels_bad``: missing, or taken out). ``samples`` is how many a cell should have;
    without it, as many as came.
    """
    due = F.col("n_good") + F.col("n_bad") if samples is None else F.lit(samples).cast("long")
    return medians.groupBy(*keys).agg(
        F.avg("median").alias("avg_med"), F.avg("std").alias("avg_std"), F.count("median").alias("gp"), F.sum("n_kept").alias("pixels_good"), F.sum(due - F.col("n_kept")).alias("pixels_bad"),
    )


def carry_missing_frames(cells: DataFrame, present: DataFrame) -> DataFrame:
    """Cells of frames without a file take the last frame that has one; ``present`` is
    (project_id, frame_idx, has_file). Nulls inside a present frame stay null.
    """
    source = F.max(F.when(F.col("has_file"), F.col("frame_idx"))).over(W.partitionBy("project_id").orderBy("frame_idx"))
    plan = present.select("project_id", F.col("frame_idx").alias("_to"), source.alias("frame_idx"))
    return cells.join(plan, ["project_id", "frame_idx"]).drop("frame_idx").withColumnRenamed("_to", "frame_idx")


def pixel_stats(cells: DataFrame) -> DataFrame:
    day = F.when(F.col("lof"), F.col("depth"))
    return cells.groupBy(*cell_keys(cells)).agg(F.count_if("lof").alias("n_day"), F.count(day).alias("n_good"), F.avg(day).alias("mean"), F.stddev_pop(day).alias("std"))


def pixel_masks(cells: DataFrame, p=PARAMS) -> DataFrame:
    """For each pixel which rules reject it: sparse, noisy, out of the height range; and ``good``."""
    stats = pixel_stats(cells)
    middle = stats.groupBy("project_id").agg(F.median("mean").alias("_middle"))
    sparse, noisy = F.col("n_good") < p.sparse_fraction * F.col("n_day"), F.coalesce(F.col("std") > p.max_std, F.lit(False))
    out = F.coalesce((F.col("mean") > F.col("_middle") + p.max_depth) | (F.col("mean") < F.col("_middle") - p.max_height), F.lit(False))
    rows = stats.join(middle, "project_id").select(*cell_keys(cells), "n_good", "mean", "std", sparse.alias("sparse"), noisy.alias("noisy"), out.alias("out_of_range"))
    return rows.withColumn("good", ~(F.col("sparse") | F.col("noisy") | F.col("out_of_range")))


def two_frame_difference(cells: DataFrame, ends: DataFrame, p=PARAMS) -> DataFrame:
    """Last minus first depth of each pixel, null where the mean of both frames lies out of the height range around the first
    frame's median; of two frames of which one is null the other one counts. ``ends``: project_id, f0, f1.
    """
    side = F.explode(F.array(F.struct(F.col("f0").alias("frame_idx"), F.lit(0).alias("k")), F.struct(F.col("f1").alias("frame_idx"), F.lit(1).alias("k")))).alias("e")
    rows = ends.select("project_id", side).select("project_id", "e.*").join(cells.select(*PIXEL, "frame_idx", "depth"), ["project_id", "frame_idx"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("depth")))
    both = rows.groupBy(*PIXEL).agg(at(0).alias("_a"), at(1).alias("_b"))
    middle = rows.where("k = 0").groupBy("project_id").agg(F.median("depth").alias("_middle"))
    mean = F.coalesce((F.col("_a") + F.col("_b")) / 2, "_a", "_b")
    out = (mean > F.col("_middle") + p.max_depth) | (mean < F.col("_middle") - p.max_height)
    return both.join(middle, "project_id", "left").select(*PIXEL, F.when(~F.coalesce(out, F.lit(False)), F.col("_b") - F.col("_a")).alias("change"))


def scales(change: DataFrame, keys: list[str], value: str = "change", order: str | None = None) -> DataFrame:
    """What a stack of maps is scaled by, for each: the largest absolute value, three quarters of it, the 0.99 quantile of absolute
    values and the median; with ``order`` (one of the keys) also the largest quantile of the maps so far.
    """
    v = F.abs(value)
    rows = change.groupBy(*keys).agg(F.max(v).alias("vmax"), (0.75 * F.max(v)).alias("scale"), F.percentile(v, 0.99).alias("q99"), F.median(value).alias("middle"))
    if order is None:
        return rows
    return rows.withColumn("q99_so_far", F.max("q99").over(W.partitionBy(*[k for k in keys if k != order]).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def apply_masks(cells: DataFrame, masks: DataFrame) -> DataFrame:
    own = [k for k in cell_keys(cells) if k in masks.columns]
    good = masks.where("good").select(*own, F.lit(True).alias("_ok"))
    return cells.join(good, own, "left").withColumn("depth", F.when(F.col("_ok"), F.col("depth"))).drop("_ok")


def gap_interpolate(cells: DataFrame, include_stop: bool = False, p=PARAMS) -> DataFrame:
    """Linear fill of daytime gaps by pixel and day where more than ``good_fraction`` of the frames are
    good; ends take the nearest good value. The day's last frame takes no part unless asked for.
    """
    span = cells.where("lof").select("project_id", "day", "frame_idx").distinct()
    span = span.groupBy("project_id", "day").agg(F.min("frame_idx").alias("_a"), F.max("frame_idx").alias("_b"))
    rows = cells.join(sized(span, "days") if "tile_y" in cells.columns else span, ["project_id", "day"], "left")
    inside = (F.col("frame_idx") >= F.col("_a")) & ((F.col("frame_idx") <= F.col("_b")) if include_stop else (F.col("frame_idx") < F.col("_b")))
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    w = W.partitionBy(*cell_keys(cells), "day", "_in")
    back, ahead = w.orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0), w.orderBy("frame_idx").rowsBetween(0, W.unboundedFollowing)
    seen = F.when(F.col("depth").isNotNull(), F.struct("frame_idx", "depth"))
    rows = rows.select("*", F.last(seen, ignorenulls=True).over(back).alias("_l"), F.first(seen, ignorenulls=True).over(ahead).alias("_r"), (F.count("depth").over(w) / F.count("*").over(w)).alias("_share"))
    run = F.col("_r.frame_idx") - F.col("_l.frame_idx")
    line = F.col("_l.depth") + (F.col("_r.depth") - F.col("_l.depth")) * (F.col("frame_idx") - F.col("_l.frame_idx")) / run
    filled = F.coalesce("depth", F.when(F.col("_in") & (F.col("_share") > p.good_fraction), F.coalesce(line, "_l.depth", "_r.depth")))
    return rows.withColumn("depth", filled).drop("_a", "_b", "_in", "_l", "_r", "_share")


def night_fill(cells: DataFrame) -> DataFrame:
    """Frames outside daytime (``lof`` false or null) take their values from the nearest day boundary and its
    neighbour on the frame's side, averaged over what is not null; before the first and after the last
    boundary alone. Without any boundary they are null.

    The nearest boundary is the last one before or the first one after in one sorted pass over a project's
    frames and boundaries; of two as near, the earlier. Frames between the same boundaries share their values, which are
    worked out from the boundary frames alone; of the cube only night cells are shuffled, once, and of a stored cube none
    (the frames' plan, a row for each night frame of a project, is sent to all tasks if its size allows).
    """
    day = F.coalesce("lof", F.lit(False))
    frames = cells.select("project_id", "frame_idx", "day", day.alias("lof")).distinct()
    ends = frames.where("lof").groupBy("project_id", "day").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    marks = ends.select("project_id", F.posexplode(F.array("a", "b")).alias("_side", "mark"), "day")
    order = W.partitionBy("project_id").orderBy("day", "_side")
    marks = marks.select("project_id", "mark", F.row_number().over(order).alias("k"), F.lag("mark").over(order).alias("before"), F.lead("mark").over(order).alias("after"))
    marks = marks.groupBy("project_id", "mark").agg(F.min(F.struct("k", "mark", "before", "after")).alias("m"))
    both = frames.where("NOT lof").select("project_id", "frame_idx", F.lit(None).cast(marks.schema["m"].dataType).alias("m")).distinct().unionByName(marks.select("project_id", F.col("mark").alias("frame_idx"), "m"))
    line = W.partitionBy("project_id").orderBy("frame_idx")
    near = both.select("project_id", "frame_idx", "m", F.last("m", True).over(line.rowsBetween(W.unboundedPreceding, 0)).alias("_b"), F.first("m", True).over(line.rowsBetween(0, W.unboundedFollowing)).alias("_a")).where("m IS NULL")
    nearer = F.col("_a.mark") - F.col("frame_idx") < F.col("frame_idx") - F.col("_b.mark")
    stored = "tile_y" in cells.columns
    best = near.select("project_id", "frame_idx", F.when(F.col("_b").isNull() | nearer, F.col("_a")).otherwise(F.col("_b")).alias("m"))
    other = F.when(F.col("m.before").isNull() | F.col("m.after").isNull(), F.col("m.mark")).when(F.col("frame_idx") > F.col("m.mark"), F.col("m.after")).otherwise(F.col("m.before"))
    plan = best.select("project_id", "frame_idx", F.col("m.mark").alias("b1"), other.alias("b2"))
    plan = sized(plan, "plan") if stored else plan
    pairs = plan.where("b1 IS NOT NULL").select("project_id", "b1", "b2").distinct()
    marked = pairs.select("project_id", F.explode(F.array("b1", "b2")).alias("frame_idx")).distinct()
    own = cell_keys(cells)
    edges = cells.where("lof").join(sized(marked, "marks") if stored else marked, ["project_id", "frame_idx"], "left_semi").select(*own, "frame_idx", "depth")  # two frames a day
    sides = F.explode(F.array(F.struct(F.col("b1").alias("frame_idx"), F.lit(1).alias("k")), F.struct(F.col("b2").alias("frame_idx"), F.lit(2).alias("k")))).alias("s")
    of = pairs.select("project_id", "b1", "b2", sides).select("project_id", "b1", "b2", "s.*")
    found = edges.join(sized(of, "sides") if stored else of, ["project_id", "frame_idx"])
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("depth")))
    fills = found.groupBy(*own, "b1", "b2").agg(value(1).alias("_v1"), value(2).alias("_v2"))
    mean = F.coalesce((F.col("_v1") + F.col("_v2")) / 2, "_v1", "_v2")
    fills = fills.select(*own, "b1", "b2", mean.alias("_fill"))
    if stored:  # every cell stays where it is
        whole = cells.join(plan, ["project_id", "frame_idx"], "left").join(fills, [*own, "b1", "b2"], "left")
        return whole.withColumn("depth", F.when(F.coalesce("lof", F.lit(False)), F.col("depth")).otherwise(F.col("_fill"))).select(*cells.columns)
    need = cells.where(~day).join(plan, ["project_id", "frame_idx"], "left").join(fills, [*own, "b1", "b2"], "left")
    return cells.where("lof").unionByName(need.withColumn("depth", F.col("_fill")).select(*cells.columns))


def savgol(cells: DataFrame, window: int = PARAMS.savgol_window, order: int = PARAMS.savgol_order) -> DataFrame:
    """Least-squares polynomial smoothing along each pixel's series, mirrored at the ends; a null in
    the window gives null. One shuffle into series form, array functions, one explode out.
    """
    half = window // 2
    weights = F.array(*[F.lit(c) for c in savgol_coefficients(window, order)])
    own = cell_keys(cells)
    series = cells.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "depth"))).alias("s"))
    n = F.size("s")
    period = F.greatest(F.lit(1), 2 * (n - 1))

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, period)
        return F.get("s", F.least(m, period - m))["depth"]

    padded = F.transform(F.sequence(F.lit(-half), n - 1 + half), mirrored)
    smooth = F.transform("s", lambda e, i: F.struct(e["frame_idx"].alias("frame_idx"), F.aggregate(F.zip_with(F.slice("_p", i + 1, window), weights, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v).alias("depth")))
    return series.select("*", padded.alias("_p")).select(*own, F.explode(smooth).alias("e")).select(*own, "e.frame_idx", "e.depth")


def asof_frames(frames: DataFrame, times: DataFrame, time: str = "t") -> DataFrame:
    """``times`` (project_id, t, more) with ``frame_idx``: the last frame at or before t, the first
    frame if none is; null for a null t. One sort by project; no pairs are made.
    """
    both = times.select("*", F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_f")).unionByName(
        frames.select("project_id", F.col("ts").alias("_t"), F.lit(0).alias("_kind"), F.col("frame_idx").alias("_f")), allowMissingColumns=True
    )
    order = W.partitionBy("project_id").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = F.coalesce(F.last("_f", ignorenulls=True).over(order), F.min("_f").over(W.partitionBy("project_id")))
    found = F.when(F.col("_t").isNotNull(), found)
    return both.withColumn("frame_idx", found).where("_kind = 1").drop("_t", "_kind", "_f")


def forward_frames(frames: DataFrame, times: DataFrame, time: str = "t") -> DataFrame:
    """The first frame at or after t; null if none is."""
    both = times.select("*", F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_f")).unionByName(
        frames.select("project_id", F.col("ts").alias("_t"), F.lit(1).alias("_kind"), F.col("frame_idx").alias("_f")), allowMissingColumns=True
    )
    order = W.partitionBy("project_id").orderBy("_t", "_kind").rowsBetween(0, W.unboundedFollowing)
    return both.withColumn("frame_idx", F.first("_f", ignorenulls=True).over(order)).where("_kind = 0").drop("_t", "_kind", "_f")


def frame_times(cells: DataFrame) -> DataFrame:
    return cells.select("project_id", "frame_idx", "ts").distinct()


def height_at(cells: DataFrame, times: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Depth of every pixel at each time. ``frames`` (project_id, frame_idx, ts) spares listing them from the cube."""
    return asof_frames(frame_times(cells) if frames is None else frames, times).join(cells.select(*PIXEL, "frame_idx", "depth"), ["project_id", "frame_idx"])


def height_change(cells: DataFrame, windows: DataFrame, forward: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """``windows`` (project_id, window_id, t0, t1): first minus last depth of every pixel, so that
    raised sand is positive. ``forward`` starts at the first frame not before t0. ``frames``: as in ``height_at``.
    Only the windows' own frames are read on, and a cell's two values meet in one aggregation.
    """
    frames = frame_times(cells) if frames is None else frames
    first = (forward_frames if forward else asof_frames)(frames, windows, "t0").withColumnRenamed("frame_idx", "f0")
    both = asof_frames(frames, first, "t1").withColumnRenamed("frame_idx", "f1")
    ends = F.explode(F.array(F.struct(F.col("f0").alias("frame_idx"), F.lit(0).alias("k")), F.struct(F.col("f1").alias("frame_idx"), F.lit(1).alias("k")))).alias("e")
    need = both.select("project_id", "window_id", ends).select("project_id", "window_id", "e.*")
    own = cell_keys(cells)
    rows = need.join(cells.select(*own, "frame_idx", "depth"), ["project_id", "frame_idx"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("depth")))
    change = rows.groupBy(*own, "window_id").agg((at(0) - at(1)).alias("change"), F.bit_or(F.col("k") + 1).alias("_k"))  # 3: the cell is in both frames
    return change.where("_k = 3").select("project_id", "window_id", "y", "x", "change")


def calendar_windows(cells: DataFrame, grain: str = "daily") -> DataFrame:
    """``total``: first to last frame; ``daily``: calendar days; ``hourly``: ten hours from 8:00, each day;
    ``two_hourly``: the five pairs of these hours. ``cells`` may be a table of frames.
    """
    span = cells.groupBy("project_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    if grain == "total":
        return span.select("project_id", F.lit("total").alias("window_id"), F.col("_a").alias("t0"), F.col("_b").alias("t1"))
    days = span.select("project_id", F.explode(F.sequence(F.to_date("_a"), F.to_date("_b"))).alias("_d"))
    start = F.col("_d").cast("timestamp_ntz")
    if grain == "daily":
        return days.select("project_id", F.date_format("_d", "yyyy-MM-dd").alias("window_id"), start.alias("t0"), (start + F.expr("INTERVAL '1' DAY")).alias("t1"))
    long_ = 2 if grain == "two_hourly" else 1
    hours = days.select("project_id", "_d", F.explode(F.sequence(F.lit(8), F.lit(17), F.lit(long_))).alias("_h"))
    begin = F.col("_d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_h"))
    return hours.select("project_id", F.concat(F.date_format("_d", "yyyy-MM-dd"), F.lit(" "), F.lpad(F.col("_h").cast("string"), 2, "0")).alias("window_id"), begin.alias("t0"), (begin + F.expr(f"INTERVAL '{long_}' HOUR")).alias("t1"))


def midpoint(t0: Column, t1: Column) -> Column:
    """The middle of a window, rounded down to a microsecond."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.timestamp_micros(F.floor((micros(t0) + micros(t1)) / 2)).cast("timestamp_ntz")


def lights_on(ts: Column, last_hour: int = 17) -> Column:
    """Whether a time lies between 8:00 and the end of ``last_hour``: 17 for captures and the live view, 18 for
    hourly reports.
    """
    return F.hour(ts).between(8, last_hour)


def last_hours(rows: DataFrame, key: str, hours: int, time: str = "ts") -> DataFrame:
    """Rows of each key later than its last time minus ``hours``."""
    last = rows.groupBy(key).agg(F.max(time).alias("_last"))
    return rows.join(last, key).where(F.col(time) > F.col("_last") - F.make_dt_interval(F.lit(0), F.lit(hours))).drop("_last")


def threshold(seconds: Column, small: float, middle: float, large: float) -> Column:
    """Threshold by the length of a window: under 7300 s, under 129600 s, longer."""
    return F.when(seconds < 7300, small).when(seconds < 129600, middle).otherwise(large)


def good_pixels(cells: DataFrame) -> DataFrame:
    """``project_id, good_pixels``: pixels with a value in the project's first frame."""
    first = cells.groupBy("project_id").agg(F.min("frame_idx").alias("frame_idx"))
    return cells.join(first, ["project_id", "frame_idx"]).groupBy("project_id").agg(F.count("depth").alias("good_pixels"))


def kth_threshold(change: DataFrame, keys: list[str], good: DataFrame | int, value: str = "change", share: float = PARAMS.index_fraction) -> DataFrame:
    """The k-th largest absolute value by ``keys``, k the tenth part of the good pixels (by project, or a
    number), rounded down; the smallest value if k is zero, 0 if there are fewer than k.
    """
    v = change.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.abs(value)), asc=False).alias("_v"))  # a grid at most
    v = v.withColumn("good_pixels", F.lit(good)) if isinstance(good, int) else v.join(good, "project_id")
    k = F.floor(F.col("good_pixels") * share).cast("int")
    at = F.when(k == 0, F.element_at("_v", -1)).otherwise(F.coalesce(F.get("_v", k - 1), F.lit(0.0)))
    return v.select(*keys, F.size("_v").cast("long").alias("n_pixels"), at.alias("threshold"))


def volume_summary(change: DataFrame, keys: list[str], regions: DataFrame, good: DataFrame | int, value: str = "change", p=PARAMS) -> DataFrame:
    """One row for each window. ``regions`` (keys, y, x, label) marks castles (1) and pits (-1). The threshold
    sums are those of absolute values above the k-th largest inside castles and inside pits, and the
    bower index is their difference over their sum (null if both are zero).
    """
    rows = change.join(regions.select(*keys, "y", "x", F.col("label").alias("_label")), [*keys, "y", "x"], "left")
    rows = rows.join(kth_threshold(change, keys, good, value), keys, "left")
    v, a = F.col(value), p.area
    plain = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    total = lambda c: plain(c) * a
    castle, pit, beyond = F.col("_label") > 0, F.col("_label") < 0, F.abs(v) > F.col("threshold")
    out = rows.groupBy(*keys).agg(
        total(F.abs(v)).alias("absolute_volume"), total(v).alias("summed_volume"), (F.count_if(castle) * a).alias("castle_area"), (F.count_if(pit) * a).alias("pit_area"),
        total(F.when(castle, v)).alias("castle_volume"), total(F.when(pit, -v)).alias("pit_volume"), total(F.when(castle, v).when(pit, -v)).alias("bower_volume"),
        plain(F.when(castle & beyond, F.abs(v))).alias("threshold_castle_volume"), plain(F.when(pit & beyond, F.abs(v))).alias("threshold_pit_volume"),
    )
    return out.withColumn("bower_index", F.try_divide(F.col("threshold_castle_volume") - F.col("threshold_pit_volume"), F.col("threshold_castle_volume") + F.col("threshold_pit_volume")))


def smooth_depth(cells: DataFrame, crop: Column | None = None, present: DataFrame | None = None) -> DataFrame:
    """Cleaning of a whole cube: missing frames, gaps, crop, masks, nights, smoothing."""
    if present is not None:
        more = [c for c in cells.columns if c not in ("project_id", "frame_idx", "y", "x", "depth")]
        held = carry_missing_frames(cells.select("project_id", "frame_idx", "y", "x", "depth"), present)
        cells = held.join(cells.select("project_id", "frame_idx", *more).distinct(), ["project_id", "frame_idx"]).select(*cells.columns)
    rows = gap_interpolate(cells)
    if crop is not None:
        rows = rows.withColumn("depth", F.when(crop, F.col("depth")))
    rows = night_fill(apply_masks(rows, pixel_masks(rows)))
    smooth = savgol(rows).drop("tile_y", "tile_x")
    return smooth.join(frame_times(cells), ["project_id", "frame_idx"])


def day_first_last(cells: DataFrame) -> DataFrame:
    """Change between the first and last daylight frame of each day, and from the day before."""
    days = cells.where("lof").groupBy("project_id", "day").agg(F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"))
    days = days.withColumn("f_prev", F.lag("f1").over(W.partitionBy("project_id").orderBy("day")))
    c = cells.select(*PIXEL, "frame_idx", "depth")
    rows = days.select("project_id", "day", F.explode(F.array(F.struct(F.lit("first").alias("k"), F.col("f0").alias("frame_idx")), F.struct(F.lit("last").alias("k"), F.col("f1").alias("frame_idx")), F.struct(F.lit("prev").alias("k"), F.col("f_prev").alias("frame_idx")))).alias("m"))
    rows = rows.select("project_id", "day", "m.k", "m.frame_idx").join(c, ["project_id", "frame_idx"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("depth")))
    return rows.groupBy("project_id", "day", "y", "x").agg((at("first") - at("last")).alias("day_change"), (at("prev") - at("first")).alias("night_change"))
