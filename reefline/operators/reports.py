"""Report tables: windows before a reference event, cohort tables, running sums, histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.functions.expr import minutes_to
from reefline.operators import depth, regions
from reefline.operators.events import cluster_summary, density_difference, event_counts, in_windows
from reefline.schemas import PARAMS
from reefline.shared import written


def cumulative(rows: DataFrame, project: str, order: str, value: str) -> DataFrame:
    w = W.partitionBy(project).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("cumulative", F.sum(value).over(w))


def outcome(rows: DataFrame, project: str, order: str, kind: Column) -> DataFrame:
    """The last running sum of a project, flagged if a control rose or a builder stayed under 0.1."""
    last = rows.groupBy(project).agg(F.max(F.struct(order, "cumulative")).alias("m")).select(project, F.col("m.cumulative").alias("final"))
    k = last.withColumn("kind", kind)
    return k.withColumn("flagged", F.when(F.col("kind") == "control", F.col("final") > 0).otherwise(F.col("final") < 0.1))


def steps_before(reference: DataFrame, lead_minutes: int = 5, span_minutes: int = 90, step_minutes: int = 10) -> DataFrame:
    """Windows (project_id, window_id, t0, t1, event_time) that end ``lead_minutes`` before the event."""
    n = span_minutes // step_minutes
    stop = F.col("dissection_time") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lead_minutes))
    rows = reference.select(F.col("pid").alias("project_id"), F.col("dissection_time").alias("event_time"), stop.alias("_stop"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window_id"))
    at = lambda k: F.col("_stop") - F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(n) - k) * step_minutes)
    return rows.select("project_id", "window_id", at(F.col("window_id")).alias("t0"), at(F.col("window_id") + 1).alias("t1"), "event_time")


def cluster_detail(events: DataFrame, windows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A count for every project, step and behaviour group, zero where nothing happened."""
    names = F.array(*[F.struct(F.lit(k).alias("grp"), F.array(*[F.lit(b) for b in v]).alias("bids")) for k, v in groups.items()])
    scaffold = windows.select("*", F.explode(names).alias("g")).select(*windows.columns, "g.grp", "g.bids")
    bid_groups = F.filter(names, lambda g: F.array_contains(g["bids"], F.col("Prediction")))
    inside = in_windows(events.select("project_id", "TimeStamp", "Prediction"), windows)
    counts = inside.select("project_id", "window_id", F.explode(bid_groups).alias("g")).groupBy("project_id", "window_id", F.col("g.grp").alias("grp")).agg(F.count("*").alias("_n"))
    rows = scaffold.join(counts, ["project_id", "window_id", "grp"], "left")
    return rows.select("project_id", "window_id", "grp", F.coalesce("_n", F.lit(0)).alias("n"), minutes_to(F.col("event_time"), F.col("t0")).alias("minutes_start"), minutes_to(F.col("event_time"), F.col("t1")).alias("minutes_stop"))


def whole_windows(reference: DataFrame, lead_minutes: int = 5, span_minutes: int = 90) -> DataFrame:
    """One window (project_id, window_id, t0, t1, event_time) for each event, that ends ``lead_minutes`` before it."""
    stop = F.col("dissection_time") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lead_minutes))
    start = stop - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(span_minutes))
    return reference.select(F.col("pid").alias("project_id"), F.lit(0).alias("window_id"), start.alias("t0"), stop.alias("t1"), F.col("dissection_time").alias("event_time"))


def cohort_counts(events: DataFrame, windows: DataFrame, bids: list[str]) -> DataFrame:
    """Counts of each behaviour and of the building and feeding groups over a project's one window."""
    counts = in_windows(events.select("project_id", "TimeStamp", "Prediction"), windows)
    n = lambda *b: F.count_if(F.col("Prediction").isin(*b))
    found = counts.groupBy("project_id").agg(*[n(b).alias(f"n_{b}") for b in bids], n("c", "p", "b").alias("n_building"), n("f", "t", "m").alias("n_feeding"))
    rows = windows.select("project_id").join(found, "project_id", "left")
    return rows.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c != "project_id"])


def bower_mask(cells: DataFrame, windows: DataFrame, min_pixels: int, levels: tuple[float, float, float]) -> DataFrame:
    """Pixels of the regions of each project's window, which starts at its first frame not before t0."""
    forward = depth.height_change(cells, windows.select("project_id", "window_id", "t0", "t1"), forward=True)
    return regions.timed_regions(forward, windows.select("project_id", "window_id", "t0", "t1"), ["project_id", "window_id"], levels, min_pixels).select("project_id", "y", "x")


def cohort_total(events: DataFrame, cells: DataFrame, reference: DataFrame, bids: list[str], min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None) -> DataFrame:
    """For each project its kind, the counts of the 90 minutes before its event, and the absolute volume change
    then, overall and inside the regions of these 90 minutes.
    """
    windows = whole_windows(reference)
    mask = bower_mask(cells, windows, min_pixels, levels or regions.depth_levels())
    change = depth.height_change(cells, windows.select("project_id", "window_id", "t0", "t1"))
    volumes = regions.change_inside(change, mask, ["project_id", "window_id"], PARAMS.area, on=["project_id"]).drop("window_id")
    kind = reference.select(F.col("pid").alias("project_id"), "behave_or_control")
    return kind.join(cohort_counts(events, windows, bids), "project_id").join(volumes, "project_id", "left")


def cohort_depth_detail(cells: DataFrame, reference: DataFrame, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None) -> DataFrame:
    """The same volumes for each ten minutes, with the mask of the whole 90, the minutes left, and the running sum
    of the change inside.
    """
    mask = bower_mask(cells, whole_windows(reference), min_pixels, levels or regions.depth_levels())
    steps = steps_before(reference)
    change = depth.height_change(cells, steps.select("project_id", "window_id", "t0", "t1"))
    rows = regions.change_inside(change, mask, ["project_id", "window_id"], PARAMS.area, on=["project_id"])
    minutes = [minutes_to(F.col("event_time"), F.col(c)).alias(n) for c, n in (("t0", "minutes_start"), ("t1", "minutes_stop"))]
    both = steps.select("project_id", "window_id", *minutes).join(rows, ["project_id", "window_id"])
    return cumulative(both, "project_id", "window_id", "inside")


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins from lo to hi; a value on an edge falls into the bin above it, hi itself into the last one.

    The value is multiplied before it is divided: a bin's width may have no exact number.
    """
    b = F.least(F.lit(bins), F.floor(F.try_divide((F.col(value) - F.lit(float(lo))) * bins, F.lit(float(hi) - float(lo)))) + 1)
    return rows.where(F.col(value).between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


KEYS = ["project_id", "window_id"]


def window_volumes(cells: DataFrame, windows: DataFrame, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None, frames: DataFrame | None = None) -> DataFrame:
    """The volume summary of each window (project_id, window_id, t0, t1) with the regions of its own length's
    threshold. The change is worked out once and written, since regions, threshold and sums all need it.
    """
    change = written(depth.height_change(cells, windows.select(*KEYS, "t0", "t1"), frames=frames), "change")
    found = regions.timed_regions(change, windows.select(*KEYS, "t0", "t1"), KEYS, levels or regions.depth_levels(), min_pixels)
    return depth.volume_summary(change, KEYS, found, depth.good_pixels(cells))


def window_densities(events: DataFrame, windows: DataFrame, grid: DataFrame, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None, good: int | None = None) -> DataFrame:
    """The cluster summary of each window: density of spits minus that of scoops, its regions and their sums.
    ``events`` have project_id, TimeStamp, Prediction, X, Y and radius; windows without any are all zero.

    Only cells that an event reaches are made: all others are zero and change no sum, region or threshold.
    """
    w = windows.select(*KEYS, "t0", "t1")
    good = grid.count() if good is None else good
    difference = window_difference(events, w, grid)
    if int(good * PARAMS.index_fraction) == 0:  # the threshold is the least value of all cells, zeros included
        difference = w.select(*KEYS).join(F.broadcast(grid.select("y", "x"))).join(difference, [*KEYS, "y", "x"], "left").withColumn("change", F.coalesce("change", F.lit(0.0)))
    difference = written(difference, "densities")
    found = regions.timed_regions(difference, w, KEYS, levels or regions.density_levels(), min_pixels)
    summed = cluster_summary(difference, KEYS, found, good)
    rows = w.select(*KEYS).join(summed, KEYS, "left")
    return rows.select(*KEYS, *[F.coalesce(c, F.lit(0.0)).alias(c) if c != "bower_index" else F.col(c) for c in summed.columns if c not in KEYS])


def window_difference(events: DataFrame, windows: DataFrame, grid: DataFrame) -> DataFrame:
    """Density of spits minus that of scoops in each window, on the cells that either reaches."""
    inside = in_windows(events.where(F.col("Prediction").isin("c", "p")), windows.select(*KEYS, "t0", "t1"))
    return density_difference(inside, grid, KEYS)


def by_grain(make: Callable[[DataFrame], DataFrame], frames: DataFrame, grains: tuple[str, ...]) -> DataFrame:
    """One table of all grains' windows, with each window's length, start and middle; sheets are its partitions
    by ``grain``. The windows of all grains go through ``make`` at once.
    """
    windows = None
    for grain in grains:
        own = depth.calendar_windows(frames, grain).withColumn("grain", F.lit(grain))
        windows = own if windows is None else windows.unionByName(own)
    windows = written(windows.withColumnRenamed("window_id", "_own").withColumn("window_id", F.concat_ws("/", "grain", "_own")), "windows")
    rows = make(windows.select(*KEYS, "t0", "t1"))
    when = windows.select(*KEYS, "_own", "grain", F.col("t0").alias("start_time"), depth.midpoint(F.col("t0"), F.col("t1")).alias("midpoint"))
    both = rows.join(when, KEYS)
    return both.select("project_id", F.col("_own").alias("window_id"), *[c for c in rows.columns if c not in KEYS], "start_time", "midpoint", "grain")


GRAINS = ("total", "daily", "hourly")


def depth_report(cells: DataFrame, grains: tuple[str, ...] = GRAINS, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None) -> DataFrame:
    """Volume summaries of all windows of each grain in one table."""
    frames = written(depth.frame_times(cells), "frames")
    return by_grain(lambda w: window_volumes(cells, w, min_pixels, levels, frames), frames, grains)


def cluster_report(events: DataFrame, frames: DataFrame, grid: DataFrame, grains: tuple[str, ...] = GRAINS, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None) -> DataFrame:
    """Cluster summaries of all windows of each grain; ``frames`` (project_id, ts) span them."""
    return by_grain(lambda w: window_densities(events, w, grid, min_pixels, levels), frames, grains)


def pre_event_report(cells: DataFrame, events: DataFrame, reference: DataFrame, bids: list[str], grid: DataFrame | None = None, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None, density: tuple[float, float, float] | None = None) -> DataFrame:
    """For each step before a project's event, and for the whole span (window_id -1): the volume summary,
    the counts of events, the cluster summary (if there is a ``grid``; its columns begin with kde_) with the agreement of
    both kinds of regions, and the minutes left.
    """
    windows = steps_before(reference).unionByName(whole_windows(reference).withColumn("window_id", F.lit(-1)))
    windows = written(windows, "windows")
    volumes = window_volumes(cells, windows, min_pixels, levels)
    counts = event_counts(in_windows(events, windows), KEYS, bids)
    rows = windows.join(volumes, KEYS, "left").join(counts, KEYS, "left")
    minutes = [minutes_to(F.col("event_time"), F.col(c)).alias(n) for c, n in (("t0", "minutes_start"), ("t1", "minutes_stop"))]
    more = [c for c in volumes.columns if c not in KEYS]
    if grid is not None:
        kde = window_densities(events, windows, grid, min_pixels, density)
        kde = kde.select(*KEYS, *[F.col(c).alias(f"kde_{c}") for c in kde.columns if c not in KEYS])
        same = region_consistency(cells, events, windows, grid, min_pixels, levels, density).select(*KEYS, "agreement")
        rows = rows.join(kde, KEYS, "left").join(same, KEYS, "left")
        more += [*[c for c in kde.columns if c not in KEYS], "agreement"]
    return rows.select(*KEYS, *minutes, *more, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c not in KEYS])


def region_consistency(cells: DataFrame, events: DataFrame, windows: DataFrame, grid: DataFrame, min_pixels: int = PARAMS.min_pixels, levels: tuple[float, float, float] | None = None, density: tuple[float, float, float] | None = None, frames: DataFrame | None = None) -> DataFrame:
    """How far the regions of height change and those of event density agree in each window: cells where both have the
    same label over cells where either has one; 1 if neither has any, 0 if they share none.

    Both families of masks are labelled in one pass, each at its own threshold for the window's length. ``grid`` has
    the cells events are counted on, with the cube's own numbers.
    """
    w = windows.select(*KEYS, "t0", "t1")
    kinds = {"depth": levels or regions.depth_levels(), "density": density or regions.density_levels()}
    change = depth.height_change(cells, w, frames=frames).select(*KEYS, "y", "x", "change")
    both = [df.withColumn("family", F.lit(k)) for k, df in (("depth", change), ("density", window_difference(events, w, grid)))]
    seconds = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1_000_000
    th = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), depth.threshold(seconds, *v))])
    masks = both[0].unionByName(both[1]).join(w.select(*KEYS, th.alias("_th")), KEYS)
    masks = masks.select(*KEYS, "family", "y", "x", "change", F.try_element_at("_th", F.col("family")).alias("_th"))
    found = regions.bower_regions(masks, [*KEYS, "family"], F.col("_th"), min_pixels)
    label = lambda k: F.max(F.when(F.col("family") == k, F.col("label")))
    cells_of = found.groupBy(*KEYS, "y", "x").agg(label("depth").alias("_a"), label("density").alias("_b"))
    counts = cells_of.groupBy(*KEYS).agg(F.count("_a").alias("n_depth"), F.count("_b").alias("n_density"), F.count_if(F.col("_a") == F.col("_b")).alias("n_same"), F.count("*").alias("n_any"))
    rows = w.select(*KEYS).join(counts, KEYS, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*KEYS, *[zero(c) for c in ("n_depth", "n_density", "n_same")], F.when(F.col("n_any").isNull(), 1.0).otherwise(F.col("n_same") / F.col("n_any")).alias("agreement"))


def trial_windows(frames: DataFrame) -> DataFrame:
    """Each calendar day of a project, and ``trial``: from the first day's beginning to the last day's end."""
    daily = depth.calendar_windows(frames, "daily")
    whole = daily.groupBy("project_id").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return daily.unionByName(whole.select("project_id", F.lit("trial").alias("window_id"), "t0", "t1"))
