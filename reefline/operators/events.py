"""Classified events: slices, counts, density grids and their summary."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.functions.expr import category, hour_bin, seconds_to
from reefline.operators.depth import volume_summary
from reefline.schemas import PARAMS


def crop(events: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Events strictly inside (left, top, right, bottom), with coordinates from its corner."""
    left, top, right, bottom = box
    inside = (F.col("X") > left) & (F.col("X") < right) & (F.col("Y") > top) & (F.col("Y") < bottom)
    return events.where(inside).withColumns({"X": F.col("X") - left, "Y": F.col("Y") - top})


def event_slice(events: DataFrame, t0: Column | None = None, t1: Column | None = None, bids: list[str] | None = None, box=None, columns: list[str] | None = None) -> DataFrame:
    """Classified events between t0 and t1, both included, of the given behaviours."""
    rows = events.where(F.col("Prediction").isNotNull())
    if t0 is not None:
        rows = rows.where(F.col("TimeStamp") >= t0)
    if t1 is not None:
        rows = rows.where(F.col("TimeStamp") <= t1)
    if bids:
        rows = rows.where(F.col("Prediction").isin(bids))
    if box:
        rows = crop(rows, box)
    return rows.select(*columns) if columns else rows


def event_counts(events: DataFrame, keys: list[str], bids: list[str]) -> DataFrame:
    """A count of each behaviour, a column for each."""
    return events.groupBy(*keys).agg(*[F.count_if(F.col("Prediction") == b).alias(f"n_{b}") for b in bids], F.count("Prediction").alias("n_all"))


def in_windows(events: DataFrame, windows: DataFrame, bucket_seconds: int = 21_600) -> DataFrame:
    """Events with each window (project_id, window_id, t0, t1) that holds them, both ends included.

    Windows are laid out over buckets of time, so that a project of many windows is spread over its buckets
    and an event meets only those of its own.
    """
    b = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (bucket_seconds * 1_000_000))
    w = windows.where("t0 <= t1").select("project_id", "window_id", "t0", "t1", F.explode(F.sequence(b(F.col("t0")), b(F.col("t1")))).alias("_b"))
    return events.withColumn("_b", b(F.col("TimeStamp"))).join(w, ["project_id", "_b"]).where(F.col("TimeStamp").between(F.col("t0"), F.col("t1"))).drop("_b")


#: Bandwidths from a place beyond which its kernel is left out, along either axis: what is left out of a cell is less
#: than 3e-18 of the place's own peak, so a cell that n places miss lacks less than n times that.
REACH = 9.0
#: Side of the square tiles that events are dealt to, and events of a window that are worked on in one task.
TILE, TOGETHER = 32, 20_000


def _tile_sums(keys: list[str], out: list[str]):
    """Sums of kernels over the cells of a tile, for each run of rows (sorted by keys and tile); empty cells are left out."""
    own = [*keys, "_ty", "_tx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = False
            for c in own:
                v = batch[c]
                a, b = v.slice(1), v.slice(0, len(v) - 1)
                fresh[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
            starts = np.append(np.flatnonzero(fresh), batch.num_rows)
            px, py, h, ty, tx, x0, x1, y0, y1 = (batch[c].to_numpy() for c in ("_px", "_py", "_h", "_ty", "_tx", "_x0", "_x1", "_y0", "_y1"))
            which, ys, xs, zs = [], [], [], []
            for i, j in itertools.pairwise(starts.tolist()):
                sides = []
                for at, t, lo, hi in ((py, ty, y0, y1), (px, tx, x0, x1)):
                    cells = np.arange(max(lo[i], t[i] * TILE), min(hi[i], t[i] * TILE + TILE - 1) + 1)
                    away = (cells - at[i:j, None]) / h[i]
                    sides.append((cells, np.where(np.abs(away) <= REACH, np.exp(-0.5 * away * away), 0.0)))
                (cy, ky), (cx, kx) = sides
                z = ky.T @ kx
                r, c = np.nonzero(z)
                which.append(np.full(len(r), i))
                ys.append(cy[r])
                xs.append(cx[c])
                zs.append(z[r, c])
            at = pa.array(np.concatenate(which))
            made = [pa.array(np.concatenate(ys), pa.int32()), pa.array(np.concatenate(xs), pa.int32()), pa.array(np.concatenate(zs))]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in keys), *made], names=out)

    return run


def density_cells(events: DataFrame, grid: DataFrame, keys: list[str], bandwidth: float | None = None, p=PARAMS) -> DataFrame:
    """Gaussian density of events (keys, X, Y, radius) on the cells of ``grid`` (y, x: whole numbers) that they reach: ``keys,
    y, x, z``, scaled so that a window's cells add up to its events. The bandwidth is half the mean radius, a quarter
    of a cell at least. Events without a place or a key are left out, and a window is empty if none of its events reaches the grid.

    An event is sent to the tiles within ``REACH`` bandwidths, so a row's copies are bounded by its radius. The kernel is a
    product, so a tile's cells are one matrix product of its events' rows and columns. Busy windows are dealt out
    by place, and partial tiles are added up.
    """
    placed = events.where("X IS NOT NULL AND Y IS NOT NULL").select(*keys, F.col("X").cast("double").alias("_px"), F.col("Y").cast("double").alias("_py"), "radius")
    h = F.lit(float(bandwidth)) if bandwidth else F.greatest(F.lit(0.25), F.coalesce(F.avg("radius") / 2, F.lit(0.0)))
    stats = placed.groupBy(*keys).agg(h.alias("_h"), F.count("*").alias("_total"))
    size = F.broadcast(grid.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")))  # one row

    def tiles(at: str, lo: str, hi: str) -> Column:
        first, last = F.greatest(F.col(lo), F.ceil(F.col(at) - REACH * F.col("_h")).cast("int")), F.least(F.col(hi), F.floor(F.col(at) + REACH * F.col("_h")).cast("int"))
        return F.explode(F.when(first <= last, F.sequence(F.floor(first / TILE).cast("int"), F.floor(last / TILE).cast("int"))))

    salt = F.pmod(F.xxhash64("_px", "_py"), F.ceil(F.col("_total") / F.lit(TOGETHER)))
    dealt = placed.drop("radius").join(stats, keys).join(size).withColumn("_ty", tiles("_py", "_y0", "_y1")).withColumn("_tx", tiles("_px", "_x0", "_x1")).withColumn("_salt", salt)
    order = [*keys, "_ty", "_tx"]
    sent = dealt.drop("_total").repartition(*order, "_salt").sortWithinPartitions(*order, "_salt")
    out = [*keys, "y", "x", "z"]
    kinds = {f.name: f.dataType.simpleString() for f in placed.select(*keys).schema}
    made = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "y int, x int, z double"])
    z = sent.mapInArrow(_tile_sums(keys, out), made).groupBy(*keys, "y", "x").agg(F.sum("z").alias("_z"))
    z = z.join(F.broadcast(grid.select("y", "x")), ["y", "x"]).join(stats.select(*keys, "_total"), keys)
    return z.select(*keys, "y", "x", F.try_divide(F.col("_z") * F.col("_total"), F.sum("_z").over(W.partitionBy(*keys)) * p.area).alias("z"))


def density_grid(events: DataFrame, grid: DataFrame, keys: list[str], bandwidth: float | None = None, windows: DataFrame | None = None, p=PARAMS) -> DataFrame:
    """``density_cells`` on every cell of the grid, zero where none reaches. With ``windows`` (keys), those without events
    have zeros throughout.
    """
    out = density_cells(events, grid, keys, bandwidth, p)
    windows = events.where("X IS NOT NULL AND Y IS NOT NULL") if windows is None else windows
    cells = windows.select(*keys).distinct().join(F.broadcast(grid.select("y", "x")))  # as many rows as are returned
    return cells.join(out, [*keys, "y", "x"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def density_difference(events: DataFrame, grid: DataFrame, keys: list[str], plus: str = "p", minus: str = "c") -> DataFrame:
    """Density of one behaviour minus that of another (``keys, y, x, change``) on the cells that either reaches, in one pass."""
    both = events.where(F.col("Prediction").isin(plus, minus)).withColumn("_sign", F.when(F.col("Prediction") == plus, 1).otherwise(-1))
    z = density_cells(both, grid, [*keys, "_sign"])
    return z.groupBy(*keys, "y", "x").agg(F.sum(F.col("z") * F.col("_sign")).alias("change"))


def cluster_summary(difference: DataFrame, keys: list[str], regions: DataFrame, good: DataFrame | int) -> DataFrame:
    """The volume summary's formula on a density difference; ``good`` counts the grid's cells."""
    return volume_summary(difference, keys, regions, good)


def category_ratio(events: DataFrame, keys: list[str]) -> DataFrame:
    """Share of events of category Other; null where there are none at all."""
    return events.groupBy(*keys).agg(F.try_divide(F.count_if(F.col("category") == "Other"), F.count("*")).alias("other_share"), F.count("*").alias("n"))


def label_pairs(rows: DataFrame, key: str, kind: Column, kinds: list[str]) -> DataFrame:
    """How many rows of each kind a key has, a column for each, zero-filled, sorted by key."""
    return rows.withColumn("_kind", kind).groupBy(key).pivot("_kind", kinds).count().na.fill(0).orderBy(key)


def sex_behaviour(events: DataFrame, association: DataFrame, points: DataFrame, reference: DataFrame, names: dict[str, str], inside: Column, least_p: float = 0.75, least_frames: int = 30, of: tuple[str, ...] = ("Construction", "Feeding")) -> DataFrame:
    """Events by project, category, sex of the nearest track, and two-hour bin relative to the reference event.

    Tracks take the mean class of their points surer than ``least_p``; a track is its video's and its
    number together. Only events ``inside`` the bounds, of tracks seen in more than ``least_frames`` frames and
    of the categories ``of`` are counted; the bin is negative before the event.
    """
    sexed = points.where(F.col("sex_p_value") > least_p).groupBy("base_name", "track_id").agg(F.count("frame").alias("_frames"), F.avg("sex_class").alias("_class"))
    e = events.withColumn("category", category(F.col("Prediction"), names)).where(inside)
    rows = e.join(association.select("LID", "VideoID", "track_id"), ["LID", "VideoID"]).join(sexed.withColumnRenamed("base_name", "VideoID"), ["VideoID", "track_id"])
    rows = rows.join(reference.select(F.col("pid").alias("project_id"), "dissection_time"), "project_id").where((F.col("_frames") > least_frames) & F.col("category").isin(*of))
    until = -seconds_to(F.col("dissection_time"), F.col("TimeStamp"))
    sex = F.when(F.col("_class") > 0.5, "Male").otherwise("Female")
    return rows.groupBy("project_id", "category", sex.alias("sex"), hour_bin(until).alias("time_bin")).agg(F.count("track_id").alias("n"))


def association_ratios(events: DataFrame, names: dict[str, str], inside: Column) -> DataFrame:
    """Share of events of category Other inside and outside the bounds, by project; null where a side has none."""
    rows = events.withColumn("category", F.coalesce(category(F.col("Prediction"), names), F.lit("Other"))).withColumn("_in", inside)
    share = lambda side: F.try_divide(F.count_if((F.col("_in") == side) & (F.col("category") == "Other")), F.count_if(F.col("_in") == side))
    return rows.groupBy("project_id").agg(share(False).alias("out_other_ratio"), share(True).alias("in_other_ratio"))
