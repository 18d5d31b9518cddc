"""Regions on pixel grids: thresholds, 4-connected components, agreement, change inside a mask.

``components`` has two forms. ``per_mask`` labels one mask (a window's grid, bounded by the camera) in
one numpy task; ``fixpoint`` is a DataFrame loop with pointer jumping for masks too large for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.operators.depth import threshold
from reefline.schemas import PARAMS
from reefline.shared import written


def signed_mask(change: DataFrame, keys: list[str], th: float | F.Column, value: str = "change", mode: str = "signed") -> DataFrame:
    """Pixels at or beyond the threshold with their sign; ``abs`` puts both signs into one mask."""
    v = F.col(value)
    sign = F.when(v >= th, 1).when(v <= -th, -1)
    rows = change.select(*keys, "y", "x", value, sign.alias("sign")).where("sign IS NOT NULL")
    return rows.withColumn("part", F.lit(0) if mode == "abs" else F.col("sign"))


def least_neighbours(y: np.ndarray, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """For each cell the place of the least cell (by y, then x) of its 4-connected component; cells come
    sorted, by ``mask`` first if there are several. Labels run along neighbour links and are halved by jumping until none changes.
    """
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    wide, tall = int(x.max()) - int(x.min()) + 2, int(y.max()) - int(y.min()) + 2
    code = (y.astype(np.int64) - y.min()) * wide + (x - x.min())
    if mask is not None:
        code += mask.astype(np.int64) * (wide * tall)
    a, b = [], []
    for step in (1, wide):
        at = np.minimum(np.searchsorted(code, code + step), n - 1)
        hit = np.flatnonzero(code[at] == code + step)
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while not np.array_equal(up := label[label], label):
            label = up


def _label_runs(keys: list[str]):
    """Labels masks, many at a time; the last one of a batch waits for the next, which may go on with it."""

    def fresh(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in keys:
            v = t[c].combine_chunks()
            a, b = v.slice(1), v.slice(0, max(0, len(v) - 1))
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        return new

    def label(t: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        root = least_neighbours(y, x, np.cumsum(new))
        yield from t.append_column("root_y", pa.array(y[root], pa.int32())).append_column("root_x", pa.array(x[root], pa.int32())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if not held.num_rows:
                continue
            new = fresh(held)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from label(held.slice(0, last), new[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from label(held, fresh(held))

    return run


def per_mask(mask: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """``keys, y, x, root_y, root_x``: the least pixel of each 4-connected component of masks with ``least`` pixels and more.
    Small masks share a batch, so a table of many windows costs no call for each.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mask.select(*keys).schema) + ", y int, x int, root_y int, root_x int"
    n = F.count("*").over(W.partitionBy(*keys))
    own = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), n.alias("_n")).where(F.col("_n") >= least)
    return own.drop("_n").sortWithinPartitions(*keys, "y", "x").mapInArrow(_label_runs(keys), schema)


def fixpoint(mask: DataFrame, keys: list[str]) -> DataFrame:
    """The same by min-label propagation with pointer jumping, written to the shared folder each round."""
    own = F.struct("y", "x")
    state = written(mask.select(*keys, "y", "x", own.alias("r")), "labels")
    while True:
        steps = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
        sent = state.select(*keys, "r", steps.alias("n")).select(*keys, "n.y", "n.x", "r").groupBy(*keys, "y", "x").agg(F.min("r").alias("_m"))
        near = state.join(sent, [*keys, "y", "x"]).select(*keys, "y", "x", "r", F.col("_m").alias("m"))
        jump = near.select(*keys, F.col("y").alias("my"), F.col("x").alias("mx"), F.col("m").alias("_to"))
        new = near.select(*keys, "y", "x", "r", F.col("m.y").alias("my"), F.col("m.x").alias("mx")).join(jump, [*keys, "my", "mx"])
        new = written(new.select(*keys, "y", "x", F.col("_to").alias("r"), (F.col("_to") != F.col("r")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select(*keys, "y", "x", F.col("r.y").alias("root_y"), F.col("r.x").alias("root_x"))
        state = new.drop("moved")


def bower_regions(change: DataFrame, keys: list[str], th: float | F.Column, min_pixels: int, value: str = "change", mode: str = "signed", how: str = "per_mask") -> DataFrame:
    """Pixels of components of ``min_pixels`` and more: ``keys, y, x, label`` (1 castle, -1 pit) and the
    component's ``size``; with ``mode='abs'`` both signs connect.
    """
    mask = signed_mask(change, keys, th, value, mode)
    parts = [*keys, "part"]
    labelled = per_mask(mask, parts, min_pixels) if how == "per_mask" else fixpoint(mask, parts)
    sizes = labelled.groupBy(*parts, "root_y", "root_x").agg(F.count("*").alias("size")).where(F.col("size") >= min_pixels)
    return labelled.join(sizes, [*parts, "root_y", "root_x"]).join(mask, [*parts, "y", "x"]).select(*keys, "y", "x", F.col("sign").alias("label"), "size", value)


def jaccard(a: DataFrame, b: DataFrame, keys: list[str], windows: DataFrame) -> DataFrame:
    """Agreement of two labelled masks in every window: equal labels over any label; 1 if both are empty."""
    both = a.select(*keys, "y", "x", F.col("label").alias("_a")).join(b.select(*keys, "y", "x", F.col("label").alias("_b")), [*keys, "y", "x"], "full")
    counts = both.groupBy(*keys).agg(F.count_if(F.col("_a") == F.col("_b")).alias("same"), F.count("*").alias("any"))
    rows = windows.join(counts, keys, "left")
    return rows.select(*keys, F.when(F.col("any").isNull(), 1.0).otherwise(F.col("same") / F.col("any")).alias("agreement"))


def change_inside(change: DataFrame, regions: DataFrame, keys: list[str], area: float, value: str = "change", on: list[str] | None = None) -> DataFrame:
    """Absolute change inside a mask and over the whole grid, by window. ``on``: keys the mask has."""
    on = keys if on is None else on
    rows = change.join(regions.select(*on, "y", "x", F.lit(True).alias("_in")), [*on, "y", "x"], "left")
    v = F.abs(value)
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("_in"), v)), F.lit(0.0)) * area).alias("inside"), (F.coalesce(F.sum(v), F.lit(0.0)) * area).alias("overall"))


def timed_regions(change: DataFrame, windows: DataFrame, keys: list[str], levels: tuple[float, float, float], min_pixels: int = PARAMS.min_pixels, value: str = "change", mode: str = "signed") -> DataFrame:
    """``bower_regions`` with the threshold of each window's own length: ``levels`` are those of windows under
    7300 s, under 129600 s, and longer. ``windows`` has keys, t0, t1, one row for each window.
    """
    seconds = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1_000_000
    th = windows.select(*keys, threshold(seconds, *levels).alias("_th"))
    return bower_regions(change.join(th, keys), keys, F.col("_th"), min_pixels, value, mode)


def depth_levels(p=PARAMS) -> tuple[float, float, float]:
    return p.hourly_depth, p.daily_depth, p.total_depth


def density_levels(p=PARAMS) -> tuple[float, float, float]:
    return p.hourly_density, p.daily_density, p.total_density
