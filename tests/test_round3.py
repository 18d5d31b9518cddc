"""Findings of the third round: each test fails on the code before it."""

import time
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from reefline.operators import tracks
from reefline.plans import registry
from reefline.streaming import jobs


def test_histogram_edges_in_query_and_sql(spark, tmp_path):
    """Values on the edges of bins, whose width is no exact number."""
    values = [50.0 * k for k in range(11)] + [k / 100 for k in range(0, 50001, 1666)] + [-0.01, 500.01]
    spark.createDataFrame([(v,) for v in values], "value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = Counter(min(30, Fraction(v) * 30 // 500 + 1) for v in values if 0 <= v <= 500)
    assert {r.bin: r.n for r in registry.queries()["histogram"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert dict(con.sql(registry.oracle_sql()["histogram"]).fetchall()) == want


_MOVE = np.eye(7)
_MOVE[0, 4] = _MOVE[1, 5] = _MOVE[2, 6] = 1.0
_SEE = np.eye(4, 7)
_R = np.diag([1.0, 1.0, 10.0, 10.0])
_Q = np.diag([1.0, 1.0, 1.0, 1.0, 0.01, 0.01, 0.0001])
_P = np.diag([10.0, 10.0, 10.0, 10.0, 1e4, 1e4, 1e4])


def _measure(box: np.ndarray) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([box[0] + w / 2, box[1] + h / 2, w * h, w / h if h else 0.0])


def _corners(state: np.ndarray) -> np.ndarray:
    w = np.sqrt(max(state[2] * state[3], 0.0))
    h = state[2] / w if w else 0.0
    return np.array([state[0] - w / 2, state[1] - h / 2, state[0] + w / 2, state[1] + h / 2])


class Tracker:
    """One video at a time, by matrices: what the tracker of many videos is held against."""

    def __init__(self, max_age: int = 5, min_hits: int = 3, least: float = 0.3):
        self.max_age, self.min_hits, self.least = max_age, min_hits, least
        self.tracks: list[dict] = []
        self.frames = self.born = 0

    def step(self, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray) -> list[dict]:
        self.frames += 1
        for t in self.tracks:
            if t["x"][2] + t["x"][6] <= 0:
                t["x"][6] = 0.0
            t["x"], t["p"] = _MOVE @ t["x"], _MOVE @ t["p"] @ _MOVE.T + _Q
            t["streak"] = t["streak"] if t["missed"] == 0 else 0
            t["missed"] += 1
        self.tracks = [t for t in self.tracks if np.isfinite(t["x"]).all()]
        matched: dict[int, int] = {}
        if self.tracks and len(boxes):
            there = np.array([_corners(t["x"]) for t in self.tracks])
            lo, hi = np.maximum(boxes[:, None, :2], there[None, :, :2]), np.minimum(boxes[:, None, 2:], there[None, :, 2:])
            both = np.prod(np.clip(hi - lo, 0, None), axis=2)
            area = lambda b: np.prod(b[:, 2:] - b[:, :2], axis=1)
            union = area(boxes)[:, None] + area(there)[None] - both
            overlap = np.where(union > 0, both / np.where(union > 0, union, 1), 0)
            matched = {i: j for i, j in tracks.assign(-overlap) if overlap[i, j] >= self.least}
        for i, j in matched.items():
            t, z = self.tracks[j], _measure(boxes[i])
            gain = t["p"] @ _SEE.T @ np.linalg.inv(_SEE @ t["p"] @ _SEE.T + _R)
            t["x"] = t["x"] + gain @ (z - _SEE @ t["x"])
            t["p"] = (np.eye(7) - gain @ _SEE) @ t["p"]
            t.update(missed=0, streak=t["streak"] + 1, score=scores[i], kind=classes[i])
        for i in range(len(boxes)):
            if i not in matched:
                self.tracks.append({"id": self.born, "x": np.append(_measure(boxes[i]), [0.0] * 3), "p": _P.copy(), "missed": 0, "streak": 0, "score": scores[i], "kind": classes[i]})
                self.born += 1
        shown = [t for t in self.tracks if t["missed"] == 0 and (t["streak"] >= self.min_hits or self.frames <= self.min_hits)]
        self.tracks = [t for t in self.tracks if t["missed"] <= self.max_age]
        return shown


def _one_by_one(boxes: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for name, video in boxes.groupby("base_name"):
        tracker, last = Tracker(), None
        for frame, g in video.sort_values(["frame", "x1", "y1", "x2", "y2"]).groupby("frame"):
            for _ in range(last + 1, frame) if last is not None else []:
                tracker.step(np.zeros((0, 4)), np.zeros(0), np.zeros(0))
            last = frame
            for t in tracker.step(g[["x1", "y1", "x2", "y2"]].to_numpy(), g["score"].to_numpy(), g["class_id"].to_numpy()):
                b = _corners(t["x"])
                rows.append((name, t["id"], frame, t["x"][0], t["x"][1], b[2] - b[0], b[3] - b[1], t["kind"], *t["x"][4:], t["score"]))
    return pd.DataFrame(rows, columns=tracks._NAMES)


def _videos(n: int, seed: int = 0) -> pd.DataFrame:
    """Boxes that drift, cross, vanish and come back, in videos of many lengths."""
    rng, rows = np.random.default_rng(seed), []
    for v in range(n):
        many = rng.integers(1, 12)
        at, speed = rng.uniform(0, 400, (many, 2)), rng.normal(0, 4, (many, 2))
        for f in range(rng.integers(0, 5), rng.integers(10, 80)):
            if (v % 7 or not 20 < f < 30) and rng.random() > 0.1 * (v % 3):
                for k in np.flatnonzero(rng.random(many) < 0.75):
                    x, y = at[k] + speed[k] * f + rng.normal(0, 2, 2)
                    rows.append((f"v{v}", f, x, y, x + rng.uniform(30, 60), y + rng.uniform(30, 60), rng.random(), float(k % 3)))
    return pd.DataFrame(rows, columns=tracks._BOXES).sort_values(tracks._BOXES[:6])


def test_videos_are_tracked_together(monkeypatch):
    """The same tracks as one video at a time, wherever batches are cut, and many videos in far less time."""
    boxes = _videos(30)
    want = _one_by_one(boxes).sort_values(["base_name", "frame", "track_id"], ignore_index=True)
    for at_once in (200_000, 50):
        monkeypatch.setattr(tracks, "ROWS", at_once)
        batches = pa.Table.from_pandas(boxes, preserve_index=False).to_batches(max_chunksize=37)
        got = pd.concat([b.to_pandas() for b in tracks._tracks(iter(batches))]).sort_values(["base_name", "frame", "track_id"], ignore_index=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
    monkeypatch.undo()
    many = pd.concat([boxes.assign(base_name=boxes.base_name + f"/{k}") for k in range(20)]).sort_values(tracks._BOXES[:6])
    t = time.process_time()
    assert sum(b.num_rows for b in tracks._tracks(iter(pa.Table.from_pandas(many, preserve_index=False).to_batches()))) == 20 * len(want)
    together, t = time.process_time() - t, time.process_time()
    _one_by_one(boxes)
    assert together < 20 * (time.process_time() - t) / 5


def _crowd(spark, n_points: int, n_events: int):
    p = spark.range(n_points).select(F.lit("v").alias("base_name"), (F.col("id") % 97).alias("track_id"), (F.col("id") % 40).cast("int").alias("frame"), F.abs(F.hash("id") % 9973).cast("double").alias("xc"), F.abs(F.hash(F.col("id") + 7) % 9967).cast("double").alias("yc"))
    e = spark.range(n_events).select(F.col("id").alias("LID"), F.lit("v").alias("VideoID"), F.lit(0.7).alias("t"), (F.abs(F.hash("id") % 997) / 3).alias("X"), (F.abs(F.hash(F.col("id") + 3) % 991) / 3).alias("Y"), F.lit("Yes").alias("ClipCreated"))
    return e, p


def test_association_by_brute_force(spark):
    """Heaps of points, empty corners, ties, events far outside, windows over several buckets."""
    rng = np.random.default_rng(3)
    points = pd.DataFrame({"base_name": rng.choice(["v", "w"], 3000), "track_id": rng.integers(0, 9, 3000), "frame": rng.integers(0, 200, 3000).astype("int32"), "xc": rng.choice([20.0, 40.0, 60.0, 900.0], 3000), "yc": np.where(rng.random(3000) < 0.5, 7.0, rng.integers(0, 900, 3000))})
    events = pd.DataFrame({"LID": np.arange(120), "VideoID": rng.choice(["v", "w", "x"], 120), "t": rng.uniform(-1, 8, 120), "X": rng.integers(0, 900, 120).astype(float), "Y": rng.integers(0, 900, 120).astype(float), "ClipCreated": "Yes"})
    events.loc[:3, ["X", "Y"]] = [[5000.0, -9.0], [-7.0, 1e6], [7.0, 20.0], [400.0, -1e5]]
    want = {}
    for e in events.itertuples():
        near = points[(points.base_name == e.VideoID) & (points.frame > (e.t - 0.5) * 29) & (points.frame < (e.t + 0.5) * 29)]
        near = near.assign(d=(near.yc - e.X) ** 2 + (near.xc - e.Y) ** 2).sort_values(["d", "frame", "track_id"])
        want[e.LID] = (near.d.iloc[0], near.frame.iloc[0], near.track_id.iloc[0]) if len(near) else (None, None, None)
    rows = tracks.associate(spark.createDataFrame(events), spark.createDataFrame(points), 29, 0.5).collect()
    assert {r.LID: (r.distance2, r.frame, r.track_id) for r in rows} == want


def test_association_in_a_crowd(spark):
    """A window with 150,000 points and 15,000 events makes no pair of every two: that took minutes."""
    e, p = _crowd(spark, 200_000, 15_000)
    tracks.associate(*_crowd(spark, 100, 10), 29, 0.5).count()
    t = time.monotonic()
    assert tracks.associate(e, p, 29, 0.5).where("distance2 IS NOT NULL").count() == 15_000
    assert time.monotonic() - t < 40


def test_many_array_files_make_few_tasks(spark, tmp_path):
    """Partitions are planned without opening a file, and their number does not grow with that of the bands."""
    from reefline.sources import arrays

    files = [(k, f"/not/there/{k}.npy", 12_928) for k in range(5_000)]
    plan = arrays._plan(files, 4096, arrays.BATCH_BYTES)
    assert len(plan) <= arrays.PARTS and sorted(p for x in plan for p in x.parts) == sorted((f, k, 4) for _, f, _ in files for k in range(4))


def test_boxes_are_shuffled_once(spark):
    """Boxes that meet one another cross the network once, not once for each side of the join."""
    box = "base_name string, frame int, box_id long, x1 double, y1 double, x2 double, y2 double"
    b = spark.createDataFrame([("v", 1, 1, 0.0, 0.0, 300.0, 300.0), ("v", 1, 2, 10.0, 10.0, 310.0, 310.0), ("v", 2, 3, 0.0, 0.0, 1e7, 1e7), ("v", 2, 4, 0.0, 0.0, 9e6, 1e7)], box)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = tracks.iou_pairs(b)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert {(r.a_id, r.b_id) for r in pairs.collect()} == {(1, 2), (3, 4)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    lines = [x.strip(" :+-*") for x in plan.splitlines()]
    assert sum(x.startswith("Exchange hashpartitioning") for x in lines) == 1 and sum(x.startswith("ReusedExchange") for x in lines) == 1


def test_live_views_read_the_state_three_times(spark, tmp_path):
    """Once for the last frames, once for all hours and the trial, once for days and nights, however many hours there are."""
    rows = [(f"P{p}", y, x, float(p + y * t), f"2024-01-0{1 + t // 24} {t % 24:02d}:00:00") for p in range(2) for y in range(2) for x in range(2) for t in range(5, 40, 3) if (y, t) != (1, 38)]
    cells = spark.createDataFrame(rows, "project_id string, y int, x int, depth double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    jobs._held(cells).write.parquet(str(tmp_path / "state"))
    views = jobs.live_views(spark.read.parquet(str(tmp_path / "state")), (1, 5, 12))
    assert views._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("FileScan") <= 3
    got = {(r.project_id, r.window_id, r.y, r.x): r.change for r in views.collect()}
    assert len(got) == views.count() == 2 * 2 * 2 * 7 - 2 * 2  # three windows of hours, two days, a night and the trial; a row of cells misses the last frame
    assert got["P0", "last 5 h", 1, 0] == 0.0 and got["P0", "last 12 h", 1, 0] == 6.0 and ("P0", "last 1 h", 1, 0) not in got
    assert got["P1", "day 2024-01-01", 1, 1] == 9.0 and got["P1", "night 2024-01-02", 1, 1] == 15.0 and got["P1", "trial", 1, 1] == 27.0


def test_streams_keep_many_keys_to_a_group(spark):
    """A group steps its videos together, so that a step's fixed cost is shared: thousands of keys lie in a few hundred groups."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("base_name"))
    groups = rows.select(F.pmod(F.xxhash64("base_name"), F.lit(jobs.GROUPS)).alias("g")).groupBy("g").count()
    assert groups.count() <= 512 and groups.agg(F.sum("count")).first()[0] == 3000
