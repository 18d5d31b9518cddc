"""Operators on small hand-made inputs with edge rows."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reefline.functions import expr
from reefline.operators import catalog, depth, events, regions, reports, tracks
from reefline.schemas import PARAMS
from reefline.sources import files, logs
from reefline.streaming import jobs

LOG = """MasterStart: System: pi-1,,Device: realsense,,Camera: True,,Uname: u,,TankID: P_1,,ProjectID: Tk3,,AnalysisID: A1
FrameCaptured: NpyFile: Frames/F_2.npy,,PicFile: Frames/F_2.jpg,,Time: 2020-02-13 08:05:00.123456,,NFrames: 30,,AvgMed: 57.20,,AvgStd: 0.05,,GP: 300,,LOF: True
FrameCaptured: NpyFile: February-12-2020/F_1.npy,,PicFile: x,,Time: 08:05:00,,AvgMed: bad,,AvgStd=0.06,,GP: 301,,LOF: False
BackgroundCaptured: NpyFile: B.npy,,PicFile: B.jpg,,Time: Wed Feb 12 08:00:00 2020,,AvgMed: 1,,AvgStd: 1,,GP: 1,,LOF: True
PiCameraStarted: FrameRate: 30,,Resolution: 640x480,,Time: 2020-02-12 08:00:01,,VideoFile: Videos/0001_vid.h264,,PicFile: Videos/0001_pic.jpg
PiCameraStarted: Time: 2020-02-12 09:00:01,,File: Videos/0002_vid.h264
PiCameraStopped: Time: 2020-02-12 18:00:00,,File: Videos/0001_vid.h264
TankResetStart: Time: 2020-02-12 18:00:00"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("logs") / "P1"
    p.mkdir()
    (p / "Logfile.txt").write_text(LOG)
    return logs.read_lines(spark, str(p))


def test_log_records(lines):
    assert {r.type: r["count"] for r in logs.records(lines).groupBy("type").count().collect()}["FrameCaptured"] == 2
    rows = logs.frames(lines).orderBy("frame_idx").collect()
    assert [(r.project_id, r.npy_file, str(r.time), r.med, r.std, r.gp, r.lof, r.rel_day) for r in rows] == [
        ("P1", "February-12-2020/F_1.npy", "2020-02-12 08:05:00", None, 0.06, 301, False, 1),
        ("P1", "Frames/F_2.npy", "2020-02-13 08:05:00.123456", 57.2, 0.05, 300, True, 2),
    ]
    assert str(logs.frames(lines, "BackgroundCaptured").first().time) == "2020-02-12 08:00:00"
    m = {r.base_name: r for r in logs.movies(lines, logs.frames(lines)).collect()}
    assert (m["0001_vid"].width, str(m["0001_vid"].end_time)) == (640, "2020-02-12 18:00:00")
    assert (m["0002_vid"].framerate, m["0002_vid"].pic_file, str(m["0002_vid"].end_time)) == (30.0, "Unknown", "2020-02-13 08:05:00.123456")
    h = logs.headers(lines).first()
    assert (h.tank_id, h.log_project, h.n_headers) == ("Tk3", "P_1", 1)


def test_typed_values(spark):
    df = spark.createDataFrame([("2020-02-12 08:00:00",), ("(1, 2, 3)",), ("True",), ("12",), ("1.5",), ("1296x972",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(expr.typed(F.col("v"))).collect()] == ["date", "tuple", "bool", "int", "float", "resolution", "text", "text"]
    assert df.select(expr.int_tuple(F.col("v"))).collect()[1][0] == [1, 2, 3]


def test_files(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.array([[1.0, np.nan], [3.0, 4.0]]))
    rows = files.read_arrays(spark, str(tmp_path)).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.value) for r in rows] == [(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)]
    det = tmp_path / "det"
    det.mkdir()
    (det / "vid_12.txt").write_text("1 0.5 0.5 0.1 0.2 0.9\n")
    (det / "vid_13.txt").write_text("")
    (r,) = files.read_detections(spark, str(det), 100, 100).collect()
    assert (r.base_name, r.frame, r.class_id, r.score) == ("vid", 12, 1.0, 0.9)
    assert [round(x, 6) for x in (r.x1, r.y1, r.x2, r.y2)] == [45, 40, 55, 60]
    (tmp_path / "a.json").write_text(json.dumps({"shapes": [{"type": "rectangle", "points": [1, 2, 3, 4], "frame": 5, "attributes": [], "label": "Fish"}]}))
    assert files.read_annotations(spark, str(tmp_path / "a.json")).first().frame == 5
    (tmp_path / "m.jsonl").write_text('{"version": "1.0"}\n{"name": "f5", "extension": ".png", "width": 10, "height": 10, "index": 5}\n')
    assert [r.name for r in files.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == ["f5"]
    t = spark.createDataFrame([([5, 1, 2, 9],)], "t array<int>").select(files.tray(F.col("t")).alias("t")).first().t
    assert t == [2, 1, 5, 9]
    out = str(tmp_path / "out")
    files.write_sheets({"Total": spark.range(1), "Daily": spark.range(2)}, out)
    assert spark.read.parquet(out).groupBy("sheet").count().count() == 2


def _cube(spark, series: dict, lof=lambda i: True, day=lambda i: "2024-01-01"):
    rows = [("P", i, y, x, None if v is None else float(v), lof(i), day(i)) for (y, x), vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "project_id string, frame_idx int, y int, x int, depth double, lof boolean, day string").withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 08:00:00' + make_dt_interval(0, 0, frame_idx * 5)"))


def _series(df, y=0, x=0):
    return [r.depth for r in df.where((F.col("y") == y) & (F.col("x") == x)).orderBy("frame_idx").collect()]


def test_gap_interpolation_edges(spark):
    n = None
    good = [n, 1, 2, n, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 99, n]  # 18 of 20 in the slice
    border = [1, n, n, n, n, *range(5, 20), n]  # exactly 0.8: left alone
    out = depth.gap_interpolate(_cube(spark, {(0, 0): good, (0, 1): border, (1, 0): [n] * 21}))
    assert _series(out)[:5] == [1, 1, 2, 3, 4] and _series(out)[-1] is None
    assert _series(out, 0, 1)[1:5] == [n] * 4 and _series(out, 1, 0) == [n] * 21


def test_night_fill_ties_take_the_earlier_boundary(spark):
    lof = lambda i: i in (1, 2, 6, 7)
    day = lambda i: "2024-01-01" if i < 5 else "2024-01-02"
    out = depth.night_fill(_cube(spark, {(0, 0): [0, 10, 20, 0, 0, 0, 60, None, 0]}, lof, day))
    # before the first: boundary 1; 3, 4 lie between 2 and 6; 8 takes the last boundary, which is null
    assert _series(out) == [10, 10, 20, 40, 40, 40, 60, None, None]


def test_masks(spark):
    c = _cube(spark, {(0, 0): [50.0, 53.0] * 10, (0, 1): [50.0, 53.1] * 10, (1, 0): [51.5] * 18 + [None] * 2, (1, 1): [56.0] * 20})
    m = {(r.y, r.x): r for r in depth.pixel_masks(c).collect()}
    assert m[0, 0].good and m[0, 1].noisy and m[1, 0].sparse and m[1, 1].out_of_range
    assert _series(depth.apply_masks(c, depth.pixel_masks(c)), 0, 1) == [None] * 20


def test_savgol_keeps_a_quartic_and_mirrors(spark):
    t = np.arange(100)
    v = 1e-6 * (t - 40.0) ** 4 - 0.1 * t
    got = np.array(_series(depth.savgol(_cube(spark, {(0, 0): v, (0, 1): [1.0] * 10}))))
    assert np.abs(got[35:65] - v[35:65]).max() < 1e-8
    padded = np.concatenate((v[35:0:-1], v, v[-2:-37:-1]))
    want = np.convolve(padded, expr.savgol_coefficients(71, 4)[::-1], "valid")
    assert np.abs(got - want).max() < 1e-8
    assert np.allclose(_series(depth.savgol(_cube(spark, {(0, 1): [1.0] * 10})), 0, 1), 1.0)


def test_asof_clamps_and_exact_last(spark):
    c = _cube(spark, {(0, 0): [1, 2, 3]})
    t = spark.sql("SELECT 'P' AS project_id, k, t FROM VALUES (0, TIMESTAMP_NTZ '2024-01-01 07:00:00'), (1, TIMESTAMP_NTZ '2024-01-01 08:09:59'), (2, TIMESTAMP_NTZ '2024-01-01 08:10:00'), (3, TIMESTAMP_NTZ '2024-01-01 09:00:00') AS v(k, t)")
    assert [r.depth for r in depth.height_at(c, t).orderBy("k").collect()] == [1, 2, 3, 3]
    f = depth.forward_frames(depth.frame_times(c), t).orderBy("k").collect()
    assert [r.frame_idx for r in f] == [0, 2, 2, None]


def test_carry_missing_frames(spark):
    c = _cube(spark, {(0, 0): [None, 7, 0]})
    present = spark.createDataFrame([("P", 0, True), ("P", 1, True), ("P", 2, False)], "project_id string, frame_idx int, has_file boolean")
    assert _series(depth.carry_missing_frames(c.select("project_id", "frame_idx", "y", "x", "depth"), present)) == [None, 7, 7]


def test_components_agree_and_partition_the_mask(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(0, 1, (12, 12))
    rows = [("w", y, x, float(grid[y, x])) for y in range(12) for x in range(12)]
    change = spark.createDataFrame(rows, "window_id string, y int, x int, change double")
    a, b = (regions.bower_regions(change, ["window_id"], 0.5, 2, how=h).toPandas().sort_values(["y", "x"]).reset_index(drop=True) for h in ("per_mask", "fixpoint"))
    pd.testing.assert_frame_equal(a, b)
    assert ((a.change >= 0.5) == (a.label == 1)).all() and (a["size"] >= 2).all()
    windows = change.select("window_id").distinct()
    r = regions.bower_regions(change, ["window_id"], 0.5, 2)
    assert regions.jaccard(r, r, ["window_id"], windows).first().agreement == 1.0
    assert regions.jaccard(r.limit(0), r.limit(0), ["window_id"], windows).first().agreement == 1.0
    assert regions.jaccard(r, r.limit(0), ["window_id"], windows).first().agreement == 0.0


def test_volume_summary_by_hand(spark):
    """Castle 3, 2 and pit -4; outside 1, -1. Of 25 good pixels the second largest is 3: only the pit lies above it."""
    rows = [("p", "w", 0, i, float(v)) for i, v in enumerate([3, 2, 1, -1, -4])] + [("p", "w", 0, 5, None)]
    change = spark.createDataFrame(rows, "project_id string, window_id string, y int, x int, change double")
    marks = spark.createDataFrame([("p", "w", 0, 0, 1), ("p", "w", 0, 1, 1), ("p", "w", 0, 4, -1)], "project_id string, window_id string, y int, x int, label int")
    keys = ["project_id", "window_id"]
    s = depth.volume_summary(change, keys, marks, 25).first()
    a = PARAMS.area
    want = dict(absolute_volume=11 * a, summed_volume=1 * a, castle_area=2 * a, pit_area=a, castle_volume=5 * a, pit_volume=4 * a, bower_volume=9 * a, threshold_castle_volume=0, threshold_pit_volume=4, bower_index=-1)
    assert s.asDict() == {"project_id": "p", "window_id": "w", **{k: pytest.approx(v) for k, v in want.items()}}
    s = depth.volume_summary(change, keys, marks, 9).first()  # k is zero: the smallest, 1
    assert (s.threshold_castle_volume, s.threshold_pit_volume, s.bower_index) == (5, 4, pytest.approx(1 / 9))
    s = depth.volume_summary(change, keys, marks, 100).first()  # fewer values than k: 0
    assert s.bower_index == pytest.approx(1 / 9) and depth.kth_threshold(change, keys, 100).first().threshold == 0
    assert depth.volume_summary(change, keys, marks.limit(0), 25).first().bower_index is None
    cube = spark.createDataFrame([("p", f, 0, x, None if (f, x) == (1, 0) else 1.0) for f in (1, 2) for x in range(3)], "project_id string, frame_idx int, y int, x int, depth double")
    assert depth.good_pixels(cube).first().good_pixels == 2


def test_thresholds_by_length_of_window(spark):
    change = spark.createDataFrame([("p", w, 0, 0, 0.5) for w in "abc"], "project_id string, window_id string, y int, x int, change double")
    windows = spark.sql("SELECT 'p' AS project_id, w AS window_id, TIMESTAMP_NTZ '2024-01-01' AS t0, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, s) AS t1 FROM VALUES ('a', 7299), ('b', 7300), ('c', 129600) AS v(w, s)")
    found = regions.timed_regions(change, windows, ["project_id", "window_id"], (0.2, 0.4, 1.0), 1)
    assert {r.window_id for r in found.collect()} == {"a", "b"}
    assert regions.timed_regions(change, windows, ["project_id", "window_id"], regions.depth_levels()).count() == 0  # under 1000 pixels


def test_density_adds_up_to_its_events(spark):
    e = spark.createDataFrame([("w", 1.0, 1.0, 1.0), ("w", 1.0, 1.0, 1.0), ("w", 4.0, 2.0, 2.0)], "window_id string, X double, Y double, radius double")
    grid = spark.range(36).select(F.floor(F.col("id") / 6).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"))
    assert events.density_grid(e, grid, ["window_id"]).agg(F.sum("z")).first()[0] * PARAMS.area == pytest.approx(3)
    points = e.withColumn("radius", F.lit(0.0))  # no radius: all at the nearest cells
    z = {(r.y, r.x): r.z * PARAMS.area for r in events.density_grid(points, grid, ["window_id"]).collect()}
    assert z[1, 1] == pytest.approx(2, rel=0.01) and z[2, 4] == pytest.approx(1, rel=0.01)
    windows = spark.createDataFrame([("w",), ("none",)], "window_id string")
    rows = events.density_grid(e, grid, ["window_id"], windows=windows)
    assert rows.count() == 72 and rows.where("window_id = 'none'").agg(F.max("z")).first()[0] == 0


def test_polygon_edges(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    p = spark.createDataFrame([(2.0, 2.0), (0.0, 2.0), (4.0, 4.0), (5.0, 2.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    assert [r[0] for r in p.select(expr.in_polygon(x, y, square)).collect()] == [True, False, False, False]
    assert [r[0] for r in p.select(expr.in_polygon(x, y, square, True)).collect()] == [True, True, True, False]
    shape = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in square])
    assert p.select(expr.in_polygon_array(x, y, shape)).first()[0]


def test_tracker_follows_crossing_boxes_and_forgets(spark):
    rows = []
    for f in range(30):
        if 10 <= f < 14:
            continue  # a gap the tracker bridges
        rows.append(("v", f, 10.0 + 5 * f, 10.0, 40.0 + 5 * f, 40.0, 0.9, 0.0))
        rows.append(("v", f, 300.0 - 5 * f, 60.0, 330.0 - 5 * f, 90.0, 0.8, 1.0))
    d = spark.createDataFrame(rows, "base_name string, frame int, x1 double, y1 double, x2 double, y2 double, score double, class_id double")
    t = tracks.track_objects(d).toPandas()
    assert set(t.track_id) == {0, 1} and (t.groupby("track_id").class_id.nunique() == 1).all()


def test_assignment_is_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2), (5, 5)):
        cost = rng.normal(size=(n, m))
        pairs = tracks.assign(cost)
        assert len(pairs) == min(n, m)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(max(n, m)), min(n, m)))
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_association_is_strict_and_breaks_ties(spark):
    e = spark.createDataFrame([(1, "v", 1.0, 5.0, 5.0, "Yes"), (2, "v", 50.0, 5.0, 5.0, "Yes"), (3, "v", 1.0, 5.0, 5.0, "No")], "LID long, VideoID string, t double, X double, Y double, ClipCreated string")
    p = spark.createDataFrame([("v", 9, 29, 5.0, 6.0), ("v", 4, 29, 6.0, 5.0), ("v", 1, 15, 5.0, 5.5), ("v", 2, 14, 5.0, 5.0), ("w", 3, 29, 5.0, 5.0)], "base_name string, track_id long, frame int, xc double, yc double")
    rows = {r.LID: (r.track_id, r.frame) for r in tracks.associate(e, p).collect()}
    assert rows == {1: (1, 15), 2: (None, None)}


def test_catalog(spark):
    s = spark.createDataFrame([("a", None, "true", "TRUE", "False"), ("b", "False", "TRUE", "TRUE", "FALSE"), ("c", "TRUE", "TRUE", "false", None)], "projectID string, RunAnalysis string, StartingFiles string, Prep string, Depth string")
    assert [tuple(r) for r in catalog.eligible(s, ["Depth", "Prep"]).orderBy("projectID").collect()] == [("a", "Depth"), ("c", "Prep")]
    u = spark.createDataFrame([("a", "TRUE")], "projectID string, value string")
    assert catalog.upsert(s, u, "projectID", "Depth").where("projectID = 'a'").first().Depth == "TRUE"
    assert catalog.fill_defaults(s, ["RunAnalysis", "New"]).first().New == "FALSE"
    c = spark.createDataFrame([("mp4_a",), ("b",)], "ClipName string")
    p = spark.createDataFrame([("mp4_a.mp4", "c", 0.9)], "VideoFile string, Prediction string, Confidence double")
    assert {r.ClipName: r.Prediction for r in catalog.classify_merge(c, p, "m").collect()} == {"mp4_a": "c", "b": None}


def test_boundary_events_are_in_both_windows(spark):
    e = spark.sql("SELECT 'P' AS project_id, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS TimeStamp, 'c' AS Prediction")
    ref = spark.sql("SELECT 'P' AS pid, TIMESTAMP_NTZ '2024-01-01 10:25:00' AS dissection_time")
    rows = reports.cluster_detail(e, reports.steps_before(ref), {"scoop": ["c"], "spit": ["p"]})
    assert rows.count() == 18 and rows.where("n > 0").count() == 2


def test_events_are_their_video_and_number(spark):
    e = spark.createDataFrame([(1, "v", 1.0, 5.0, 5.0, "Yes"), (1, "w", 1.0, 5.0, 5.0, "Yes")], "LID long, VideoID string, t double, X double, Y double, ClipCreated string")
    p = spark.createDataFrame([("v", 9, 29, 5.0, 6.0)], "base_name string, track_id long, frame int, xc double, yc double")
    assert {(r.VideoID, r.track_id) for r in tracks.associate(e, p).collect()} == {("v", 9), ("w", None)}


def test_boxes_of_two_tables(spark):
    box = "base_name string, frame int, box_id long, x1 double, y1 double, x2 double, y2 double"
    a, b = spark.createDataFrame([("v", 1, 5, 250.0, 250.0, 270.0, 270.0)], box), spark.createDataFrame([("v", 1, 1, 250.0, 250.0, 270.0, 270.0), ("v", 1, 2, 260.0, 260.0, 600.0, 600.0), ("v", 2, 3, 250.0, 250.0, 270.0, 270.0)], box)
    assert {(r.a_id, r.b_id) for r in tracks.iou_pairs(a, b).collect()} == {(5, 1), (5, 2)}
    assert {(r.a_id, r.b_id) for r in tracks.iou_pairs(b).collect()} == {(1, 2)}


def test_candidates_by_hand(spark):
    """At 40 only a and b qualify together (c is shorter), at 30 c shares its frames with them too."""
    rows = [("v", t, f) for t, n in (("a", 60), ("b", 55), ("c", 35), ("d", 80)) for f in range(n)]
    rows = [(v, ord(t), f + 1000 * (t == "d")) for v, t, f in rows]
    points = spark.createDataFrame(rows, "base_name string, track_id long, frame int").selectExpr("*", "1D AS p_value", "0D AS class_id", "true AS in_bounds")
    long_ = tracks.with_length(points)
    summary = tracks.track_summary(points)
    pick = lambda want: {(chr(r.track_id), r.min_length) for r in tracks.video_candidates(long_, summary, want, 50, 10, 20, 0.75, 4).collect()}
    assert pick(2) == {("a", 50), ("b", 50)}
    assert pick(3) == {("a", 30), ("b", 30), ("c", 30)} and pick(9) == {("a", 20), ("b", 20), ("c", 20)}


def test_tracker_skips_long_gaps(spark):
    box = lambda f: ("v", f, 10.0, 10.0, 40.0, 40.0, 0.9, 0.0)
    d = pd.DataFrame([box(f) for f in (0, 1, 2, 300_000_000)], columns=["base_name", "frame", "x1", "y1", "x2", "y2", "score", "class_id"])
    assert set(tracks.run_video(d).track_id) == {0}  # after the gap a new track needs hits before it shows


def test_night_without_light_flag(spark):
    c = _cube(spark, {(0, 0): [1, 2, 3, 4]}).withColumn("lof", F.when(F.col("frame_idx") == 1, True))
    assert _series(depth.night_fill(c)) == [2, 2, 2, 2]
    assert depth.night_fill(c.withColumn("lof", F.lit(None).cast("boolean"))).count() == 4
    times = spark.sql("SELECT 'P' AS project_id, CAST(NULL AS TIMESTAMP_NTZ) AS t")
    assert depth.asof_frames(depth.frame_times(c), times).first().frame_idx is None


def test_repeated_keys(spark):
    df = spark.createDataFrame([("a=1:b=2:a=3,c",)], "v string")
    assert df.select(expr.key_values(F.col("v"))).first()[0] == {"a": "3", "b": "2", "c": None}
    line = spark.createDataFrame([("P", "Odd: Time: 1,,Time: 2020-02-12 08:00:00,,K=x")], "project_id string, value string")
    r = logs.other_records(line).first()
    assert str(r.time) == "2020-02-12 08:00:00" and r.fields == {"Time": "2020-02-12 08:00:00", "K": "x"}
    job = spark.createDataFrame([("f", "Resources: a=1:a=2,b"), ("f", "Job name: n")], "file string, value string")
    r = logs.job_logs(job).first()
    assert (r.a, r.b, r.job_name) == ("2", "Y", "n")
    states = spark.createDataFrame([("a", "F")], "projectID string, Depth string")
    two = spark.createDataFrame([("a", "FALSE"), ("a", "TRUE")], "projectID string, value string")
    assert [tuple(r) for r in catalog.upsert(states, two, "projectID", "Depth").collect()] == [("a", "TRUE")]
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x"), (None, "z")], "projectID string, Depth string")
    assert {tuple(r) for r in catalog.insert_absent(states, new, "projectID").collect()} == {("a", "F"), ("b", "x")}


def test_geometry_files(spark, tmp_path):
    (tmp_path / "P1").mkdir()
    (tmp_path / "P1" / "crop.txt").write_text("1,2\n3.5,4\n\n5,6\n")
    (tmp_path / "P1" / "tray.txt").write_text("9,1,2,8\nnote\n")
    np.save(tmp_path / "P1" / "m.npy", np.arange(9.0).reshape(3, 3))
    assert [tuple(v) for v in files.read_polygon(spark, str(tmp_path / "P1" / "crop.txt")).first().vertices] == [(1, 2), (3.5, 4), (5, 6)]
    assert files.read_tray(spark, str(tmp_path / "P1" / "tray.txt")).first().tray == [2, 1, 9, 8]
    assert files.read_matrix(spark, str(tmp_path / "P1")).first().m == list(range(9))


def test_smooth_depth_runs_whole(spark):
    rng = np.random.default_rng(2)
    day = lambda i: f"2024-01-0{1 + i // 24}"
    lof = lambda i: 8 <= i % 24 <= 17
    c = _cube(spark, {(y, x): 50 + rng.normal(0, 0.1, 72) for y in range(2) for x in range(2)}, lof, day)
    assert depth.smooth_depth(c).where("depth IS NULL").count() == 0


def _stream(spark, rows, path, cuts):
    """The rows as a stream, a file and micro-batch for each share."""
    pdf = rows.toPandas()
    for k, part in enumerate(np.array_split(pdf, cuts)):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if not f.name.startswith("n"):
                f.rename(path / f"n{k}-{f.name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_of_repeats_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, id % 3 AS user_id, TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, cast(id + 6 * (id % 2) AS int)) AS ts, cast(id DIV 6 * 10 AS double) AS value FROM range(60)")
    got = jobs.run_once(jobs.repeats(_stream(spark, rows, tmp_path / "in", 4)), spark, "append", "t").toPandas()
    pdf = rows.toPandas().sort_values(["user_id", "ts", "event_id"])
    pdf["gp"] = (pdf.value // 10).astype(int)
    pdf = pdf[(pdf.gp == pdf.groupby("user_id").gp.shift(1)) & (pdf.ts <= pdf.ts.max() - pd.Timedelta(minutes=10))]
    assert set(got.event_id) == set(pdf.event_id) and len(got) == len(pdf)


def test_stream_of_tracks_equals_batch(spark, tmp_path):
    rows = []
    for f in range(60):
        if not 20 <= f < 23 and not 40 <= f < 48:  # gaps that the tracker bridges, and not
            rows.append(("v", f, 10.0 + 5 * f, 10.0, 40.0 + 5 * f, 40.0, 0.9, 0.0))
        rows.append(("w", f, 300.0 - 5 * f, 60.0, 330.0 - 5 * f, 90.0, 0.8, 1.0))
    rows[30], rows[38] = rows[38], rows[30]  # late rows
    boxes = spark.createDataFrame(rows, "base_name string, frame int, x1 double, y1 double, x2 double, y2 double, score double, class_id double")
    boxes = boxes.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame") * 60))
    got = jobs.run_once(jobs.online_tracks(_stream(spark, boxes, tmp_path / "in", 5)), spark, "append", "t").toPandas()
    want = tracks.track_objects(boxes).toPandas()
    want = want[want.frame <= 59 - 10]
    order = ["base_name", "frame", "track_id"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


def test_live_monitor_remembers_earlier_batches(spark, tmp_path):
    c = _cube(spark, {(y, x): [50.0, 50.0, 50.0 - 2 * (y < 2)] for y in range(4) for x in range(4)})
    c = c.orderBy("frame_idx")
    stream = _stream(spark, c, tmp_path / "in", 3)
    jobs.live_monitor(stream, str(tmp_path / "out"), str(tmp_path / "log"), 1.0, 4).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "regions")).where("batch = 2 AND window_id = 'last 2 h'").collect()
    assert len(rows) == 8 and {(r.label, r["size"]) for r in rows} == {(-1, 8)}
    state = sorted(p.name for p in (tmp_path / "log-state").iterdir())
    assert state == ["v1", "v2"]  # versions before the last two are gone


def test_live_state_does_not_grow(spark, tmp_path):
    """Frames of three days, one at a time: the state holds the last two hours and two days, and each window's last view is that of
    all frames.
    """
    when = "TIMESTAMP_NTZ '2024-01-01 09:00:00' + make_dt_interval(frame_idx DIV 5, frame_idx % 5 + IF(frame_idx % 5 = 4, 8, 0))"  # the fifth by night
    c = _cube(spark, {(y, x): [50.0 - i % 5 * (y + x) - i for i in range(15)] for y in range(2) for x in range(2)}).withColumns({"ts": F.expr(when), "std": F.lit(0.000001)}).drop("lof", "day")
    jobs.live_monitor(_stream(spark, c.orderBy("frame_idx"), tmp_path / "in", 15), str(tmp_path / "out"), str(tmp_path / "log"), (1.0, 2.0), 1, (2,)).awaitTermination()
    state = spark.read.parquet(str(tmp_path / "log-state" / "v14"))
    slots = {r.kind: r.n for r in state.groupBy("kind").agg(F.count_distinct("slot").alias("n")).collect()}
    assert slots == {"frame": 1, "day": 2, "first": 1}  # no other frame within two hours of the last one
    changes = spark.read.parquet(str(tmp_path / "out" / "changes"))
    last = changes.groupBy("window_id").agg(F.max(F.struct("batch", "absolute", "summed")).alias("m")).collect()
    got = {r.window_id: (r.m.absolute, r.m.summed) for r in last}
    want = {r.window_id: (r.a, r.s) for r in jobs.live_views(jobs._held(c), (2,)).groupBy("window_id").agg(F.sum(F.abs("change")).alias("a"), F.sum("change").alias("s")).collect()}
    assert got == want and set(got) == {"last 2 h", "trial", *(f"day 2024-01-0{k}" for k in (1, 2, 3)), *(f"night 2024-01-0{k}" for k in (2, 3))}
    (status,) = spark.read.parquet(str(tmp_path / "out" / "status")).where("batch = 14").collect()
    assert (status.gp, status.stuck, status.silent) == (4, True, False)
    assert spark.read.parquet(str(tmp_path / "log-frames" / "v14")).count() == 2


def test_status_by_hand(spark):
    f = spark.sql("SELECT p AS project_id, TIMESTAMP_NTZ '2024-01-01 10:00:00' + make_dt_interval(0, 0, m) AS ts, gp, s AS std FROM VALUES ('a', 0, 5L, 0.0D), ('a', 5, 5L, 0.0D), ('b', 0, 5L, 0.0D), ('b', 5, 6L, 0.0D), ('c', 16, 1L, 0.0D), ('d', 0, 5L, 1.0D), ('d', 16, 5L, 0.5D), ('e', 1, 3L, NULL) AS v(p, m, gp, s)")
    assert {r.project_id: (r.stuck, r.silent) for r in jobs.live_status(f).collect()} == {"a": (True, False), "b": (False, False), "c": (False, False), "d": (False, False), "e": (False, False)}
    assert {r.project_id for r in jobs.live_status(f, 12).where("silent").collect()} == {"e"}


def test_captures_as_stream_and_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("P", t, 0, x, int(rng.integers(1, 9)) if rng.random() > 0.2 else -1) for t in range(0, 3600, 10) for x in range(3)]
    s = spark.createDataFrame(rows, "project_id string, t int, y int, x int, raw long").select("project_id", F.timestamp_seconds(F.lit(1_700_000_400) + F.col("t")).alias("ts"), "y", "x", "raw")
    good = lambda df: df.withColumn("raw", F.nullif("raw", F.lit(-1)))
    stream, s = good(_stream(spark, s, tmp_path / "in", 4)), good(s)
    batch = depth.cell_medians(s, ["project_id", F.window("ts", "5 minutes").alias("w"), "y", "x"])
    old = depth.trimmed_median(s.withColumn("w", F.window("ts", "5 minutes")), ["project_id", "w", "y", "x"])
    key = lambda df: sorted((str(r.w), r.x, r["median"], round(r["std"], 9), r.n_good, r.n_bad, r.n_kept) for r in df.collect())
    assert key(batch) == key(old) and len(key(old)) == 36
    want = depth.frame_statistics(batch, ["project_id", "w"], 40).where("w.end <= timestamp_seconds(1700000400 + 3590 - 600)")
    got = jobs.run_once(jobs.captures(stream, due=40), spark, "append", "t")
    flat = lambda df: sorted((str(r.w), round(r.avg_med, 9), round(r.avg_std, 9), r.gp, r.pixels_good, r.pixels_bad) for r in df.collect())
    assert flat(got) == flat(want) and len(flat(got)) == 9


def test_trimming_by_hand(spark):
    v = spark.createDataFrame([([1, 1, 2, 3, 3, 3, 3, 9],), ([1, 1, 1, 1, 5],), ([2],), ([],)], "v array<long>")
    got = [(r.s["median"], r.s.kept) for r in v.select(depth.trimmed(F.col("v")).alias("s")).collect()]
    assert got == [(3.0, 5), (1.0, 5), (None, 0), (None, 0)]


def test_recordings_as_streams(spark, tmp_path):
    at = lambda h: f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {h} HOURS"
    starts = spark.sql(f"SELECT 'P' AS project_id, f AS h264_file, t AS start_time FROM VALUES ('a', {at(1)}), ('b', {at(2)}), ('c', {at(3)}), ('z', {at(90)}) AS v(f, t)")
    stops = spark.sql(f"SELECT 'P' AS project_id, f AS h264_file, t AS stop_time FROM VALUES ('a', {at(5)}), ('a', {at(6)}), ('c', {at(40)}), ('z', {at(91)}), ('y', {at(92)}) AS v(f, t)")
    pairs = jobs.run_once(jobs.recordings(_stream(spark, starts, tmp_path / "a", 2), _stream(spark, stops, tmp_path / "b", 2)), spark, "append", "t")
    assert {(r.h264_file, r.stop_time.hour if r.stop_time else None) for r in pairs.collect()} >= {("a", 5), ("a", 6), ("b", None), ("z", 19)}
    frames = spark.sql(f"SELECT 'P' AS project_id, {at(95)} AS time")
    rows = {r.h264_file: (r.end_time.day, r.end_time.hour, r.open) for r in jobs.close_recordings(starts, pairs, frames).collect()}
    assert rows == {"a": (1, 6, False), "b": (4, 23, True), "c": (4, 23, True), "z": (4, 19, False)}


def test_stuck_sensor_needs_both_conditions(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, 1L AS user_id, TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, cast(id AS int)) AS ts, 7.0D AS value, IF(id % 3 = 0, 0.000001D, 0.5D) AS std FROM range(30)")
    got = jobs.run_once(jobs.repeats(_stream(spark, rows, tmp_path / "in", 3), std=F.col("std")), spark, "append", "t").toPandas()
    assert sorted(got.event_id) == [i for i in range(1, 20) if i % 3 == 0]


def test_stored_cube_needs_no_shuffle(spark, tmp_path):
    from reefline.sources import cubes

    c = _cube(spark, {(y, x): np.arange(80.0) * (y - x) for y in range(6) for x in range(6)}).withColumn("day", F.to_date("ts"))
    stored = cubes.write_cube(c, "test_cube", str(tmp_path / "cube"), 3, 2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for f in (depth.savgol, lambda x: depth.gap_interpolate(x), depth.savgol):
        assert sorted(f(stored).select("y", "x", "frame_idx", "depth").collect()) == sorted(f(c).select("y", "x", "frame_idx", "depth").collect())
    assert "Exchange" not in plan(depth.savgol(stored)) and "Exchange" in plan(depth.savgol(c))
    span = plan(depth.gap_interpolate(stored))
    cells_moved = [line for line in span.splitlines() if "Exchange hashpartitioning" in line and "tile_y" in line]
    assert not cells_moved
    windows = spark.sql("SELECT 'P' AS project_id, 'w' AS window_id, TIMESTAMP_NTZ '2024-01-01 08:00:00' AS t0, TIMESTAMP_NTZ '2024-01-01 12:00:00' AS t1")
    frames = c.select("project_id", "frame_idx", "ts").distinct()
    assert sorted(depth.height_change(stored, windows, frames=frames).collect()) == sorted(depth.height_change(c, windows).collect())
    spark.sql("DROP TABLE test_cube")


def test_cleaning_of_a_stored_cube_moves_no_cell(spark, tmp_path):
    import re

    from reefline.sources import cubes

    rng = np.random.default_rng(4)
    day = lambda i: f"2024-01-0{1 + i // 24}"
    lof = lambda i: 8 <= i % 24 <= 17
    c = _cube(spark, {(y, x): [None if rng.random() < 0.02 else 50 + v for v in rng.normal(0, 0.1, 72)] for y in range(5) for x in range(5)}, lof, day)
    stored = cubes.write_cube(c, "clean_cube", str(tmp_path / "cube"), 3, 2)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    cubes.join_in_place(spark)
    try:
        out = depth.smooth_depth(stored)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"Exchange hashpartitioning\([^)]*\by#", plan)
        key = lambda df: sorted((r.frame_idx, r.y, r.x, None if r.depth is None else round(r.depth, 9)) for r in df.collect())
        got = key(out)
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
    assert repr(got) == repr(key(depth.smooth_depth(c))) and len(got) == 25 * 72
    spark.sql("DROP TABLE clean_cube")


def test_versions_survive_failed_jobs(spark, tmp_path):
    from reefline.sources import versions

    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.publish(spark.range(3), root, 0) == 1
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        versions.update(spark, root, lambda t: t.union(broken))
    assert versions.read(spark, root).count() == 3 and versions.current(spark, root)[0] == 1
    assert versions.update(spark, root, lambda t: t.union(spark.range(2))).count() == 5
    with pytest.raises(versions.Outdated):
        versions.publish(spark.range(1), root, 1)  # another job was first
    assert versions.read(spark, root).count() == 5
    versions.update(spark, root, lambda t: t)
    versions.forget(spark, root, 1)
    assert versions.read(spark, root).count() == 5 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1


def test_tracker_streams_long_videos(spark):
    """Tiny batches, frames cut between them: the same tracks, and as little held."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [(v, f, k * 90.0 + f % 50 + rng.random(), 10.0, k * 90.0 + f % 50 + 30, 40.0, 0.9, float(k)) for v in "vw" for f in range(200) for k in range(3) if rng.random() > 0.1]
    pdf = pd.DataFrame(rows, columns=tracks._BOXES).sort_values(["base_name", "frame", "x1", "y1", "x2", "y2"])
    whole = pd.concat([tracks.run_video(g) for _, g in pdf.groupby("base_name")], ignore_index=True)
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    cut = pd.concat([b.to_pandas() for b in tracks._tracks(iter(table.to_batches(max_chunksize=7)))], ignore_index=True)
    pd.testing.assert_frame_equal(cut, whole)
    got = tracks.track_objects(spark.createDataFrame(pdf)).toPandas().sort_values(["base_name", "frame", "track_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, whole.sort_values(["base_name", "frame", "track_id"]).reset_index(drop=True), check_dtype=False)


def test_large_boxes_have_few_cells(spark):
    box = "base_name string, frame int, box_id long, x1 double, y1 double, x2 double, y2 double"
    b = spark.createDataFrame([("v", 1, 1, 0.0, 0.0, 1e7, 1e7), ("v", 1, 2, 5e6, 5e6, 2e7, 2e7), ("v", 1, 3, 9e6, 9e6, 9.1e6, 9.1e6), ("v", 2, 4, 0.0, 0.0, 9.0, 9.0), ("v", 2, 5, 1.0, 1.0, 8.0, 8.0)], box)
    assert {(r.a_id, r.b_id) for r in tracks.iou_pairs(b).collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_agreement_of_depth_and_density_by_hand(spark):
    """Raised sand on two columns, spits on one of them: half of the cells agree; without either the windows agree."""
    cells = [("P", f, y, x, 50.0 - 2.0 * (f == 1 and x < 2)) for f in (0, 1) for y in range(4) for x in range(6)]
    c = spark.createDataFrame(cells, "project_id string, frame_idx int, y int, x int, depth double").withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, frame_idx * 20)"))
    e = spark.createDataFrame([("P", "p", 0.0, float(y), 0.0) for y in range(4) for _ in range(3)], "project_id string, Prediction string, X double, Y double, radius double").withColumn("TimeStamp", F.expr("TIMESTAMP_NTZ '2024-01-01 05:00:00'"))
    grid = c.select("y", "x").distinct()
    frames = c.select("project_id", "frame_idx", "ts").distinct()
    windows = reports.trial_windows(frames).unionByName(spark.sql("SELECT 'P' AS project_id, 'none' AS window_id, TIMESTAMP_NTZ '2024-01-03' AS t0, TIMESTAMP_NTZ '2024-01-04' AS t1"))
    rows = {r.window_id: r for r in reports.region_consistency(c, e, windows, grid, 2, (0.5, 1.0, 1.5), (50.0, 100.0, 150.0), frames).collect()}
    assert set(rows) == {"2024-01-01", "trial", "none"}
    assert (rows["trial"].n_depth, rows["trial"].n_density, rows["trial"].n_same, rows["trial"].agreement) == (8, 4, 4, 0.5)
    assert (rows["none"].n_depth, rows["none"].n_density, rows["none"].agreement) == (0, 0, 1.0)
    apart = reports.region_consistency(c, e.withColumn("X", F.lit(5.0)), windows, grid, 2, (0.5, 1.0, 1.5), (50.0, 100.0, 150.0), frames)
    assert apart.where("window_id = 'trial'").first().agreement == 0.0


def test_density_against_brute_force(spark):
    """A camera's grid, places that are no whole numbers: under 1e-9 of the sum over all events, rows bounded by the radius."""
    rng = np.random.default_rng(8)
    n, h, w = 2000, 96, 128
    px, py = rng.random(n) * w, rng.random(n) * h
    e = spark.createDataFrame(pd.DataFrame({"k": "a", "X": px, "Y": py, "radius": 4.0}))
    grid = spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    z = np.zeros((h, w))
    for r in events.density_cells(e, grid, ["k"]).collect():
        z[r.y, r.x] = r.z
    ky, kx = (np.exp(-0.5 * ((np.arange(m)[None] - at[:, None]) / 2.0) ** 2) for m, at in ((h, py), (w, px)))
    want = ky.T @ kx
    want *= n / (want.sum() * PARAMS.area)
    assert np.abs(z - want).max() < 1e-9


def test_array_source(spark, tmp_path):
    """Bands of a large grid, small files together, column order, and files that come as a stream."""
    from reefline.sources import arrays

    arrays.register(spark)
    grids = {"a": np.arange(600.0).reshape(60, 10), "b": np.asfortranarray(np.arange(12.0).reshape(3, 4)), "c": np.array([[np.nan, 2.0]]), "d": np.zeros((0, 3)), "e": np.arange(4, dtype=np.int16).reshape(2, 2)}
    folder = tmp_path / "in"
    folder.mkdir()
    for k in "ab":
        np.save(folder / f"{k}.npy", grids[k])
    key = lambda rows: sorted((r.file.rsplit("/", 1)[1][0], r.y, r.x, r.value) for r in rows)
    want = lambda names: sorted((k, int(y), int(x), None if np.isnan(grids[k][y, x]) else float(grids[k][y, x])) for k in names for y, x in np.ndindex(grids[k].shape))
    load = lambda: spark.read.format("npy").option("band_bytes", "1000").load(str(folder))
    assert key(load().collect()) == want("ab") and load().rdd.getNumPartitions() == 6  # five bands of twelve rows, one batch
    stream = spark.readStream.format("npy").option("band_bytes", "1000").load(str(folder))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    run()
    assert key(spark.read.parquet(out).collect()) == want("ab")
    for k in "cde":
        np.save(folder / f"{k}.npy", grids[k])
    run()
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want("abcde")) and key([r for r in got if r.value is not None]) == sorted([*want("abe"), ("c", 0, 1, 2.0)])
    assert files.read_arrays(spark, str(folder)).count() == len(want("abcde"))
    np.save(folder / "o.npy", np.array([[{}]]), allow_pickle=True)
    with pytest.raises(Exception, match="grid of numbers"):
        load().collect()
