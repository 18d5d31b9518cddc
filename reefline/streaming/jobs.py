"""Streaming forms of the live loops: windows of samples, sliding change, sessions, duplicate and
staleness alerts, deduplication and online tracking.

Late rows: a watermark of ten minutes. Jobs that need the order of rows (``in_order``) hold a key's rows back
until the watermark has passed them, so that late rows take their place and a micro-batch's bounds don't
matter; a key without rows for a day of event time is forgotten.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reefline import shared
from reefline.operators import depth, regions
from reefline.operators.tracks import TRACKED, Trackers, tracked

LATE = "10 minutes"


def stale(heartbeats: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Running machines whose last ping is older than ``minutes``."""
    return heartbeats.where((F.col("Status") == "Running") & (now - F.col("Ping") > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as they are appended, file by file, ready for the batch projections."""
    return spark.readStream.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("project_id"), F.rtrim("value").alias("value"))


def tumbling(events: DataFrame, size: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Averaged capture windows by project."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def captures(samples: DataFrame, size: str = "5 minutes", late: str = LATE, due: int | None = None) -> DataFrame:
    """What is captured of each window of depth samples (project_id, ts, y, x, raw) once the watermark has passed it: the
    trimmed median and deviation by cell, and of these the statistics of the frame, one row for each project and window.

    Two aggregations in a row: a cell's state is its window's samples, a frame's the sums over its cells. Both are the
    batch's own functions. ``due``: samples that a cell should have.
    """
    cells = depth.cell_medians(samples.withWatermark("ts", late), ["project_id", F.window("ts", size).alias("w"), "y", "x"])
    return depth.frame_statistics(cells, ["project_id", "w"], due)


def recordings(starts: DataFrame, stops: DataFrame, most: str = "1 day", late: str = LATE) -> DataFrame:
    """Starts (project_id, h264_file, start_time) with the stops (project_id, h264_file, stop_time) of the same file up to ``most``
    later, as both streams come in; a start without one is given with a null stop once both watermarks have passed that time.
    """
    a = starts.withWatermark("start_time", late)
    b = stops.select(F.col("project_id").alias("_p"), F.col("h264_file").alias("_f"), "stop_time").withWatermark("stop_time", late)
    same = (F.col("project_id") == F.col("_p")) & (F.col("h264_file") == F.col("_f"))
    near = (F.col("stop_time") >= F.col("start_time")) & (F.col("stop_time") <= F.col("start_time") + F.expr(f"INTERVAL {most}"))
    return a.join(b, same & near, "leftOuter").drop("_p", "_f")


def close_recordings(starts: DataFrame, pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Every start with its end: the last stop paired with it so far, else the project's last frame (project_id, time)."""
    keys = ["project_id", "h264_file", "start_time"]
    ends = pairs.where("stop_time IS NOT NULL").groupBy(*keys).agg(F.max("stop_time").alias("_stop"))
    last = frames.groupBy("project_id").agg(F.max("time").alias("_last"))
    rows = starts.join(ends, keys, "left").join(last, "project_id", "left")
    return rows.select(*starts.columns, F.coalesce("_stop", "_last").alias("end_time"), F.col("_stop").isNull().alias("open"))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Change from the first to the last value of sliding windows."""
    ends = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", size, step).alias("w")).agg(F.min(F.struct("ts", "value")).alias("a"), F.max(F.struct("ts", "value")).alias("b"), F.count("*").alias("n"))
    return ends.select("user_id", "w", "n", (F.col("b.value") - F.col("a.value")).alias("change"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daylight(events: DataFrame) -> DataFrame:
    return events.where(depth.lights_on(F.col("ts")))


#: Milliseconds of event time after which a silent key is forgotten.
FORGET = 86_400_000
#: Groups of keys that share a state and are worked on together.
GROUPS = 512


def in_order(rows: DataFrame, key: str, made: str, start: Callable[[], object], step: Callable[[pd.DataFrame, object], pd.DataFrame], late: str = LATE) -> DataFrame:
    """What ``step(rows, state)`` makes (a DDL ``made``) of each key's rows in order of ``ts``, then the other columns,
    once the watermark has passed them. Keys come together, in groups by hash: rows are sorted by key first. ``start``
    gives a group's first state, which ``step`` changes and whose ``pop(key, None)`` forgets a key.
    """
    names = [c for c in rows.columns if c != key]
    source = rows.withWatermark("ts", late).select("*", F.unix_millis("ts").alias("_ms"), F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"))
    empty = [c.split()[0] for c in made.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen, own = pickle.loads(state.get[0]) if state.exists else (None, {}, start())
        parts = [b[[key, *names, "_ms"]] for b in batches if len(b)]
        mark = state.getCurrentWatermarkMs()
        for b in parts:
            for who, ms in b.groupby(key, dropna=False)["_ms"].max().items():
                seen[who] = max(ms, seen.get(who, ms))
        both = pd.concat([x for x in (held, *parts) if x is not None]) if parts or held is not None else None
        out = pd.DataFrame(columns=empty)
        wait = None
        if both is not None:
            due, wait = both[both["_ms"] <= mark], both[both["_ms"] > mark]
            if len(due):
                out = step(due.sort_values([key, "ts", *[c for c in names if c != "ts"]]).reset_index(drop=True), own)
            wait = wait if len(wait) else None
        for who in [who for who, ms in seen.items() if ms + FORGET <= mark]:
            del seen[who]
            own.pop(who, None)
        if seen:
            state.update((pickle.dumps((wait, seen, own)),))
            state.setTimeoutTimestamp(int(min(seen.values()) + FORGET if wait is None else wait["_ms"].min()))
        elif state.exists:
            state.remove()
        yield out

    return source.groupBy("_group").applyInPandasWithState(run, made, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _repeats(rows: pd.DataFrame, last: dict) -> pd.DataFrame:
    first = (rows["user_id"] != rows["user_id"].shift(1)).to_numpy()
    before = rows["gp"].shift(1)
    before[first] = rows.loc[first, "user_id"].map(last)
    last.update(rows.groupby("user_id")["gp"].last())
    return rows.loc[(rows["gp"] == before) & (rows["std"] < STILL), ["user_id", "event_id", "gp"]]


#: Deviation of a frame under which its sensor stands still (fixed value).
STILL = 0.00001


def repeats(events: DataFrame, gp: Column | None = None, std: Column | None = None) -> DataFrame:
    """Alerts of a stuck sensor: frames with as many good pixels as the project's previous one and next to no deviation. The
    previous count is the project's state.
    """
    gp = F.floor(F.col("value") / 10) if gp is None else gp
    rows = events.select("user_id", "event_id", "ts", gp.cast("long").alias("gp"), (F.lit(0.0) if std is None else std).alias("std"))
    return in_order(rows, "user_id", "user_id long, event_id long, gp long", dict, _repeats)


def _follow(rows: pd.DataFrame, trackers: Trackers) -> pd.DataFrame:
    """Boxes of one moment lie in the order of the frame, then the corners, as ``track_objects`` sorts them."""
    rows = rows.sort_values(["base_name", "frame", "x1", "y1", "x2", "y2"])
    video, names = pd.factorize(rows["base_name"], use_na_sentinel=False)
    names = [None if pd.isna(n) else n for n in names]
    return tracked(trackers, names, video.astype("int64"), rows["frame"].to_numpy("int64"), rows[["x1", "y1", "x2", "y2", "score", "class_id"]].to_numpy(float)).to_pandas()


def online_tracks(detections: DataFrame) -> DataFrame:
    """Tracks of a stream of boxes (base_name, ts, frame, x1, y1, x2, y2, score, class_id), as ``track_objects``
    finds them in the whole: the trackers of a group of videos are its state, and frames without boxes are stepped.
    """
    rows = detections.select("base_name", "ts", "frame", "x1", "y1", "x2", "y2", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("class_id", F.lit(0.0)).alias("class_id"))
    return in_order(rows, "base_name", TRACKED, Trackers, _follow)


def run_once(stream: DataFrame, spark: SparkSession, mode: str, name: str) -> DataFrame:
    """All available input through a stream, result as a table in the shared folder (or in memory for
    modes that rewrite their result).
    """
    log = shared.place(spark, f"stream-{name}")
    if mode == "append":
        out = f"{log}-out"
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    table = f"{log}-out"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def _silent(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's timer is set to its last ping plus the limit; if it runs out, the key is reported."""
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "last_us": [last]})
        return
    last = max(int(b["us"].max()) for b in batches)
    last = max(last, state.get[0]) if state.exists else last
    state.update((last,))
    state.setTimeoutTimestamp(last // 1000 + 15 * 60_000)


def silence_alerts(events: DataFrame, late: str = LATE) -> DataFrame:
    """Keys without a ping for 15 minutes of event time, reported once the watermark has passed that."""
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_silent, "user_id long, last_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


_VIEW = ["project_id", "kind", "slot", "y", "x"]


def _slots(cells: DataFrame) -> DataFrame:
    """Each value of a cell as first and last value: by frame (``frame``), by day in its daylight (``day``), in all daylight (``first``)."""
    at, light = F.struct("ts", "depth"), depth.lights_on(F.col("ts"))
    slot = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.cast("timestamp_ntz").alias("slot"))
    kinds = F.array(slot("frame", F.col("ts")), F.when(light, slot("day", F.date_trunc("day", "ts"))), F.when(light, slot("first", F.timestamp_seconds(F.lit(0)))))
    rows = cells.select("project_id", "y", "x", at.alias("a"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.select("project_id", "k.kind", "k.slot", "y", "x", "a", F.col("a").alias("b"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_VIEW).agg(F.min("a").alias("a"), F.max("b").alias("b"))


def _held(cells: DataFrame) -> DataFrame:
    """Mergeable first and last values of each cell and slot."""
    return _merged(_slots(cells))


def live_views(state: DataFrame, hours: tuple[int, ...]) -> DataFrame:
    """``project_id, window_id, y, x, change`` of the live view: over each of the last ``hours``; over the daylight of each day held;
    from the last daylight of the day before to a day's first; and from the first daylight of all to the last frame.
    """
    frame, first = F.col("kind") == "frame", F.col("kind") == "first"
    last = state.where(frame).groupBy("project_id").agg(F.max("slot").alias("_last"))
    ends = lambda k, a, b: [F.min(F.when(a, F.col("a"))).alias(f"a{k}"), F.max(F.when(b, F.col("b"))).alias(f"b{k}")]
    view = lambda name, a, b: F.when(F.col(a).isNotNull(), F.struct(name.alias("window_id"), (F.col(f"{b}.depth") - F.col(f"{a}.depth")).alias("change")))
    given = lambda *views: F.explode(F.filter(F.array(*views), lambda v: v.isNotNull())).alias("v")
    near = {h: frame & (F.col("slot") > F.col("_last") - F.make_dt_interval(F.lit(0), F.lit(h))) for h in hours}

    rows = state.where(frame | first).join(last, "project_id", "left").groupBy("project_id", "y", "x")
    cells = rows.agg(*[e for h in hours for e in ends(h, near[h], near[h])], *ends("_trial", first, frame))
    recent = cells.select("project_id", "y", "x", given(*[view(F.lit(f"last {h} h"), f"a{h}", f"b{h}") for h in hours], view(F.lit("trial"), "a_trial", "b_trial")))
    name = lambda kind: F.concat(F.lit(f"{kind} "), F.date_format("slot", "yyyy-MM-dd"))
    days = state.where("kind = 'day'").withColumn("p", F.lag("b").over(W.partitionBy("project_id", "y", "x").orderBy("slot")))
    days = days.select("project_id", "y", "x", given(view(name("day"), "a", "b"), view(name("night"), "p", "a")))
    return recent.unionByName(days).select("project_id", "v.window_id", "y", "x", "v.change")


def live_status(frames: DataFrame, minutes: int = 15) -> DataFrame:
    """For each project its last frame, whether its sensor is stuck (as ``repeats`` has it) and whether it has been silent for more
    than ``minutes`` by the newest frame of all. ``frames``: project_id, ts, gp, std.
    """
    order = W.partitionBy("project_id").orderBy(F.desc("ts"))
    two = frames.select("project_id", "ts", "gp", "std", F.lead("gp").over(order).alias("_before"), F.row_number().over(order).alias("_k")).where("_k = 1")
    now = frames.agg(F.max("ts").alias("_now"))  # one row
    late = F.col("_now") - F.col("ts") > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    stuck = F.coalesce((F.col("std") < STILL) & (F.col("gp") == F.col("_before")), F.lit(False))
    return two.join(F.broadcast(now)).select("project_id", F.col("ts").alias("last_frame"), "gp", stuck.alias("stuck"), late.alias("silent"))


class _Versions:
    """A folder of numbered states, of which the last two are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path
        self.at, self.fs = at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def before(self, n: int) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.path))] if self.fs.exists(self.at(self.path)) else []
        return sorted(int(x[1:]) for x in names if int(x[1:]) < n and self.fs.exists(self.at(f"{self.path}/{x}/_SUCCESS")))

    def merged(self, rows: DataFrame, n: int) -> DataFrame:
        """The rows with those of the version before batch n."""
        done = self.before(n)
        return rows.unionByName(self.spark.read.schema(rows.schema).parquet(f"{self.path}/v{done[-1]}")) if done else rows

    def keep(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        for k in self.before(n)[:-1]:
            self.fs.delete(self.at(f"{self.path}/v{k}"), True)


def live_monitor(cells: DataFrame, out: str, checkpoint: str, th: float | tuple[float, float], min_pixels: int, hours: int | tuple[int, ...] = 2):
    """Starts the live view: after each batch of new frames (project_id, frame_idx, y, x, depth, ts and, if known, the frame's std)
    the changes of ``live_views``, whatever batch their frames came in, the regions in them (``out``/regions), their sums
    (``out``/changes) and the state of every project (``out``/status), by batch. ``th``: the regions' threshold, or one for
    hours and one for longer windows.

    The state lies beside ``checkpoint``: first and last values by frame for the last hours, by day for the last two days with
    daylight, and of the first daylight; each batch merges the version before and its own rows into a new one. Older slots
    are left out there, after the views were made, and versions before the last two are removed, so neither state nor
    what a batch reads grows with the run. Frames that come more than a day late are not seen. A batch that runs again
    writes the same version anew.
    """
    hours = (hours,) if isinstance(hours, int) else hours
    short, long = th if isinstance(th, tuple) else (th, th)
    root = checkpoint.rstrip("/")

    def update(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        std = F.max("std") if "std" in batch.columns else F.lit(None).cast("double")
        frames = _Versions(spark, f"{root}-frames")
        mine = shared.written(batch.groupBy("project_id", "ts").agg(F.count("depth").alias("gp"), std.alias("std")), "frames")
        seen = frames.merged(mine, n).groupBy("project_id", "ts").agg(F.max("gp").alias("gp"), F.max("std").alias("std"))
        seen = shared.written(seen.withColumn("_k", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("ts")))).where("_k <= 2").drop("_k"), "frames")
        frames.keep(seen, n)
        live_status(seen).write.mode("overwrite").parquet(f"{out}/status/batch={n}")

        store = _Versions(spark, f"{root}-state")
        state = shared.written(_merged(store.merged(_slots(batch), n)), "state")
        newest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("slot")))
        last = state.groupBy("project_id").agg(newest("frame").alias("_last"), newest("day").alias("_day"))
        fresh = F.when(F.col("kind") == "frame", F.col("slot") > F.col("_last") - F.make_dt_interval(F.lit(0), F.lit(max(hours)))).when(F.col("kind") == "day", F.col("slot") >= F.col("_day") - F.make_dt_interval(F.lit(1))).otherwise(True)
        store.keep(state.join(last, "project_id").where(fresh).select(*_VIEW, "a", "b"), n)

        names = mine.select("project_id").distinct()
        views = shared.written(live_views(state.join(names, "project_id", "left_semi"), hours), "views")
        keys = ["project_id", "window_id"]
        views.groupBy(*keys).agg(F.coalesce(F.sum(F.abs("change")), F.lit(0.0)).alias("absolute"), F.coalesce(F.sum("change"), F.lit(0.0)).alias("summed"), F.count("change").alias("n")).write.mode("overwrite").parquet(f"{out}/changes/batch={n}")
        level = F.when(F.col("window_id").startswith("last "), F.lit(short)).otherwise(F.lit(long))
        regions.bower_regions(views.withColumn("_th", level), keys, F.col("_th"), min_pixels, mode="abs").write.mode("overwrite").parquet(f"{out}/regions/batch={n}")

    return cells.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
