"""Project states: readiness, completeness of stages, updates; labels and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.expr import split_tag, truth
from reefline.shared import written
from reefline.sources import files, versions

#: Stage and the stages it needs, fixed values.
NEEDS = {"Prep": ["StartingFiles"], "Depth": ["StartingFiles", "Prep"], "Cluster": ["StartingFiles", "Prep"], "ClusterClassification": ["StartingFiles", "Prep", "Cluster"], "TrackFish": ["StartingFiles", "Prep"], "Summary": ["StartingFiles", "Prep", "Depth", "ClusterClassification"]}


def eligible(states: DataFrame, stages: list[str], ids: list[str] | None = None) -> DataFrame:
    """``projectID, stage`` of projects that may run a stage: analysis on, needs met, stage not done."""
    have = set(states.columns)
    rows = states if ids is None else states.where(F.col("projectID").isin(ids))
    wanted = []
    for stage in stages:
        ok = truth(F.coalesce("RunAnalysis", F.lit("TRUE")))
        for need in NEEDS[stage]:
            ok = ok & (truth(F.col(need)) if need in have else F.lit(False))
        done = truth(F.col(stage)) if stage in have else F.lit(False)
        wanted.append(F.when(ok & ~done, F.lit(stage)))
    return rows.select("projectID", F.explode(F.filter(F.array(*wanted), lambda s: s.isNotNull())).alias("stage"))


def fill_defaults(states: DataFrame, columns: list[str]) -> DataFrame:
    """Absent columns, and a null RunAnalysis, get their defaults."""
    out = states
    for c in columns:
        default = "TRUE" if c == "RunAnalysis" else "FALSE"
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default)) if c == "RunAnalysis" and c in out.columns else F.col(c) if c in out.columns else F.lit(default))
    return out


def stage_complete(required: DataFrame, listing: DataFrame) -> DataFrame:
    """``project_id, stage, complete``: whether every required file (dir, name) is listed."""
    there = listing.select("project_id", "dir", "name").distinct().withColumn("_there", F.lit(True))
    rows = required.join(there, ["project_id", "dir", "name"], "left")
    return rows.groupBy("project_id", "stage").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("complete"), F.count("*").alias("n_required"))


def upsert(states: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``updates`` (key, value) written over one column; of several updates of a key the largest value holds."""
    u = updates.groupBy(key).agg(F.max("value").alias("_value"))
    return states.join(u, key, "left").withColumn(column, F.coalesce("_value", column)).select(*states.columns)


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table and the rows whose key it lacks; of new rows with one key the least goes in, null keys never."""
    order = [c for c in rows.columns if c != key]
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_m")).select(key, "_m.*") if order else rows.where(F.col(key).isNotNull()).distinct()
    return table.unionByName(new.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def store_update(spark: SparkSession, root: str, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``upsert`` on a stored table: the new version is current once it is complete."""
    return versions.update(spark, root, lambda states: upsert(states, updates, key, column))


def store_insert(spark: SparkSession, root: str, rows: DataFrame, key: str) -> DataFrame:
    """``insert_absent`` on a stored table, which the first rows begin."""
    return versions.update(spark, root, lambda table: insert_absent(rows.limit(0) if table is None else table, rows, key))


def store_append(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """A stored master table with new rows; columns that one side lacks are null there."""
    return versions.update(spark, root, lambda table: rows if table is None else files.append_merge(table, rows))


def first_last_images(movies: DataFrame, frames: DataFrame) -> DataFrame:
    """For each project the picture of its first movie that starts from 8:00 to 20:59 and of its last movie, and the
    first and last frames by daylight after that first movie began.
    """
    hour = F.hour("start_time")
    first = movies.groupBy("project_id").agg(F.min(F.when(hour.between(8, 20), F.struct("start_time", "pic_file"))).alias("m"), F.max(F.struct("start_time", "pic_file")).alias("l")).where("m IS NOT NULL")
    day = frames.where(F.hour("time").between(8, 17)).join(first, "project_id").where(F.col("time") > F.col("m.start_time"))
    ends = day.groupBy("project_id").agg(F.min(F.struct("time", "npy_file", "pic_file")).alias("a"), F.max(F.struct("time", "npy_file", "pic_file")).alias("b"))
    rows = first.join(ends, "project_id", "left")
    return rows.select("project_id", F.col("m.pic_file").alias("first_picture"), F.col("l.pic_file").alias("last_picture"), F.col("a.npy_file").alias("first_depth"), F.col("b.npy_file").alias("last_depth"))


def project_ids(*tables: DataFrame) -> DataFrame:
    """The different project ids of all tables."""
    out = tables[0].select("project_id")
    for t in tables[1:]:
        out = out.union(t.select("project_id"))
    return out.distinct()


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows with their ``place`` in an order by digest: the same each time. The place is a column, since a frame's order
    is lost at the next shuffle.
    """
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return numbered(rows.withColumn("_o", order), ["_o", key]).drop("_o").withColumnRenamed("number", "place")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their ``number`` in this order, from 0. Rows are dealt by range and written; only each part's count
    reaches the driver.
    """
    held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, so_far = [], 0
    for r in counts:
        before.append((r["_part"], so_far))
        so_far += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + inside).alias("number"))


def project_state(states: DataFrame, stages: list[str], required: DataFrame, listing: DataFrame) -> DataFrame:
    """The state table with defaults filled, each stage whose required files are all listed set to TRUE, and the
    stages that each project may run next.
    """
    done = stage_complete(required, listing).where("complete")
    out = fill_defaults(states, ["RunAnalysis", *stages])
    for s in stages:
        out = upsert(out, done.where(F.col("stage") == s).select(F.col("project_id").alias("projectID"), F.lit("TRUE").alias("value")), "projectID", s)
    ready = eligible(out, [s for s in stages if s in NEEDS]).groupBy("projectID").agg(F.array_sort(F.collect_list("stage")).alias("next_stages"))  # a row for each stage at most
    return out.join(ready, "projectID", "left").withColumn("next_stages", F.coalesce("next_stages", F.array().cast("array<string>")))


def annotation_dataset(batches: list[DataFrame], manifest: DataFrame, ranges: DataFrame, one_in: int = 10) -> DataFrame:
    """All annotators' shapes in one table: the ranges of each, frames' names, boxes from 0 to 1, and a split by frame."""
    shapes = batches[0]
    for b in batches[1:]:
        shapes = shapes.unionByName(b, allowMissingColumns=True)
    return annotation_rows(shapes, manifest, ranges).withColumn("split", split_tag(F.col("name"), one_in))


def annotation_rows(shapes: DataFrame, manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Shapes within their annotator's frame range, with the frame's name and normalised boxes."""
    s = shapes.join(ranges, "annotator").where(F.col("frame").between(F.col("lo"), F.col("hi")))
    m = manifest.select(F.col("index").alias("frame"), "name", "width", "height")
    p = lambda i: F.get("points", F.lit(i))
    return s.join(m, "frame").select(
        "annotator", "frame", "name", F.when(F.col("label") == "Reflection", "Reflection").otherwise("Fish").alias("label"),
        ((p(0) + p(2)) / 2 / F.col("width")).alias("xc"), ((p(1) + p(3)) / 2 / F.col("height")).alias("yc"), (F.abs(p(2) - p(0)) / F.col("width")).alias("w"), (F.abs(p(3) - p(1)) / F.col("height")).alias("h"),
    )


def classify_merge(clusters: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Predictions (by clip file) joined to clusters by clip name; clips without one stay, null."""
    p = predictions.select(F.regexp_replace("VideoFile", r"\.mp4$", "").alias("ClipName"), "Prediction", "Confidence")
    return clusters.drop("Prediction", "Confidence", "modelID").join(p, "ClipName", "left").withColumn("modelID", F.lit(model))
