"""Instrument logs: one record per line, ``Type: Key: value,,Key: value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.functions.expr import int_tuple, key_values, log_field, map_of, parse_time, repair_year, truth

JOB_FIELDS = {"job_id": r"Job id:\s*(\S+)", "job_name": r"Job name:\s*(\S+)", "queue": r"Queue:\s*(\S+)", "user": r"User id:\s*(\S+)", "end": r"End PBS Epilogue (.*)$", "start": r"Begin PBS Prologue (.*)$"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``project_id`` (the file's folder), ``value``; lines are kept in no particular order."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.text(path).select(folder.alias("project_id"), F.rtrim("value").alias("value"))


def fields_of(value: Column) -> Column:
    """The ``Key: value`` parts of a record as a map, read once; of a repeated key the last value holds."""
    body = F.substring(value, F.locate(":", value) + 1, F.length(value))
    parts = F.filter(F.transform(F.split(body, ",,"), lambda x: F.split(x, "[:=]", 2)), lambda x: F.size(x) == 2)
    return map_of(F.transform(parts, lambda x: F.struct(F.trim(x[0]).alias("key"), F.ltrim(x[1]).alias("value"))))


def records(lines: DataFrame) -> DataFrame:
    """Every record with its type and its fields as a map; types without a projection of their own stay readable here."""
    return lines.select("*", F.split("value", ":")[0].alias("type"), F.col("value").alias("line")).withColumn("fields", fields_of(F.col("value")))


def other_records(lines: DataFrame, known: tuple[str, ...] = ("MasterStart", "FrameCaptured", "BackgroundCaptured", "PiCameraStarted", "PiCameraStopped")) -> DataFrame:
    """``project_id, type, time, fields`` of the records of all other types."""
    rows = records(lines).where(~F.col("type").isin(*known))
    return rows.select("project_id", "type", parse_time(F.try_element_at("fields", F.lit("Time"))).alias("time"), "fields")


def frames(lines: DataFrame, kind: str = "FrameCaptured") -> DataFrame:
    """Frame (or ``BackgroundCaptured``) records with their place in time and relative day."""
    names = {"npy_file": "NpyFile", "pic_file": "PicFile", "time": "Time", "med": "AvgMed", "std": "AvgStd", "gp": "GP", "lof": "LOF"}
    read = lines.where(F.col("value").startswith(kind + ":")).select("project_id", fields_of(F.col("value")).alias("fields"))
    rows = read.select("project_id", *[F.try_element_at("fields", F.lit(k)).alias(c) for c, k in names.items()]).select(
        "project_id", "npy_file", "pic_file", parse_time(F.col("time")).alias("time"), F.col("med").try_cast("double").alias("med"),
        F.col("std").try_cast("double").alias("std"), F.col("gp").try_cast("bigint").alias("gp"), truth(F.col("lof")).alias("lof"),
    )
    rows = rows.withColumn("time", repair_year(F.col("time"), F.col("npy_file")))
    return relative_day(rows.withColumn("frame_idx", F.row_number().over(W.partitionBy("project_id").orderBy("time", "npy_file")) - 1))


def relative_day(rows: DataFrame, time: str = "time") -> DataFrame:
    """``rel_day``: 1 on the first date of a project, one more at each new date."""
    order = W.partitionBy("project_id").orderBy(time, "frame_idx")
    new = F.coalesce((F.to_date(time) != F.to_date(F.lag(time).over(order))).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("rel_day", F.sum("_new").over(order).cast("int")).drop("_new")


def movies(lines: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """Movies of either dialect; one never stopped ends with the project's last frame."""
    get = lambda k: log_field(F.col("value"), k)
    size = int_tuple(F.coalesce(get("Resolution"), F.lit("1296x972")))
    start = lines.where(F.col("value").startswith("PiCameraStarted:")).select(
        "project_id", parse_time(get("Time")).alias("start_time"), F.coalesce(get("VideoFile"), get("File")).alias("h264_file"), F.coalesce(get("PicFile"), F.lit("Unknown")).alias("pic_file"),
        F.coalesce(get("FrameRate").try_cast("double"), F.lit(30.0)).alias("framerate"), size[0].alias("width"), size[1].alias("height"),
    )
    stop = lines.where(F.col("value").startswith("PiCameraStopped:")).select("project_id", parse_time(get("Time")).alias("_stop"), F.coalesce(get("VideoFile"), get("File")).alias("h264_file"))
    last = frame_rows.groupBy("project_id").agg(F.max("time").alias("_last"))
    rows = start.join(stop.groupBy("project_id", "h264_file").agg(F.max("_stop").alias("_stop")), ["project_id", "h264_file"], "left").join(last, "project_id", "left")
    name = F.regexp_extract("h264_file", r"([^/]*?)(?:\.h264)?$", 1)
    return rows.select("project_id", name.alias("base_name"), "start_time", F.coalesce("_stop", "_last").alias("end_time"), "h264_file", F.regexp_replace("h264_file", r"\.h264$", ".mp4").alias("mp4_file"), "pic_file", "framerate", "width", "height")


def headers(lines: DataFrame) -> DataFrame:
    """Header of each project, with swapped tank and project ids put right; ``n_headers`` flags repeats."""
    get = lambda k: log_field(F.col("value"), k)
    rows = lines.where(F.col("value").startswith("MasterStart:")).select("project_id", get("System").alias("system"), get("Device").alias("device"), get("Uname").alias("uname"), get("TankID").alias("_t"), get("ProjectID").alias("_p"), get("AnalysisID").alias("analysis_id"))
    swapped = F.col("_p").startswith("Tk")
    rows = rows.select("project_id", "system", "device", "uname", F.when(swapped, F.col("_p")).otherwise(F.col("_t")).alias("tank_id"), F.when(swapped, F.col("_t")).otherwise(F.col("_p")).alias("log_project"), "analysis_id")
    return rows.withColumn("n_headers", F.count("*").over(W.partitionBy("project_id")))


#: Columns that job logs may turn into.
MOST_KEYS = 1000


def job_logs(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each job log (``file, value``): fields, resources as columns, outcome. ``keys`` names the
    resources wanted; without it they are listed first, and more than ``MOST_KEYS`` are refused. A resource without a value is Y.
    """
    text = lines.groupBy("file").agg(F.array_join(F.collect_list("value"), "\n").alias("text"))
    get = lambda p: F.nullif(F.regexp_extract("text", "(?m)" + p, 1), F.lit(""))
    rows = text.select(
        "file", *[get(p).alias(k) for k, p in JOB_FIELDS.items()], get(r"^Resources:\s*(.*)$").alias("asked"), get(r"^Rsrc Used:\s*(.*)$").alias("used"),
        F.when(F.col("text").rlike("(?i)job killed"), "killed").otherwise("successful").alias("outcome"),
    )
    given = lambda c, prefix: F.transform(F.map_entries(F.coalesce(key_values(F.col(c)), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), F.coalesce(e["value"], F.lit("Y")).alias("value")))
    pairs = rows.withColumn("given", map_of(F.concat(given("asked", ""), given("used", "used_"))))
    names = [r[0] for r in pairs.select(F.explode(F.map_keys("given")).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()] if keys is None else keys
    if keys is None and len(names) > MOST_KEYS:
        raise ValueError(f"the logs name more than {MOST_KEYS} resources: say which ones are wanted (keys)")
    return pairs.select(*[c for c in rows.columns if c not in ("asked", "used")], *[F.try_element_at("given", F.lit(k)).alias(k) for k in names]).orderBy("job_name")
