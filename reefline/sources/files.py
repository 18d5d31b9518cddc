"""Array, table, box, annotation and geometry files; table sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``file, y, x, value`` of ``.npy`` grids, NaN as null. A missing file has no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return array_cells(files.select(F.col("path").alias("file"), "content"))


#: Cells of a grid that are made at once.
BAND = 1 << 18


def array_cells(files: DataFrame) -> DataFrame:
    """``file, y, x, value`` of grids given as ``file`` and ``content`` (the bytes of an ``.npy`` file); a grid is
    unfolded in bands of rows, so a large one never stands there whole as rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for k in range(batch.num_rows):
                content = batch["content"][k].as_py()
                if content is None:
                    continue
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                step = max(1, BAND // max(1, grid.shape[1]))
                for first in range(0, grid.shape[0], step):
                    band = grid[first : first + step].astype(float)
                    y, x = np.indices(band.shape, dtype=np.int32)
                    same = pa.array(np.full(band.size, k))
                    yield pa.RecordBatch.from_arrays([batch["file"].take(same), pa.array((y + np.int32(first)).ravel()), pa.array(x.ravel()), pa.array(band.ravel(), from_pandas=True)], names=["file", "y", "x", "value"])

    return files.select("file", "content").mapInArrow(decode, "file string, y int, x int, value double")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_detections(spark: SparkSession, path: str, width: int = 1296, height: int = 972) -> DataFrame:
    """Boxes of per-frame text files ``name_12.txt`` with rows ``class xc yc w h score`` (0 to 1)."""
    return detection_rows(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), width, height)


def detection_rows(lines: DataFrame, width: int = 1296, height: int = 972) -> DataFrame:
    """The same of lines (``file, value``)."""
    name = F.element_at(F.split("file", "/"), -1)
    rows = lines.select(F.regexp_extract(name, r"^(.*)_\d+\.txt$", 1).alias("base_name"), F.regexp_extract(name, r"_(\d+)\.txt$", 1).cast("int").alias("frame"), F.split(F.trim("value"), r"\s+").alias("v"))
    v = lambda i: F.get("v", F.lit(i)).try_cast("double")
    return rows.where(F.size("v") >= 6).select(
        "base_name", "frame", ((v(1) - v(3) / 2) * width).alias("x1"), ((v(2) - v(4) / 2) * height).alias("y1"), ((v(1) + v(3) / 2) * width).alias("x2"),
        ((v(2) + v(4) / 2) * height).alias("y2"), v(5).alias("score"), v(0).alias("class_id"),
    )


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Shapes of nested annotation files, one row each; with ``lines`` a file has a batch of shapes on each line."""
    schema = "shapes ARRAY<STRUCT<type: STRING, points: ARRAY<DOUBLE>, frame: INT, attributes: ARRAY<STRING>, label: STRING>>"
    return spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("shapes").alias("s")).select("s.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a manifest in JSON lines; header lines have no name."""
    rows = spark.read.schema("name STRING, extension STRING, width INT, height INT, index INT").json(path)
    return rows.where(F.col("name").isNotNull())


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """``dir, name`` of every file below a path, without reading contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))


def tray(c: F.Column) -> F.Column:
    """A tray's four numbers with the smaller of each pair first."""
    return F.array(F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3]))


def read_polygon(spark: SparkSession, path: str) -> DataFrame:
    """``project_id`` (the file's folder), ``vertices``: polygons as text, a vertex ``x,y`` on each line."""
    return polygon_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def polygon_rows(texts: DataFrame) -> DataFrame:
    """The same of whole texts (``file, value``)."""
    folder = F.element_at(F.split("file", "/"), -2)
    rows = texts.select(folder.alias("project_id"), F.filter(F.split("value", "\n"), lambda v: F.trim(v) != "").alias("v"))
    at = lambda v, i: F.split(v, ",")[i].try_cast("double")
    return rows.select("project_id", F.transform("v", lambda v: F.struct(at(v, 0).alias("x"), at(v, 1).alias("y"))).alias("vertices"))


def read_tray(spark: SparkSession, path: str) -> DataFrame:
    """``project_id``, ``tray`` of tray files: four numbers by comma on the first line."""
    return tray_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def tray_rows(texts: DataFrame) -> DataFrame:
    """The same of whole texts (``file, value``)."""
    folder = F.element_at(F.split("file", "/"), -2)
    rows = texts.select(folder.alias("project_id"), F.transform(F.split(F.split("value", "\n")[0], ","), lambda v: F.trim(v).try_cast("int")).alias("t"))
    return rows.select("project_id", tray(F.col("t")).alias("tray"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``m``: grids of ``.npy`` files row by row, such as a 3 by 3 transform (small ones only)."""
    rows = read_arrays(spark, path)
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("c")).select("file", F.transform("c", lambda c: c["value"]).alias("m"))


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated files with a header; nulls are empty, times ISO."""
    df.write.mode("overwrite").csv(path, header=True)


def write_by_project(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("project_id").parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One table for each sheet of a report, side by side under one path."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/sheet={name}")


def append_merge(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A master table with new rows; columns that one side lacks are null there."""
    return table.unionByName(rows, allowMissingColumns=True)


def write_split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)
