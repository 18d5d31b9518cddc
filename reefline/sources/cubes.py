"""Stored depth cubes: buckets of square tiles, so that work by cell reads what belongs together and shuffles nothing.

A cube is a table bucketed by project and tile (``TILE`` cells on a side), a file for each bucket, sorted by cell and
frame. The tile's place is in the columns ``tile_y`` and ``tile_x``; operators by cell take it into their keys
(``operators.depth.cell_keys``), so that the table's own partitioning serves their windows and aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 32
#: Bytes of a stored cell, about, and of a bucket; for ``buckets_for``.
CELL_BYTES, BUCKET_BYTES = 16, 128 << 20


def buckets_for(cells: int, least: int = 1) -> int:
    """Buckets that a cube of so many rows should have: about 128 MB each."""
    return max(least, -(-cells * CELL_BYTES // BUCKET_BYTES))


def join_in_place(spark: SparkSession) -> None:
    """Lets this session join stored cubes tile by tile: a join whose keys hold the buckets' columns and more needs no shuffle then."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def with_tiles(cells: DataFrame, tile: int = TILE) -> DataFrame:
    return cells.withColumns({"tile_y": F.floor(F.col("y") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")})


def write_cube(cells: DataFrame, name: str, path: str, buckets: int, tile: int = TILE) -> DataFrame:
    """Stores the cube as table ``name`` at ``path`` and returns it as stored. One shuffle; the cells of a tile go to one file."""
    keys = ["project_id", "tile_y", "tile_x"]
    rows = with_tiles(cells, tile).repartition(buckets, *keys)
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, "y", "x", "frame_idx").saveAsTable(name)
    return cells.sparkSession.table(name)


def read_cube(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
