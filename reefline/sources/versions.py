"""Tables that are replaced as a whole: a new version is written beside the old one and then made the current one.

A table is a folder of versions and a folder of numbered marks. A version's files are complete before its mark is
made, and a mark is made by creating a file that must not exist yet; so a job that fails leaves the old version
readable, and of two jobs that started from the same version only one gets through (the other one is told).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Outdated(RuntimeError):
    """Another job has made a version since this one read the table."""


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _marks(spark: SparkSession, root: str) -> list[int]:
    p, fs = _files(spark, f"{root}/_marks")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and path of the current version; 0 and None before the first."""
    marks = _marks(spark, root)
    if not marks:
        return 0, None
    p, fs = _files(spark, f"{root}/_marks/{marks[-1]:012d}")
    stream = fs.open(p)
    name = stream.readUTF()
    stream.close()
    return marks[-1], f"{root}/{name}"


def read(spark: SparkSession, root: str) -> DataFrame:
    n, path = current(spark, root)
    if path is None:
        raise FileNotFoundError(f"no version of {root}")
    return spark.read.parquet(path)


def publish(df: DataFrame, root: str, after: int) -> int:
    """Writes ``df`` as the version after number ``after`` and returns its number."""
    spark = df.sparkSession
    name = f"version-{after + 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    p, fs = _files(spark, f"{root}/_marks/{after + 1:012d}")
    try:
        stream = fs.create(p, False)
    except Exception as error:
        if fs.exists(p):
            raise Outdated(f"{root} has a version {after + 1} already") from error
        raise
    stream.writeUTF(name)
    stream.close()
    return after + 1


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """The table after ``change`` of its current version (None before the first) was published."""
    n, path = current(spark, root)
    publish(change(spark.read.parquet(path) if path else None), root, n)
    return read(spark, root)


def forget(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes the files of all but the last ``keep`` versions, and of versions that never became one; marks stay."""
    marks = _marks(spark, root)[-keep:]
    held = set()
    for k in marks:
        p, fs = _files(spark, f"{root}/_marks/{k:012d}")
        stream = fs.open(p)
        held.add(stream.readUTF())
        stream.close()
    p, fs = _files(spark, root)
    last = marks[-1] if marks else 0
    for s in fs.listStatus(p) if fs.exists(p) else []:
        name = s.getPath().getName()
        if name.startswith("version-") and name not in held and int(name.split("-")[1]) <= last:
            fs.delete(s.getPath(), True)
