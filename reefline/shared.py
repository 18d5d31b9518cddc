"""The folder that the driver and all executors share, and steps written there to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only a local session may lack one: it gets a folder
of its own. All steps of an application lie below one folder, which ``clean`` removes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/steps-{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame after it was written to the shared folder: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a table sent to all tasks may have.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, name: str = "small") -> DataFrame:
    """The frame, written, for a join with a large one: sent to all tasks if it has ``BROADCAST_ROWS`` at most."""
    held = written(df, name)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def clean(spark: SparkSession) -> None:
    """Removes all steps of this application; frames that read them are void afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
