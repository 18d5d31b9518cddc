"""Small helpers shared by the operators: column-safe mapping, joins with frequent keys, steps in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline.shared import written


__all__ = ["map_text", "meet", "plain", "written"]


def map_text(docs: DataFrame, fn: Callable[[pa.Array], dict[str, pa.Array]], made: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row, and what ``fn`` returns for the batch's texts (a DDL ``made``). A text that is kept goes
    to Python once.
    """
    fields = [docs.schema[c] for c in keep] + T._parse_datatype_string(made).fields
    names = [f.name for f in fields]
    k = len(keep)
    own = [docs[c].alias(f"_k{i}") for i, c in enumerate(keep)]
    at = keep.index(text) if text in keep else k
    source = docs.select(*own) if text in keep else docs.select(*own, docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = fn(batch.column(at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *(got[n] for n in names[k:])], names=names)

    return source.mapInArrow(run, T.StructType(fields))


def plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with all columns under names that clash with none (and ``doc_id`` and ``text`` beside
    them), and the way back to the columns it came with.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    out = own.select(*names, *[own[names[docs.columns.index(c)]].alias(c) for c in ("doc_id", "text")])
    return out, lambda df: df.select(*names).toDF(*docs.columns)


#: Rows that a broadcast may have, and rows of one key that go to a task together.
BROADCAST_ROWS, TOGETHER = 1_000_000, 10_000


def meet(left: DataFrame, right: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Inner join with a side of unique keys, whose ``_n`` tells how many rows of ``left`` have the key.

    ``rows`` bounds the rows of ``right``, if known: a small side is broadcast. Else the rows of a frequent
    key are dealt out, and its row on the right goes along to each share; the list of such keys is
    broadcast, and its bound is kept by raising the size of a share.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop("_n")), keys)
    many = right.where(F.col("_n") > TOGETHER)
    sizes = many.groupBy(F.floor(F.log2("_n")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()  # a row for each power of two
    if not sizes:
        return left.join(right.drop("_n"), keys)
    share, so_far = 1 << 62, 0
    for r in sizes:
        so_far += r["count"]
        if so_far <= BROADCAST_ROWS:
            share = max(1 << r["b"], TOGETHER)
    shares = F.when(F.col("_n") >= share, F.ceil(F.col("_n") / share).cast("int")).otherwise(1)
    held = right.withColumn("_shares", shares)
    hot = F.broadcast(held.where("_shares > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_shares").alias("_of")))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    salt = F.when(F.col("_of").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[left[c] for c in left.columns]), F.col("_of"))).cast("int")
    spread = left.join(hot, on, "left").select(*left.columns, salt.alias("_salt"))
    copies = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_n", "_shares")
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")
