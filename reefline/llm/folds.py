"""The fixed fold of the contract: rows that no model may learn from."""

from pyspark.sql import functions as F


def held_out() -> F.Column:
    """True if crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
