"""Hook for a user's model over rows: it is loaded once for each task and sees batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], inputs: list[str], keep: list[str], made: str) -> DataFrame:
    """Columns ``keep`` and what the model makes of ``inputs`` (a DDL ``made``), in the same order."""
    names = [c.strip().split()[0] for c in made.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", " + made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = model(batch[inputs])
            yield pd.concat([batch[keep].reset_index(drop=True), out[names].reset_index(drop=True)], axis=1)

    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)
