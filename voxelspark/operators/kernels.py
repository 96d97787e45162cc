"""User functions over batches of rows: the way out where column expressions do not reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dispatch(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A kernel over all rows, by Arrow batches; it sees rows only, so there are no padding threads to guard against."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield kernel(batch)

    return rows.mapInPandas(run, schema)


def by_kind(kind: Column, callbacks: dict[str, Column], otherwise: Column) -> Column:
    """The expression registered for a row's kind, as a draw callback of its material would be."""
    out = F.when(F.lit(False), otherwise)
    for name, value in callbacks.items():
        out = out.when(kind == name, value)
    return out.otherwise(otherwise)


def path_lengths(paths: DataFrame, key: list[str], positions: str) -> DataFrame:
    """Points and length of a path given as an array of structs x, y, z; null or empty paths have length 0."""
    step = F.expr(f"transform(sequence(1, size({positions}) - 1), i -> sqrt(pow({positions}[i].x - {positions}[i - 1].x, 2) + pow({positions}[i].y - {positions}[i - 1].y, 2) + pow({positions}[i].z - {positions}[i - 1].z, 2)))")
    total = F.aggregate(step, F.lit(0.0), lambda a, x: a + x)
    return paths.select(*key, F.greatest(F.size(positions), F.lit(0)).alias("points"), F.when(F.size(positions) > 1, total).otherwise(0.0).alias("length"))
