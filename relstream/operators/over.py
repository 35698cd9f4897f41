"""Analytic windows over bounded tables: ascending, nulls first, null is a partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.schema import InconsistentColumns, check_unique


def spec(partition: Sequence[str], order: Sequence[Column | str] = ()) -> WindowSpec:
    w = Window.partitionBy(*partition)
    return w.orderBy(*[F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]) if order else w


def over(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], outputs: dict[str, Column]) -> DataFrame:
    """Input columns and the outputs, each evaluated over its row's partition in order (running frame, ties by value)."""
    w = spec(partition, order)
    return check_unique(df.select("*", *[c.over(w).alias(n) for n, c in outputs.items()]))


def rows_over(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], size: int, outputs: dict[str, Column]) -> DataFrame:
    """Aggregates over the last ``size`` rows up to and including the current one."""
    w = spec(partition, order).rowsBetween(-(size - 1), 0)
    return check_unique(df.select("*", *[c.over(w).alias(n) for n, c in outputs.items()]))


def duration_over(df: DataFrame, partition: Sequence[str], time: str, size_ms: int, outputs: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows from the current one's time up to ``size_ms - 1`` later, earlier rows of equal time among them."""
    w = Window.partitionBy(*partition).orderBy(F.col(time)).rangeBetween(0, size_ms - 1)
    return check_unique(df.select("*", *[c.over(w).alias(n) for n, c in outputs.items()]))


def over_rows(df: DataFrame, partition: Sequence[str], order: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: T.StructType) -> DataFrame:
    """Whole partitions through a Python callable that returns one new row per row; None drops the partition. ``schema``: the new columns."""
    full = T.StructType([*df.schema.fields, *schema.fields])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), na_position="first", kind="stable").reset_index(drop=True)
        got = function(rows)
        if got is None:
            return pd.DataFrame(columns=full.names)
        if len(got) != len(rows):
            raise InconsistentColumns(f"{len(got)} results for {len(rows)} rows")
        return pd.concat([rows, got.reset_index(drop=True).set_axis(schema.names, axis=1)], axis=1)

    return df.groupBy(*partition).applyInPandas(run, full)
