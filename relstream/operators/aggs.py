"""Grouping and aggregates. Null is a group; sums of nothing are 0; ``avg_all`` divides by all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.schema import fresh


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def group_by(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], having: Column | str | None = None) -> DataFrame:
    """One row per key; groups where ``having`` is not true go. Partial sums are formed before the shuffle."""
    done = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return done if having is None else done.filter(having)


def group_rows(df: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], tuple | None], schema: T.StructType) -> DataFrame:
    """One row per key by a Python callable over all rows of the group; None drops the group. A group must fit in a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = function(rows)
        return pd.DataFrame([] if got is None else [got], columns=schema.names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def count_rows() -> Column:
    return F.count(F.lit(1))


def sum0(c: Column | str) -> Column:
    """Sum as a long, nulls skipped, 0 for nothing. Fractions are added up as they are; the sum is cut to a whole number."""
    return F.coalesce(F.sum(_col(c)).cast("long"), F.lit(0).cast("long"))


def sum0_double(c: Column | str) -> Column:
    return F.coalesce(F.sum(_col(c).cast("double")), F.lit(0.0))


def avg_all(c: Column | str) -> Column:
    """Sum over the number of all rows, nulls among them; NaN for no rows."""
    return F.when(F.count(F.lit(1)) == 0, F.lit(float("nan"))).otherwise(sum0_double(c) / F.greatest(F.count(F.lit(1)), F.lit(1)))


def group_concat(c: Column | str, order: Sequence[Column | str], separator: str = ",") -> Column:
    """Values as text in the given order, null as ``null``; empty text for no rows."""
    rows = F.sort_array(F.collect_list(F.struct(*[_col(o).alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(_col(c).cast("string"), F.lit("null")).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def top_n(df: DataFrame, n: int, order: Sequence[Column], partition: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each partition in the given order, which should break ties; with their numbers from 1 as ``rank``.

    Spark limits each task's rows per partition before the shuffle. Without a partition the limit is a distributed top-k.
    """
    if not partition and rank is None:
        return df.orderBy(*order).limit(n)
    name = rank or fresh("rank")
    done = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= n)
    return done.withColumn(name, F.col(name).cast("long")) if rank else done.drop(name)
