"""Joins. Equal keys match null-safely by default: null equals null. Catalyst still hashes or sorts such keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from relstream.operators.table import where_rows
from relstream.schema import check_columns, check_unique, fresh


def _join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, rename: dict[str, str] | None, null_safe: bool, extra: str | None) -> DataFrame:
    check_columns(left, *(a for a, _ in on))
    check_columns(right, *(b for _, b in on))
    names = dict(rename or {})
    right = right.withColumnsRenamed(names)
    condition = reduce(and_, [left[a].eqNullSafe(right[names.get(b, b)]) if null_safe else left[a] == right[names.get(b, b)] for a, b in on], F.lit(True))
    if extra:
        condition = condition & F.expr(extra)
    return check_unique(left.join(right, condition, how))


def inner(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], rename: dict[str, str] | None = None, null_safe: bool = True, extra: str | None = None) -> DataFrame:
    """Left columns, then right ones as renamed; a name that is there twice raises. ``extra`` is a further condition in SQL."""
    return _join(left, right, on, "inner", rename, null_safe, extra)


def left(left_side: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], rename: dict[str, str] | None = None, null_safe: bool = True, extra: str | None = None) -> DataFrame:
    """All left rows; right columns are null where nothing matches. Names and null keys as in ``inner``."""
    return _join(left_side, right, on, "left", rename, null_safe, extra)


def right(left_side: DataFrame, right_side: DataFrame, on: Sequence[tuple[str, str]], rename: dict[str, str] | None = None, null_safe: bool = True, extra: str | None = None) -> DataFrame:
    """All right rows; left columns are null where nothing matches."""
    return _join(left_side, right_side, on, "right", rename, null_safe, extra)


def full(left_side: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], rename: dict[str, str] | None = None, null_safe: bool = True, extra: str | None = None) -> DataFrame:
    """All rows of both sides, nulls where nothing matches."""
    return _join(left_side, right, on, "full", rename, null_safe, extra)


def semi(left_side: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], null_safe: bool = True) -> DataFrame:
    """Left rows that have a match, each once."""
    return _join(left_side, right, on, "left_semi", None, null_safe, None)


def anti(left_side: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], null_safe: bool = True) -> DataFrame:
    """Left rows without a match."""
    return _join(left_side, right, on, "left_anti", None, null_safe, None)


def theta(left_side: DataFrame, right: DataFrame, condition: Column | str, how: str = "inner") -> DataFrame:
    """Any condition. Without an equality in it every pair is tested, so one side should be small; ``in_range`` buckets."""
    return check_unique(left_side.join(right, F.expr(condition) if isinstance(condition, str) else condition, how))


def inner_rows(left_side: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], function: Callable[[Row], bool | None], rename: dict[str, str] | None = None, null_safe: bool = True) -> DataFrame:
    """Pairs of equal keys for whose joined row a Python callable holds. Pairs are made by key first, so keys should be selective."""
    return where_rows(inner(left_side, right, on, rename, null_safe), function)


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bucket: int, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with ``low <= point < high``: points and ranges meet in buckets of width ``bucket``, an equi-join.

    A range is copied into every bucket it touches, so the width should be about a typical range's.
    """
    mine, theirs = fresh("bucket"), fresh("bucket")
    p = points.withColumn(mine, F.floor(F.col(point) / bucket))
    r = ranges.filter(F.col(low) < F.col(high)).withColumn(theirs, F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor((F.col(high) - 1) / bucket))))
    condition = (F.col(mine) == F.col(theirs)) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    condition = reduce(and_, [p[a].eqNullSafe(r[b]) for a, b in on], condition)
    return check_unique(p.join(r, condition).drop(mine, theirs))


def as_of(left_side: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """Each left row with the named ``columns`` of the latest right row of its keys at or before its time (nulls if none).

    Both sides go through one window over their union, so no pairs are made; of right rows at equal times one with the
    greatest values is taken.
    """
    keys = [a for a, _ in by]
    payload = F.struct(*[F.col(f"`{c}`") for c in columns])
    l = left_side.select(*[F.col(a).alias(f"_k{i}") for i, a in enumerate(keys)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left_side.columns]).alias("_l"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_r"))
    r = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(by)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    from pyspark.sql import Window

    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    return check_unique(both.filter("_side = 1").select("_l.*", *[F.col(f"_last.`{c}`").alias(c) for c in columns]))


def interval(left_side: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_time: str, right_time: str, before_ms: int, after_ms: int) -> DataFrame:
    """Pairs of equal keys (null matches nothing) whose right time lies from ``before_ms`` before to ``after_ms`` behind the left one's.

    The times are timestamps. Two streams need a watermark on each; their state is then bounded by the interval.
    """
    condition = reduce(and_, [left_side[a] == right[b] for a, b in on])
    low, high = (F.expr(f"INTERVAL {ms} MILLISECOND") for ms in (before_ms, after_ms))
    condition = condition & (right[right_time] >= left_side[left_time] - low) & (right[right_time] <= left_side[left_time] + high)
    return check_unique(left_side.join(right, condition))


def with_dimension(stream: DataFrame, dimension: DataFrame, on: Sequence[tuple[str, str]], rename: dict[str, str] | None = None) -> DataFrame:
    """Left join of a stream or table to a dimension snapshot. Whether it is broadcast is left to its measured size."""
    return left(stream, dimension, on, rename)
