"""Event-time windows, the same over tables and streams: tumbling, sliding, session.

``time`` is a timestamp column; window bounds come back as epoch milliseconds, half open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.schema import fresh


def starts(time: str, size_ms: int, slide_ms: int, origin_ms: int | Column | None) -> Column:
    """Array of the starts, in epoch ms, of the hopping windows that hold a time; with an origin none before its tumbling bucket."""
    ms = F.unix_millis(F.col(time))
    origin = F.lit(0) if origin_ms is None else F.lit(origin_ms) if isinstance(origin_ms, int) else origin_ms
    first = origin - F.pmod(origin, F.lit(size_ms))
    last = ms - F.pmod(ms - first, F.lit(slide_ms))
    every = F.transform(F.sequence(F.lit(0), F.lit((size_ms - 1) // slide_ms)), lambda i: last - i * slide_ms)
    return F.filter(every, lambda s: (s > ms - size_ms) if origin_ms is None else (s > ms - size_ms) & (s >= first))


def slide(df: DataFrame, size_ms: int, slide_ms: int, keys: Sequence[str], time: str, aggregates: dict[str, Column], origin_ms: int | Column | None = None) -> DataFrame:
    """Hopping windows ``[start, start + size)``: keys, window_start, window_end, aggregates.

    ``origin_ms`` is the first event's time: windows that start before its tumbling bucket are left out, and starts are
    aligned to that bucket. Over a table it may be ``first_ms``; over a stream pass the number that is known, or None for
    all windows.
    """
    if not 0 < slide_ms <= size_ms:
        raise ValueError("the slide must be positive and not above the size")
    if not keys or not aggregates:
        raise ValueError("a window needs a key and an output at least")
    own = [c.alias(n) for n, c in aggregates.items()]
    if isinstance(origin_ms, Column):
        origin, start = fresh("origin"), fresh("start")
        held = df.withColumn(origin, origin_ms).withColumn(start, F.explode(starts(time, size_ms, slide_ms, F.col(origin))))
        done = held.groupBy(*keys, F.col(start).alias("window_start")).agg(*own)
        return done.select(*keys, "window_start", (F.col("window_start") + size_ms).alias("window_end"), *aggregates)
    start = None if origin_ms is None else origin_ms - origin_ms % size_ms
    shift = 0 if start is None else start % slide_ms
    w = F.window(time, f"{size_ms} milliseconds", f"{slide_ms} milliseconds", f"{shift} milliseconds")
    done = df.groupBy(*keys, w).agg(*own)
    done = done.select(*keys, F.unix_millis("window.start").alias("window_start"), F.unix_millis("window.end").alias("window_end"), *aggregates)
    return done if start is None else done.filter(F.col("window_start") >= start)


def tumble(df: DataFrame, size_ms: int, keys: Sequence[str], time: str, aggregates: dict[str, Column]) -> DataFrame:
    """Windows side by side: every row in one of them."""
    return slide(df, size_ms, size_ms, keys, time, aggregates)


def session(df: DataFrame, timeout_ms: int, keys: Sequence[str], time: str, aggregates: dict[str, Column]) -> DataFrame:
    """Sessions per key: a gap of ``timeout_ms`` or more splits. window_end is the last event plus 1 ms."""
    gap = f"{timeout_ms * 1000 - 1} microseconds"  # the built-in session merges at equality
    first, last = fresh("first"), fresh("last")
    done = df.groupBy(*keys, F.session_window(time, gap)).agg(F.min(time).alias(first), F.max(time).alias(last), *[c.alias(n) for n, c in aggregates.items()])
    return done.select(*keys, F.unix_millis(first).alias("window_start"), (F.unix_millis(last) + 1).alias("window_end"), *aggregates)


def first_ms(df: DataFrame, time: str) -> Column:
    """The earliest event of a bounded table in epoch ms, for ``origin_ms``: a scalar subquery, part of the plan that uses it."""
    return df.agg(F.min(F.unix_millis(time))).scalar()


def _by_groups(df: DataFrame, first: str, at: str, function: Callable[[int, int, pd.DataFrame], list[tuple] | None], schema: T.StructType) -> DataFrame:
    """``function`` over groups of rows that lie one behind the other in each partition, ``first`` being true on a group's first row.

    It gets ``at`` of a group's first and last row, and the rows without both columns. Groups are cut out of whole Arrow
    batches, as a conversion for each would cost far more than a group of a few rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []  # the group that the next batch may go on with
        low = high = 0

        def table(got: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(got, columns=schema.names, dtype=object).infer_objects()

        for b in batches:
            cuts, when, b = b[first].to_numpy(bool).nonzero()[0].tolist(), b[at].tolist(), b.drop(columns=[first, at])
            if not when:
                continue
            got, begin = [], cuts[0] if cuts else len(when)
            if begin:
                open_.append(b.iloc[:begin])
                high = when[begin - 1]
            if not cuts:
                continue
            if open_:
                got += function(low, high, pd.concat(open_)) or ()
            for i, j in zip(cuts, cuts[1:]):
                got += function(when[i], when[j - 1], b.iloc[i:j]) or ()
            open_, low, high = [b.iloc[cuts[-1] :]], when[cuts[-1]], when[-1]
            yield table(got)
        if open_:
            yield table(list(function(low, high, pd.concat(open_)) or ()))

    return df.mapInPandas(run, schema)


def slide_rows(df: DataFrame, size_ms: int, slide_ms: int, keys: Sequence[str], time: str, function: Callable[[tuple, pd.DataFrame], list[tuple]], schema: T.StructType, origin_ms: int | Column | None = None) -> DataFrame:
    """Hopping windows by a Python callable: ``function((window_start, window_end), rows in time order)`` gives any number of rows.

    All rows of a key and window pass through one call, so prefer ``slide`` where an aggregate can say it.
    """
    ws, origin, first = fresh("start"), fresh("origin"), fresh("first")
    given = origin_ms if origin_ms is None or isinstance(origin_ms, int) else F.col(origin)
    held = df if given is origin_ms else df.withColumn(origin, origin_ms)
    held = held.withColumn(ws, F.explode(starts(time, size_ms, slide_ms, given))).drop(origin)
    held = held.withColumn(first, F.row_number().over(Window.partitionBy(*keys, ws).orderBy(time)) == 1)

    return _by_groups(held, first, ws, lambda start, _, rows: function((start, start + size_ms), rows), schema)


def session_rows(df: DataFrame, timeout_ms: int, keys: Sequence[str], time: str, function: Callable[[tuple, pd.DataFrame], list[tuple]], schema: T.StructType) -> DataFrame:
    """Sessions of a bounded table by a Python callable over (first, last + 1 ms) and the session's rows in time order."""
    ms, first = fresh("ms"), fresh("first")
    w = Window.partitionBy(*keys).orderBy(ms)
    held = df.withColumn(ms, F.unix_millis(time))
    held = held.withColumn(first, F.coalesce(F.col(ms) - F.lag(ms).over(w) >= timeout_ms, F.lit(True)))

    return _by_groups(held, first, ms, lambda low, high, rows: function((low, high + 1), rows), schema)
