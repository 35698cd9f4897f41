"""Table algebra: filters, projections, flat-maps, unions and in-memory tables.

Expressions come first; callables run over Arrow batches and need an output schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relstream.schema import check_columns, check_unique


def build(spark: SparkSession, schema: T.StructType | str, rows: Iterable[tuple]) -> DataFrame:
    """An in-memory table; values that do not fit their type raise."""
    return check_unique(spark.createDataFrame(list(rows), schema, verifySchema=True))


def rows_to_table(spark: SparkSession, rows: list[Row]) -> DataFrame | None:
    """A table of the rows, with their types; None without rows, as there is no schema then."""
    return spark.createDataFrame(rows) if rows else None


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition holds; unknown counts as false."""
    return df.filter(condition)


def where_rows(df: DataFrame, function: Callable[[Row], bool | None]) -> DataFrame:
    """Rows for which a Python callable holds; None counts as false. Only for what expressions can't say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(function(r)) for r in _rows(b)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def select(df: DataFrame, outputs: dict[str, Column], select_all: bool = False, keep: Column | None = None) -> DataFrame:
    """One row per row: the named outputs, after all input columns if ``select_all``; rows where ``keep`` is not true go."""
    kept = df if keep is None else df.filter(keep)
    own = [c.alias(n) for n, c in outputs.items()]
    return check_unique(kept.select(*([F.col(f"`{c}`") for c in df.columns] if select_all else []), *own))


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    make = Row(*batch.schema.names)
    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield make(*values)


def _by_rows(df: DataFrame, function: Callable[[Row], Iterable[tuple]], schema: T.StructType) -> DataFrame:
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for r in _rows(b) for x in function(r)]
            cols = zip(*got, strict=True) if got else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds.types, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def select_rows(df: DataFrame, function: Callable[[Row], tuple | None], schema: T.StructType) -> DataFrame:
    """One row per row by a Python callable; None drops the row, null fields are None. Only for what expressions can't say."""
    return _by_rows(df, lambda r: [x for x in (function(r),) if x is not None], schema)


def flat_select(df: DataFrame, array: Column, name: str, outputs: dict[str, Column] | None = None, select_all: bool = False) -> DataFrame:
    """One row per element of ``array``, as column ``name``, beside the outputs; rows of a null or empty array go."""
    kept = [F.col(f"`{c}`") for c in df.columns] if select_all else []
    return check_unique(df.select(*kept, *[c.alias(n) for n, c in (outputs or {}).items()], F.explode(array).alias(name)))


def flat_rows(df: DataFrame, function: Callable[[Row], list[tuple] | None], schema: T.StructType) -> DataFrame:
    """Any number of rows per row by a Python callable; None and empty lists drop the row."""
    return _by_rows(df, lambda r: function(r) or (), schema)


def project(df: DataFrame, *names: str) -> DataFrame:
    check_columns(df, *names)
    return df.select(*[F.col(f"`{n}`") for n in names])


def project_negative(df: DataFrame, *names: str) -> DataFrame:
    """All columns but the named ones; unknown names are no error."""
    return df.drop(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    check_columns(df, *names)
    return check_unique(df.withColumnsRenamed(names))


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """New columns behind the others; a name that is there already raises."""
    return select(df, columns, select_all=True)


def union_all(frames: list[DataFrame]) -> DataFrame | None:
    """All rows of all tables, columns by position; None for no table."""
    return reduce(DataFrame.union, frames) if frames else None


def union_distinct(frames: list[DataFrame]) -> DataFrame | None:
    """The distinct rows of all tables, columns by position, null equal to null; None for no table."""
    return reduce(DataFrame.union, frames).distinct() if frames else None


def order_by(df: DataFrame, *order: Column | str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order, nulls first as in windows; ``limit`` of them behind the first ``offset``, as a distributed top-k."""
    done = df.orderBy(*[F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order])
    done = done.offset(offset) if offset else done
    return done if limit is None else done.limit(limit)


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` and more rows, whose columns are found by name."""
    return df.unionByName(rows)


def index(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how often each key occurs; null is a key. Joins build their own hash tables, this one is for looking."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


class Index:
    """Rows to be looked up by key: dealt by the keys and sorted by them, so a look-up in stored files reads few of them.

    ``store`` writes the index to a folder; look-ups then skip files and row groups by their statistics.
    """

    def __init__(self, df: DataFrame, *keys: str):
        check_columns(df, *keys)
        self.keys, self.table = keys, df

    def store(self, folder: str) -> Index:
        self.table.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(folder)
        return Index(self.table.sparkSession.read.schema(self.table.schema).parquet(folder), *self.keys)

    def rows(self, *values) -> DataFrame:
        """All rows of a key; null finds null."""
        return reduce(lambda df, kv: df.filter(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), zip(self.keys, values, strict=True), self.table)

    def row(self, *values) -> Row | None:
        """One row of a key, or None."""
        got = self.rows(*values).take(1)
        return got[0] if got else None


def rehash(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by the hash of the keys: equal keys share a partition."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def rebalance(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt evenly."""
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def show(df: DataFrame, n: int = 100) -> None:
    df.show(n, truncate=False, vertical=True)


def serialize(df: DataFrame) -> bytes:
    """A small table as an Arrow IPC stream; all of it passes through the driver. Larger tables go to parquet."""
    arrow = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema) as writer:
        writer.write_table(arrow)
    return sink.getvalue().to_pybytes()


def deserialize(spark: SparkSession, data: bytes) -> DataFrame:
    """The table that ``serialize`` wrote, with its column types."""
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())
