"""The five column types, schema building and strict checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Columns that sources add and sinks read back.
RESERVED = ("__time__", "__source__", "__topic__", "__category__", "__machine_uuid__", "__receive_time__")

#: Decimals have at most 38 digits; longer numbers stay strings until cast.
TYPES = {
    "varchar": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "bigdecimal": T.DecimalType(38, 18),
}


class ColumnNameConflict(ValueError):
    """Two columns of one table would have the same name."""


class ColumnNotExists(ValueError):
    """A named column is not there."""


class InconsistentColumns(ValueError):
    """Columns or rows that do not fit each other in type or number."""


class SchemaBuilder:
    """Ordered (name, type) pairs to a schema: ``SchemaBuilder().column("id", "int").build()``."""

    def __init__(self) -> None:
        self._fields: list[T.StructField] = []

    def column(self, name: str, kind: str) -> SchemaBuilder:
        if kind not in TYPES:
            raise InconsistentColumns(f"unknown type {kind}; known: {', '.join(TYPES)}")
        if name in (f.name for f in self._fields):
            raise ColumnNameConflict(name)
        self._fields.append(T.StructField(name, TYPES[kind], True))
        return self

    def build(self) -> T.StructType:
        if not self._fields:
            raise InconsistentColumns("a table has one column at least")
        return T.StructType(self._fields)


def check_unique(df: DataFrame) -> DataFrame:
    """``df``, or an error if two columns share a name; case counts only where the session resolves names by case."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    seen: set[str] = set()
    for c in df.columns:
        name = c if exact else c.lower()
        if name in seen:
            raise ColumnNameConflict(c)
        seen.add(name)
    return df


def fresh(base: str) -> str:
    """A column name that no caller's column has."""
    return f"_{base}_{uuid.uuid4().hex[:12]}"


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnNotExists(f"{', '.join(missing)} not in {', '.join(df.columns)}")
