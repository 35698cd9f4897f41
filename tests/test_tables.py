"""Fixtures of table algebra, grouping, joins, windows and scalars."""

import math

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.functions import scalar
from relstream.operators import aggs, joins, over, table, windows
from relstream.schema import ColumnNameConflict, ColumnNotExists, InconsistentColumns, SchemaBuilder
from relstream.sources.tables import latest_partition

GROUP = [(1, "ss"), (-1, None), (None, "dd"), (1, None)]
OVER = [(1, "ss"), (-1, None), (None, "dd"), (1, "cc")]
RIGHT = [(1, "ss"), (None, "ff"), (1, None), (2, "ee")]


def test_schema_builder_rejects_duplicates_and_unknown_types():
    s = SchemaBuilder().column("c1", "int").column("c2", "varchar")
    assert s.build().simpleString() == "struct<c1:int,c2:string>"
    with pytest.raises(ColumnNameConflict):
        s.column("c1", "bigint")
    with pytest.raises(InconsistentColumns):
        s.column("c3", "boolean")
    with pytest.raises(InconsistentColumns):
        SchemaBuilder().build()


def test_build_is_strict(spark):
    with pytest.raises(Exception):
        table.build(spark, T.StructType.fromDDL("c1 int"), [("x",)]).collect()
    assert table.rows_to_table(spark, []) is None
    assert table.rows_to_table(spark, [Row(a=1)]).collect() == [Row(a=1)]
    assert table.empty_like(spark.range(3)).schema == spark.range(1).schema


def test_group_concat_counts_null_groups(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(GROUP)], "i int, c1 int, c2 string")
    got = aggs.group_by(df, ["c1"], {"n": aggs.count_rows(), "g": aggs.group_concat("c2", ["i"])})
    assert {(r.c1, r.n, r.g) for r in got.collect()} == {(1, 2, "ss,null"), (-1, 1, "null"), (None, 1, "dd")}
    assert {r.s for r in got.select(scalar.substr0("g", 0, 2).alias("s")).collect()} == {"ss", "nu", "dd"}


def test_over_row_number(spark):
    df = spark.createDataFrame(OVER, "c1 int, c2 string")
    got = {(r.c1, r.c2, r.rn) for r in over.over(df, ["c1"], ["c2"], {"rn": F.row_number()}).collect()}
    assert got == {(1, "cc", 1), (1, "ss", 2), (-1, None, 1), (None, "dd", 1)}


def test_null_safe_joins(spark):
    a, b = spark.createDataFrame(OVER, "c1 int, c2 string"), spark.createDataFrame(RIGHT, "c3 int, c4 string")
    names = {"c3": "t2_c1", "c4": "t2_c2"}
    assert joins.left(a, b, [("c1", "c3")], names).count() == 6
    assert joins.inner(a, b, [("c1", "c3")], names).count() == 5
    assert joins.full(a, b, [("c1", "c3")], names).count() == 7
    assert joins.right(a, b, [("c1", "c3")], names).count() == 6
    assert joins.inner(a, b, [("c1", "c3")], names, null_safe=False).count() == 4
    assert joins.semi(a, b, [("c1", "c3")]).count() == 3 and joins.anti(a, b, [("c1", "c3")]).count() == 1
    assert joins.inner(a, b, [("c1", "c3")], names, extra="c2 = t2_c2").count() == 1
    with pytest.raises(ColumnNameConflict):
        joins.inner(a, a.withColumnRenamed("c1", "k"), [("c1", "k")])
    with pytest.raises(ColumnNotExists):
        joins.inner(a, b, [("c9", "c3")])


def test_as_of_takes_latest_before(spark):
    l = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 4)], "k string, t int")
    r = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("b", 10, "z"), (None, 2, "n")], "k2 string, t2 int, v string")
    got = {(x.k, x.t, x.v) for x in joins.as_of(l, r, "t", "t2", [("k", "k2")], ["v"]).collect()}
    assert got == {("a", 5, "y"), ("a", 1, "x"), ("b", 9, None), (None, 4, "n")}


def test_sums_and_averages_of_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, None)], "k int, v int")
    got = {r.k: (r.s, r.d, r.a) for r in aggs.group_by(df, ["k"], {"s": aggs.sum0("v"), "d": aggs.sum0_double("v"), "a": aggs.avg_all("v")}).collect()}
    assert got == {1: (1, 1.0, 0.5), 2: (0, 0.0, 0.0)}
    assert math.isnan(df.filter("false").agg(aggs.avg_all("v").alias("a")).collect()[0].a)


def test_top_n_breaks_ties_as_told(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 3, 3), ("a", 1, 2), ("b", 9, 1)], "k string, v int, id int")
    got = [(r.k, r.id, r.r) for r in aggs.top_n(df, 2, [F.desc("v"), F.desc("id")], ["k"], "r").orderBy("k", "r").collect()]
    assert got == [("a", 3, 1), ("a", 1, 2), ("b", 1, 1)]
    assert [r.id for r in aggs.top_n(df, 1, [F.desc("v")]).collect()] == [1]


def test_selects(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, s string")
    assert [r.id for r in table.select(df, {"id2": F.col("id") * 2}, True, F.col("s").isNotNull()).collect()] == [1, 3]
    assert [(r.id, r.w) for r in table.flat_select(df, F.split("s", " "), "w", {"id": F.col("id")}).collect()] == [(1, "a"), (1, "b"), (3, "")]
    with pytest.raises(ColumnNameConflict):
        table.add_columns(df, {"s": F.lit(1)})
    with pytest.raises(ColumnNotExists):
        table.project(df, "nope")
    assert table.union_all([]) is None and table.union_all([df, df]).count() == 6
    assert table.append(df, df.select("s", "id")).count() == 6
    assert table.rehash(df, "id", partitions=3).rdd.getNumPartitions() == 3 and table.rebalance(df, 2).count() == 3


def test_callables(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, v int")
    out = T.StructType.fromDDL("k int, w int")
    assert {(r.k, r.w) for r in table.select_rows(df, lambda r: (r.k, r.v + 1) if r.v > 5 else None, out).collect()} == {(1, 11), (1, 21)}
    assert table.flat_rows(df, lambda r: [(r.k, i) for i in range(r.v // 10)], out).count() == 3
    assert {tuple(r) for r in aggs.group_rows(df, ["k"], lambda g: (int(g.k.iloc[0]), int(g.v.sum())) if len(g) > 1 else None, out).collect()} == {(1, 30)}
    ranked = over.over_rows(df, ["k"], ["v"], lambda g: pd.DataFrame({"n": range(1, len(g) + 1)}), T.StructType.fromDDL("n long"))
    assert {tuple(r) for r in ranked.collect()} == {(1, 10, 1), (1, 20, 2), (2, 5, 1)}


FX5 = [("A", t) for t in (3, 10, 10, 13, 23, 24)] + [("B", t) for t in (103, 2, 301, 302, 303)]


def _at(spark, rows):
    return spark.createDataFrame(rows, "k string, ms long").withColumn("ts", F.timestamp_millis("ms"))


def test_sliding_windows(spark):
    df = _at(spark, FX5)
    got = windows.slide(df, 10, 5, ["k"], "ts", {"n": F.count(F.lit(1))}, windows.first_ms(df, "ts"))
    assert {(r.k, r.window_start, r.n) for r in got.collect()} == {
        ("A", 0, 1), ("A", 5, 3), ("A", 10, 3), ("A", 15, 2), ("A", 20, 2),
        ("B", 0, 1), ("B", 95, 1), ("B", 100, 1), ("B", 295, 3), ("B", 300, 3),
    }
    with pytest.raises(ValueError):
        windows.slide(df, 5, 10, ["k"], "ts", {"n": F.count(F.lit(1))})
    assert windows.tumble(df, 10, ["k"], "ts", {"n": F.count(F.lit(1))}).count() == 6


def test_session_splits_at_exactly_the_timeout(spark):
    df = _at(spark, [("A", t) for t in (3, 10, 10, 13, 23)] + [("B", 103)])
    got = {(r.k, r.window_start, r.window_end, r.n) for r in windows.session(df, 10, ["k"], "ts", {"n": F.count(F.lit(1))}).collect()}
    assert got == {("A", 3, 14, 4), ("A", 23, 24, 1), ("B", 103, 104, 1)}


def test_duration_and_size_frames(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 5, 6, 8, 8, 8)], "k string, ts long")
    got = sorted((r.ts, r.n) for r in over.duration_over(df, ["k"], "ts", 3, {"n": F.count(F.lit(1))}).collect())
    assert got == [(0, 3), (1, 3), (2, 2), (3, 2), (5, 2), (6, 4), (8, 3), (8, 3), (8, 3)]
    assert sorted(r.n for r in over.rows_over(df, ["k"], ["ts"], 4, {"n": F.count(F.lit(1))}).collect()) == [1, 2, 3] + [4] * 6


def test_scalars(spark):
    df = spark.createDataFrame([("2021-08-19 23:10:20 EDT", "xxabcxx", -1)], "d string, s string, n long")
    r = df.select(
        scalar.parse_date_ms("d").alias("ms"), scalar.trim_char("s", "x").alias("t"), scalar.ltrim_char("s", "x").alias("l"), scalar.rtrim_char("s", "x").alias("r"),
        scalar.substr0("s", 2, 5).alias("sub"), scalar.substr0("s", 4).alias("rest"), scalar.floor_to("n", 10).alias("f"),
        scalar.format_date_ms(F.lit(0)).alias("z"), scalar.parse_text(F.lit(" 12 "), "bigint").alias("p"), scalar.parse_text(F.lit("x"), "int", strict=False).alias("q"),
        scalar.to_decimal(F.lit("1.5"), 2).cast("string").alias("dec"), scalar.to_double(F.lit("1.5")).alias("dbl"), scalar.to_int(F.lit("7")).alias("i"), scalar.to_str(F.lit(7)).alias("st"), scalar.to_long(F.lit(7)).alias("lo"),
    ).collect()[0]
    assert (r.ms, r.t, r.l, r.r, r["sub"], r.rest, r.f, r.z, r.p, r.q) == (1629429020000, "abc", "abcxx", "xxabc", "abc", "cxx", -10, "1970-01-01 00:00:00", 12, None)
    assert (r.dec, r.dbl, r.i, r.st, r.lo) == ("1.50", 1.5, 7, "7", 7)
    with pytest.raises(Exception):
        df.select(scalar.parse_text(F.lit("x"), "int")).collect()


def test_values_survive_parquet(spark, tmp_path):
    rows = [("1L", 1), ("s中文d", 2), ("", 3), (None, None)] + [(str(i), i) for i in range(6500)]
    spark.createDataFrame(rows, "str string, long long").write.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect()), key=repr) == sorted(rows, key=repr)
    big = spark.createDataFrame([("9" * 75 + ".123",)], "s string")
    with pytest.raises(Exception):  # more than 38 digits stay text
        big.select(scalar.to_decimal("s", 3)).collect()


def test_arrow_round_trip(spark):
    df = spark.createDataFrame([("1L", 1), (None, None)], "str string, long long")
    back = table.deserialize(spark, table.serialize(df))
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_windows_by_callables(spark):
    df = _at(spark, FX5)
    out = T.StructType.fromDDL("k string, window_start long, n long")
    one = lambda w, rows: [(rows.k.iloc[0], w[0], len(rows))]
    got = {tuple(r) for r in windows.slide_rows(df, 10, 5, ["k"], "ts", one, out, 2).collect()}
    assert got == {(r.k, r.window_start, r.n) for r in windows.slide(df, 10, 5, ["k"], "ts", {"n": F.count(F.lit(1))}, 2).collect()}
    each = lambda w, rows: [(k, w[1], 1) for k in rows.k]
    assert windows.slide_rows(df, 10, 10, ["k"], "ts", each, out).count() == len(FX5)
    s = _at(spark, [("A", t) for t in (3, 10, 10, 13, 23)] + [("B", 103)])
    assert {tuple(r) for r in windows.session_rows(s, 10, ["k"], "ts", one, out).collect()} == {("A", 3, 4), ("A", 23, 1), ("B", 103, 1)}


def test_latest_partition(spark, tmp_path):
    spark.createDataFrame([(1, 20240101), (2, 20240102), (3, 20240102)], "v int, pt int").write.partitionBy("pt").parquet(str(tmp_path / "p"))
    assert {r.v for r in latest_partition(spark, str(tmp_path / "p"), "pt").collect()} == {2, 3}
