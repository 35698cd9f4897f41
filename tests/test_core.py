"""Rules of the core that fixtures and driver tables do not show."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.operators import aggs, joins, table, windows
from relstream.schema import ColumnNameConflict
from relstream.sources import jdbc, records
from relstream.streaming import run, stateful
from relstream.streaming.replay import Replay


def test_queue_keys_are_four_bytes(spark):
    schema = T.StructType.fromDDL("__time__ long, v string")
    rows = [(1_700_000_000_000, "a"), (0, None), (-5000, "b")]
    sent = records.messages(spark.createDataFrame(rows, schema))
    assert sorted(bytes(r.key).hex() for r in sent.collect()) == ["00000000", "6553f100", "fffffffb"]
    assert sorted(map(tuple, records.decode(sent, schema).collect()), key=repr) == sorted(rows, key=repr)
    peer = spark.createDataFrame([(bytearray.fromhex("6553f100"), '{"v":"x"}'), (bytearray(b"123"), "{}"), (None, "{}")], "key binary, value string")
    assert {tuple(r) for r in records.decode(peer, schema).collect()} == {(1_700_000_000_000, "x"), (None, None)}


def test_sums_of_fractions(spark):
    df = spark.createDataFrame([(0.7,), (0.6,), (None,)], "v double")
    assert df.agg(aggs.sum0("v")).first()[0] == 1 and df.agg(aggs.sum0(F.col("v").cast("decimal(10,1)"))).first()[0] == 1
    assert df.limit(0).agg(aggs.sum0("v")).first()[0] == 0


def test_names_of_callers_survive(spark):
    names = ["_rank", "_bucket", "_bucket_r", "_first", "_last", "_ws", "_w", "_ms", "_new", "_s"]
    df = spark.createDataFrame([(1, 5, *names)], ", ".join(["k int", "v int", *(f"{n} string" for n in names)])).withColumn("ts", F.timestamp_millis(F.lit(5)))
    assert aggs.top_n(df, 1, [F.desc("v")], ["k"]).columns == df.columns and aggs.top_n(df, 1, [F.desc("v")], ["k"]).first()._rank == "_rank"
    r = spark.createDataFrame([(0, 9)], "lo int, hi int")
    assert joins.in_range(df, r, "v", "lo", "hi", 4).first()._bucket == "_bucket"
    one = lambda w, rows: [tuple(rows[names].iloc[0])]
    out = T.StructType([T.StructField(n, T.StringType()) for n in names])
    for got in (windows.slide_rows(df, 10, 10, ["k"], "ts", one, out), windows.session_rows(df, 10, ["k"], "ts", one, out)):
        assert tuple(got.first()) == tuple(names)
    assert windows.session(df, 10, ["_first"], "ts", {"_last": F.max("v")}).first()._last == 5


def test_names_differ_by_more_than_case(spark):
    with pytest.raises(ColumnNameConflict):
        table.add_columns(spark.createDataFrame([(1,)], "a int"), {"A": F.lit(2)})


@pytest.mark.parametrize(("size", "slide"), [(10, 5), (10, 4), (7, 7), (9, 2)])
def test_origins_are_one_plan(spark, size, slide):
    df = spark.createDataFrame([(k, t) for k in "ab" for t in (13, 20, 20, 29, 44)], "k string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    want = {tuple(r) for r in windows.slide(df, size, slide, ["k"], "ts", {"n": aggs.count_rows()}, 13).collect()}
    lazy = windows.slide(df, size, slide, ["k"], "ts", {"n": aggs.count_rows()}, windows.first_ms(df, "ts"))
    assert {tuple(r) for r in lazy.collect()} == want and "Subquery" in lazy._jdf.queryExecution().executedPlan().toString()
    rows = lambda w, g: [(g.k.iloc[0], *w, len(g))]
    assert {tuple(r) for r in windows.slide_rows(df, size, slide, ["k"], "ts", rows, T.StructType.fromDDL("k string, s long, e long, n long"), 13).collect()} == want


def test_callables_see_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "k long, s string")
    got = table.select_rows(df, lambda r: (r.k, r.s is None), T.StructType.fromDDL("k long, none boolean")).collect()
    assert {tuple(r) for r in got} == {(1, True), (None, False)}
    assert table.flat_rows(df, lambda r: None, T.StructType.fromDDL("k long")).count() == 0


def test_index_finds_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "n"), (1, "b")], "k int, v string")
    for own in (table.Index(df, "k"), table.Index(df, "k").store(str(tmp_path / "i"))):
        assert {r.v for r in own.rows(1).collect()} == {"a", "b"} and own.row(None).v == "n" and own.row(7) is None


def test_compute_notices_any_failure(spark, tmp_path):
    source = spark.readStream.format("rate").option("rowsPerSecond", 5).load()

    def fail(batch, i):
        raise ValueError("broken body")

    first = run.for_each_batch(source, lambda b, i: None, str(tmp_path / "a"))
    second = run.for_each_batch(source, fail, str(tmp_path / "b"))
    with pytest.raises(Exception, match="broken body"):
        run.compute([first, second], seconds=60)
    assert not first.isActive and not second.isActive
    third = run.for_each_batch(source, lambda b, i: None, str(tmp_path / "c"))
    run.compute([third], seconds=1)
    assert third.isActive
    third.stop()


def test_idle_clocks_go_on(spark, tmp_path):
    w = stateful.CompatSlide(10, 5)
    for t in (1, 7, 12):
        w.add("a", t, t)
    assert [(s, r) for _, s, r in w.drain()] == [(5, [7, 12]), (10, [12])] and not w.rows
    replay = Replay(spark)
    e = replay.stream(spark.createDataFrame([("c", "a", t) for t in (1, 7, 8)], "clock string, k string, ts long"), 1, order="ts")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = run.start(stateful.compat_slide(e, "clock", "k", "ts", "ts", 10, 5, idle_ms=1000), str(tmp_path / "cp"), name="idle_out")
    for _ in range(60):
        if spark.table("idle_out").count() == 2:
            break
        q.awaitTermination(1)
    q.stop()
    assert {(r.window_start, r.n) for r in spark.table("idle_out").collect()} == {(0, 3), (5, 2)}


def test_windows_of_rows_by_slides():
    for size, slide in ((10, 5), (10, 4), (9, 2), (7, 7)):
        own = stateful.WindowRows(None, "ts", size, slide, None, [])
        for t in range(0, 40):
            assert list(own._starts(t)) == [s for s in range(-40, 41, 1) if s % slide == 0 and s <= t < s + size]


def test_sinks_are_prepared(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(1, "a")], "ID int, NAME string")
    for _ in range(2):  # the second time the table is there and is dropped
        jdbc.prepare(spark, url, "T", df.schema, [["ID"], ["NAME", "ID"]], drop=True, types={"string": "VARCHAR(10)"}, exists=False)
        jdbc.write(df, url, "T")
    assert jdbc.read(spark, url, "T").count() == 1
    with pytest.raises(Exception):
        jdbc.execute(spark, url, "NO STATEMENT", retries=1, wait_s=0.01)


def test_union_and_order(spark):
    df = spark.createDataFrame([(2,), (None,), (1,), (2,)], "v int")
    assert table.union_distinct([df, df]).count() == 3 and table.union_distinct([]) is None
    assert [r.v for r in table.order_by(df, "v", limit=2, offset=1).collect()] == [1, 2]
    assert isinstance(table.order_by(df, F.desc("v")).first(), Row)


def test_callable_windows_cut_groups_out_of_whole_batches(spark):
    """Groups of one row and of several Arrow batches, null keys, nulls beside large numbers; no call of the worker for each group."""
    rows = [("a", t) for t in range(0, 50)] + [(None, t) for t in (3, 100, 101)] + [("b", 7)]
    df = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_millis("t").alias("ts"))
    out = T.StructType.fromDDL("k string, s long, e long, n long, big long")
    one = lambda w, g: [(g.k.iloc[0], *w, len(g), None if g.k.iloc[0] is None else 2**62 + 1)] if g.ts.is_monotonic_increasing else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        slid, met = windows.slide_rows(df, 100, 100, ["k"], "ts", one, out), windows.session_rows(df, 10, ["k"], "ts", one, out)
        assert {tuple(r) for r in slid.collect()} == {("a", 0, 100, 50, 2**62 + 1), ("b", 0, 100, 1, 2**62 + 1), (None, 0, 100, 1, None), (None, 100, 200, 2, None)}
        assert {tuple(r) for r in met.collect()} == {("a", 0, 50, 50, 2**62 + 1), ("b", 7, 8, 1, 2**62 + 1), (None, 3, 4, 1, None), (None, 100, 102, 2, None)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (slid, met)]
    assert all("MapInPandas" in p and "FlatMapGroups" not in p for p in plans)
