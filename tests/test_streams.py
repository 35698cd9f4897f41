"""Streams against their batch twins and fixtures; connectors."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.operators import aggs, joins, over, windows
from relstream.sources import jdbc, records
from relstream.sources.dimension import Dimension
from relstream.sources.insertable import InsertableStream
from relstream.streaming import run, stateful

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.LongType())])


def _stream(spark, tmp_path, batches, schema=SCHEMA):
    s = InsertableStream(spark, schema, str(tmp_path / "in"))
    for b in batches:
        for row in b:
            s.insert(*row)
        s.flush()
    return s.read()


def _all(spark, df, tmp_path, mode="append"):
    q = run.start(df, str(tmp_path / "cp"), name="out", mode=mode, available_now=True)
    run.compute([q])
    return [tuple(r) for r in spark.sql("select * from out").collect()]


def test_reorder_buffer_rule():
    rows = lambda *ts: [Row(ts=t) for t in ts]
    ready, held = stateful.release(rows(3, 3, 5), 5, "ts", 100)
    assert not ready
    ready, held = stateful.release(held + rows(100, 101), 101, "ts", 100)
    assert not ready
    ready, held = stateful.release(held + rows(105), 105, "ts", 100)
    assert [r.ts for r in ready] == [3, 3, 5]
    ready, held = stateful.release(held + rows(105, 109, 109), 109, "ts", 0)
    assert [r.ts for r in ready] == [100, 101, 105, 105, 109, 109] and not held


def test_reorder_stream(spark, tmp_path):
    df = _stream(spark, tmp_path, [[("a", 3), ("a", 5), ("a", 3)], [("a", 105)], [("a", 300)]])
    assert [r[1] for r in _all(spark, stateful.reorder(df, ["k"], "ts", 100), tmp_path)] == [3, 3, 5, 105]


FX5 = [("A", t) for t in (3, 10, 10, 13, 23, 24)] + [("B", t) for t in (103, 2, 301, 302, 303)]


def test_one_clock_sliding_windows(spark, tmp_path):
    w = stateful.CompatSlide(10, 5)
    fired = []
    for k, t in FX5:
        w = stateful.CompatSlide(10, 5, json.loads(json.dumps(w.state())))
        fired.append([(s, rows) for _, s, rows in w.add(k, t, t)])
    tables = [f for f in fired if f]
    assert tables == [
        [(0, [3])], [(5, [10, 10, 13]), (20, [23])], [(10, [10, 10, 13])], [(15, [24]), (100, [103])],
        [(0, [2])], [(20, [24]), (300, [301])], [(300, [302])], [(300, [303])],
    ]
    assert sum(len(r) for t in tables for _, r in t) == 15
    schema = T.StructType.fromDDL("clock string, k string, ts long, i long")
    df = _stream(spark, tmp_path, [[("c", k, t, i)] for i, (k, t) in enumerate(FX5[:5])], schema)
    got = [(r[2], json.loads(r[4])) for r in _all(spark, stateful.compat_slide(df, "clock", "k", "ts", "i", 10, 5), tmp_path)]
    assert got == [(0, [3]), (5, [10, 10, 13]), (20, [23])]


def test_rows_over_stream_equals_batch(spark, tmp_path):
    rows = [("a", t) for t in (1, 4, 9, 11)] + [("b", 2)]
    df = _stream(spark, tmp_path, [rows[:2], rows[2:]])
    got = _all(spark, stateful.rows_over(df, ["k"], ["ts"], 2, lambda h: (sum(r.ts for r in h),), "total long"), tmp_path)
    batch = over.rows_over(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts"], 2, {"total": F.sum("ts")})
    assert sorted(got) == sorted(tuple(r) for r in batch.collect())


def test_duration_over_stream_equals_batch(spark, tmp_path):
    rows = [("a", t) for t in (10, 1000, 2500, 2500, 9000)] + [("b", 400)]
    df = _stream(spark, tmp_path, [rows, [("a", 50_000)], [("a", 60_000)]]).withColumn("at", F.timestamp_millis("ts"))
    done = stateful.duration_over(df, ["k"], "ts", 2000, lambda h: (len(h),), "n long", "at")
    got = {(r[0], r[1], r[3]) for r in _all(spark, done, tmp_path)}
    batch = over.duration_over(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", 2000, {"n": F.count(F.lit(1))})
    assert {tuple(r) for r in batch.collect()} <= got


def test_late_rows(spark, tmp_path):
    df = _stream(spark, tmp_path, [[("a", 5), ("a", 25)], [("a", 7), ("a", 26)]])
    assert _all(spark, stateful.late_rows(df, ["k"], "ts", 10), tmp_path) == [("a", 7, 0)]


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = [("a", t) for t in (0, 400, 1500, 2600, 2601)] + [("b", 100)]
    df = _stream(spark, tmp_path, [rows[:3], rows[3:], [("z", 90_000)], [("z", 99_000)]]).withColumn("at", F.timestamp_millis("ts"))
    done = windows.slide(df.withWatermark("at", "0 seconds"), 1000, 500, ["k"], "at", {"n": F.count(F.lit(1))})
    got = {r for r in _all(spark, done, tmp_path) if r[0] != "z"}
    batch = windows.slide(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_millis("ts")), 1000, 500, ["k"], "at", {"n": F.count(F.lit(1))})
    assert got == {tuple(r) for r in batch.collect()}
    assert run.rows_of_state(spark, str(tmp_path / "cp")).count() > 0


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [("A", t) for t in (3, 10, 10, 13, 23)] + [("B", 103)]
    df = _stream(spark, tmp_path, [rows, [("z", 90_000)], [("z", 99_000)]]).withColumn("at", F.timestamp_millis("ts"))
    done = windows.session(df.withWatermark("at", "0 seconds"), 10, ["k"], "at", {"n": F.count(F.lit(1))})
    assert {r for r in _all(spark, done, tmp_path) if r[0] != "z"} == {("A", 3, 14, 4), ("A", 23, 24, 1), ("B", 103, 104, 1)}


def test_top_n_of_windows_with_dimension(spark, tmp_path):
    """Orders in hopping windows, joined to a dimension snapshot per batch, best sellers of each window."""
    schema = T.StructType.fromDDL("__time__ long, id long, commodity_id int, n int")
    rows = [(0, 1, 1, 3), (3000, 2, 3, 2), (50000, 3, 2, 1), (3599000, 4, 3, 1), (3600000, 5, 2, 1), (5399000, 6, 1, 5)]
    df = _stream(spark, tmp_path, [rows, [(90_000_000, 7, 9, 1)], [(99_000_000, 8, 9, 1)]], schema).withColumn("at", F.timestamp_millis("__time__"))
    slid = windows.slide(df.withWatermark("at", "2 seconds"), 3_600_000, 1_800_000, ["commodity_id"], "at", {"sold": F.sum("n")}, origin_ms=0)
    names = Dimension(lambda: spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, price int"))
    got = []

    def body(batch, _):
        top = aggs.top_n(batch, 100, [F.desc("sold"), F.desc("commodity_id")], ["window_start"], "rank")
        top = joins.with_dimension(top, names.current(), [("commodity_id", "id")])
        got.extend((r.window_start, r["rank"], r.commodity_id, r.sold, r.name) for r in top.collect())

    run.compute([run.for_each_batch(slid, body, str(tmp_path / "cp"), available_now=True)])
    assert [x[1:] for x in sorted(got) if x[0] == 0] == [(1, 3, 3, "c"), (2, 1, 3, "a"), (3, 2, 1, "b")]


def test_json_records_round_trip(spark):
    schema = T.StructType.fromDDL("v string, i int, b long, __time__ long, d double")
    rows = [("c1v1", 1, 2**63 - 1, 7000, 1.7976931348623157e308), (None, 2, -(2**63), 8000, 5e-324)]
    out = records.encode(spark.createDataFrame(rows, schema))
    sent = out.collect()
    assert [r.key for r in sent] == [7, 8] and '"v"' not in sent[1].value and "__time__" not in sent[0].value
    assert sorted(map(tuple, records.decode(out, schema).collect()), key=repr) == sorted(rows, key=repr)
    assert records.kafka_options("h:1", "t", 5, 9, streaming=False)["endingTimestamp"] == "9"
    logs = records.log_rows(spark.createDataFrame(rows, schema), "topic")
    assert "v" not in [r.contents for r in logs.collect()][1]
    back = records.from_log_rows(logs, T.StructType.fromDDL("v string, i int, __time__ long, __topic__ string"))
    assert {tuple(r) for r in back.collect()} == {("c1v1", 1, 7000, "topic"), (None, 2, 8000, "topic")}


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"n{i}", None if i == 3 else i * 1.5) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, name string, v double")
    jdbc.write(df, url, "t", column_types="name VARCHAR(100)")
    assert sorted(map(tuple, jdbc.read(spark, url, "t", key='"id"', partitions=3).collect())) == sorted(rows)
    assert jdbc.read(spark, url, query='SELECT * FROM t WHERE "v" IS NULL').collect()[0][2] is None
    jdbc.write(df.limit(1), url, "t", mode="overwrite")
    assert jdbc.read(spark, url, "t").count() == 1
    assert "LONGTEXT" in jdbc.create_statement("x", df.schema)
    jdbc.execute(spark, url, jdbc.create_statement("x", df.schema, {"string": "VARCHAR(100)"}).replace(" IF NOT EXISTS", ""))
    jdbc.execute(spark, url, jdbc.index_statement("x", ["id", "name"]))
    assert jdbc.read(spark, url, "x").count() == 0


def test_dimension_reloads_and_keeps_the_old_on_failure(spark):
    now, calls = [0.0], []

    def load():
        calls.append(1)
        if len(calls) == 2:
            raise OSError("gone")
        return spark.createDataFrame([(len(calls), "x"), (None, "n")], "id int, v string")

    d = Dimension(load, refresh_s=10, retry_s=1, clock=lambda: now[0])
    assert d.row(id=1).v == "x" and d.row(id=None).v == "n" and d.row(id=9) is None
    now[0] = 11
    assert d.row(id=1).v == "x" and d.failures == 1
    now[0] = 12.5
    assert d.row(id=3).v == "x" and len(calls) == 3


def test_metrics_listener(spark, tmp_path):
    m = run.Metrics()
    spark.streams.addListener(m)
    _all(spark, _stream(spark, tmp_path, [[("a", 1)], [("b", 2)]]), tmp_path)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(m)
    assert sum(b["rows"] for b in m.batches) == 2 and not m.failed


def test_insert_checks_arity(spark, tmp_path):
    with pytest.raises(Exception):
        InsertableStream(spark, SCHEMA, str(tmp_path)).insert("a")


def test_jdbc_of_the_driver_beside_executors_of_other_processes(tmp_path):
    """A database in the driver's memory is created, filled and read where executors can't see it."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.sql.warehouse.dir", {str(tmp_path / "wh")!r}).getOrCreate()
from relstream.sources import jdbc
url = "jdbc:derby:memory:cluster;create=true"
rows = [(i, f"n{{i}}", None if i == 3 else i * 1.5) for i in range(20)] + [(None, None, 1.0)]
df = spark.createDataFrame(rows, "ID int, NAME string, V double")
jdbc.prepare(spark, url, "T", df.schema, drop=True, types={{"string": "VARCHAR(100)"}}, exists=False)
jdbc.write(df, url, "T", batch=7)
key = lambda r: str(r)
for got in (jdbc.read(spark, url, "T", key="ID", partitions=3, fetch=4), jdbc.read(spark, url, "T"), jdbc.read(spark, url, query="SELECT * FROM T")):
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key)
jdbc.write(df.limit(1), url, "T", mode="overwrite")
assert jdbc.read(spark, url, "T", key="ID").count() == 1
print("whole")
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd=tmp_path, timeout=300)
    assert "whole" in done.stdout, done.stderr[-3000:]


class _Store:
    """A state store and its calls, as a processor sees them."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State(self, []))

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _State(self, None))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _State:
    def __init__(self, store, value):
        self.store, self.value = store, value

    def _called(self, value):
        self.store.calls += 1
        self.value = value

    def exists(self):
        return bool(self.value)

    def get(self):
        self.store.calls += 1
        return self.value

    def put(self, values):
        self._called(list(values))

    def update(self, value):
        self._called(value)

    def appendValue(self, value):
        self._called([*self.value, value])

    def appendList(self, values):
        self._called([*self.value, *values])

    def clear(self):
        self._called([])


@pytest.mark.parametrize("kind", ["duration", "windows"])
def test_state_is_asked_once_for_many_keys_and_rows(kind):
    """Rows and timers of a set of keys take a few round trips, not some for each row."""
    schema = T.StructType.fromDDL("k long, ts long")
    rows = [Row(k=k, ts=1000 + 7 * i + k) for i in range(50) for k in range(20)]
    late = Row(k=3, ts=5000)
    if kind == "duration":
        p = stateful.DurationOver(schema, "ts", 40, lambda held: (len(held),), ["n"], ["k"])
        want = {(r.k, r.ts, sum(o.k == r.k and 0 <= o.ts - r.ts < 40 for o in rows)) for r in rows}
    else:
        p = stateful.WindowRows(schema, "ts", 40, 20, lambda w, held: [(held[0].k, w[0], len(held))], ["k", "s", "n"], ["k"])
        starts = {(r.k, s) for r in rows for s in range(r.ts // 20 * 20 - 20, r.ts + 1, 20)}
        want = {(k, s, sum(o.k == k and s <= o.ts < s + 40 for o in rows)) for k, s in starts}
    store = _Store()
    p.init(store)
    got = list(p.handleInputRows((0,), iter([*rows, late]), None))
    for mark in (1200, 3000):
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, m=mark: m})()
        for at in sorted(t for t in store.timers if t <= mark):
            got += p.handleExpiredTimer((0,), clock, type("Info", (), {"getExpiryTimeInMs": lambda self, a=at: a})())
            store.timers.discard(at)
    assert sorted(map(tuple, got)) == sorted(want)
    assert min(store.timers) > 3000 and store.calls < 30


def test_a_batch_of_a_clock_is_not_held_as_row_objects():
    import tracemalloc

    p = stateful.CompatSlideProcessor("key", "ms", 10, 5, "seq", whole=True)
    p.init(_Store())
    n, seen = 20_000, 0
    tracemalloc.start()
    for r in p.handleInputRows(("c",), (Row(clock="c", key="k", ms=1000 * i, seq=n - i) for i in range(n)), None):
        seen += r.n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n - 1 and peak < 120 * n  # the first of the order is held; row objects take above 400 bytes each
