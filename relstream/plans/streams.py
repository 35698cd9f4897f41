"""Stream operators as registered queries: driver tables replayed in micro-batches and run to their end.

Rows come in time order where nothing else is said, whatever order their numbers have; where they do not, the batch or the place of a row follows from its
number, in Spark and in SQL alike.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Row
from pyspark.sql import functions as F

from relstream.operators import aggs, joins, windows
from relstream.plans.book import EVENTS, HOUR, events, query
from relstream.sources.dimension import Dimension
from relstream.sources.insertable import InsertableStream
from relstream.sources.tables import load
from relstream.streaming import run, stateful
from relstream.streaming.replay import Replay

DAY = 24 * HOUR
#: Rows behind all data that let event time pass it; they belong to no user.
ENDS = [Row(user_id=-1, event_id=-i, ms=m, ts=datetime.fromtimestamp(m / 1000, timezone.utc), cents=0) for i, m in ((1, 4_000_000_000_000), (2, 4_100_000_000_000))]
#: Three batches that rows of all times come in, by their number; the delay of the reorder buffer.
_MIXED = f"(SELECT *, event_id * 7919 % 3 AS b FROM {EVENTS})"
_CLOCKS = f"(SELECT user_id, b, max(ms) AS m FROM {_MIXED} GROUP BY ALL)"
DELAY = 3 * DAY
#: Sets of keys that share a call of a stateful operator: a replay's batches are large and meet nearly all keys.
SHARDS = 4096
#: Arrival up to 100 minutes behind the event, by its number.
_ARRIVED = f"(SELECT *, (ms + (event_id * 7919 % 11) * 600000) * 1000000 + event_id % 1000000 AS seq FROM {EVENTS})"


def _slim(spark, sf):
    return events(spark, sf).select("event_id", "user_id", "ms", F.timestamp_millis("ms").alias("ts"), "cents")


def _mixed(spark, sf):
    return _slim(spark, sf).withColumn("b", F.pmod(F.col("event_id") * 7919, F.lit(3)))


def _arrived(df):
    return df.withColumn("seq", (F.col("ms") + F.pmod(F.col("event_id") * 7919, F.lit(11)) * 600_000) * 1_000_000 + F.pmod("event_id", F.lit(1_000_000)))


_SLID = f"""(SELECT user_id, ws AS window_start, ws + {HOUR} AS window_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
FROM (SELECT *, (ms // {HOUR // 2} - k) * {HOUR // 2} AS ws FROM {EVENTS}, (VALUES (0), (1)) t(k)) GROUP BY ALL)"""


def _slid(replay, spark, sf):
    e = replay.stream(_slim(spark, sf), 3, order="ms", ends=ENDS).withWatermark("ts", "2 seconds")
    return windows.slide(e, HOUR, HOUR // 2, ["user_id"], "ts", {"n": aggs.count_rows(), "cents": aggs.sum0("cents")})


@query(f"SELECT * FROM {_SLID}")
def stream_slide(spark, sf):
    replay = Replay(spark)
    return replay.table(_slid(replay, spark, sf)).where("user_id >= 0")


@query(f"SELECT user_id, ms // {DAY} * {DAY} AS window_start, ms // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def stream_tumble(spark, sf):
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf), 3, order="ms", ends=ENDS).withWatermark("ts", "2 seconds")
    return replay.table(windows.tumble(e, DAY, ["user_id"], "ts", {"n": aggs.count_rows()})).where("user_id >= 0")


@query(f"""SELECT user_id, min(ms) AS window_start, max(ms) + 1 AS window_end, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM (
SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM {EVENTS})) GROUP BY user_id, s""")
def stream_session(spark, sf):
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf), 3, order="ms", ends=ENDS).withWatermark("ts", "2 seconds")
    return replay.table(windows.session(e, 6 * HOUR, ["user_id"], "ts", {"n": aggs.count_rows()})).where("user_id >= 0")


@query(f"""SELECT window_start, rank, user_id, segment, n, cents FROM (
SELECT window_start, user_id, c_mktsegment AS segment, n, cents, row_number() OVER (PARTITION BY window_start ORDER BY cents DESC, user_id) AS rank
FROM {_SLID} s LEFT JOIN customer ON user_id = c_custkey) WHERE rank <= 100""")
def stream_top100(spark, sf):
    """The flagship as a stream: a window's keys all come out in the batch in which event time passes its end, so a batch
    holds whole windows; of each the top 100 are joined to the dimension's snapshot of that batch.
    """
    replay = Replay(spark)
    names = Dimension(lambda: load(spark, sf, "customer").select("c_custkey", "c_mktsegment"))

    def best(batch):
        top = aggs.top_n(batch.where("user_id >= 0"), 100, [F.desc("cents"), F.asc("user_id")], ["window_start"], "rank")
        done = joins.with_dimension(top, names.current(), [("user_id", "c_custkey")], {"c_mktsegment": "segment"})
        return done.select("window_start", "rank", "user_id", "segment", "n", "cents")

    return replay.each_batch(_slid(replay, spark, sf), best, "window_start long, rank long, user_id long, segment string, n long, cents long")


@query(f"SELECT window_start, count(*) AS users, CAST(sum(n) AS BIGINT) AS n FROM {_SLID} GROUP BY window_start")
def stream_chained(spark, sf):
    """Sliding windows per user, then sessions over the windows' own times, which gather all users of a window: two chained
    stateful stages, each closed by event time.
    """
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf), 3, order="ms", ends=ENDS).withWatermark("ts", "2 seconds")
    slid = e.groupBy("user_id", F.window("ts", f"{HOUR} milliseconds", f"{HOUR // 2} milliseconds").alias("w")).agg(aggs.count_rows().alias("n"))
    slid = slid.select("w", "n", F.unix_millis("w.start").alias("window_start"))
    gathered = slid.groupBy("window_start", F.session_window(F.window_time("w"), "1 second")).agg(aggs.count_rows().alias("users"), F.sum("n").alias("n"))
    return replay.table(gathered.select("window_start", "users", "n")).where(F.col("window_start") < ENDS[0].ms - DAY)


@query(f"SELECT event_id, user_id, ms FROM {_MIXED} a WHERE EXISTS (SELECT 1 FROM {_CLOCKS} c WHERE c.user_id = a.user_id AND c.b >= a.b AND c.m - a.ms >= {DELAY})")
def stream_reorder(spark, sf):
    """What the reorder buffer has given out when all batches are in; newer rows are still held."""
    replay = Replay(spark)
    e = replay.stream(_mixed(spark, sf).select("event_id", "user_id", "ms", "b"), 3, batch="b")
    return replay.table(stateful.reorder(e, ["user_id"], "ms", DELAY))


@query(f"SELECT event_id, user_id, ms // {HOUR} * {HOUR} AS window_start FROM {_MIXED} a WHERE ms // {HOUR} * {HOUR} + {HOUR} <= (SELECT max(m) FROM {_CLOCKS} c WHERE c.user_id = a.user_id AND c.b < a.b)")
def stream_late_rows(spark, sf):
    replay = Replay(spark)
    e = replay.stream(_mixed(spark, sf).select("event_id", "user_id", "ms", "b"), 3, batch="b")
    return replay.table(stateful.late_rows(e, ["user_id"], "ms", HOUR)).select("event_id", "user_id", "window_start")


@query(f"SELECT event_id, user_id, ms FROM (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM {_ARRIVED}) WHERE newest IS NULL OR ms >= newest")
def stream_in_order(spark, sf):
    """Rows older than one of their key that came before them are dropped."""
    replay = Replay(spark)
    e = _arrived(_slim(spark, sf).select("event_id", "user_id", "ms"))
    return replay.table(stateful.in_order(replay.stream(e, 3, order="seq"), ["user_id"], "ms", "seq", shards=SHARDS)).select("event_id", "user_id", "ms")


@query(f"SELECT event_id, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS cents FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def stream_over_by_size(spark, sf):
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf).select("event_id", "user_id", "ms", F.col("cents").alias("c")), 3, order="ms")
    done = stateful.rows_over(e, ["user_id"], ["ms", "event_id"], 5, lambda rows: (len(rows), sum(r.c for r in rows)), "n long, cents long", shards=SHARDS)
    return replay.table(done).select("event_id", "n", "cents")


@query(f"SELECT event_id, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS cents FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN CURRENT ROW AND {DAY - 1} FOLLOWING)")
def stream_over_by_duration(spark, sf):
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf).withColumnRenamed("cents", "c"), 3, order="ms", ends=ENDS)
    done = stateful.duration_over(e, ["user_id"], "ms", DAY, lambda rows: (len(rows), sum(r.c or 0 for r in rows)), "n long, cents long", "ts", "2 seconds", shards=SHARDS)
    return replay.table(done).where("event_id >= 0").select("event_id", "n", "cents")


@query(f"SELECT user_id, ms // {DAY} * {DAY} AS window_start, cents % 3 AS kind, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def stream_window_rows(spark, sf):
    """A callable gives any number of rows for each window of a key."""
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf), 3, order="ms", ends=ENDS)

    def kinds(window, rows):
        met = [r.cents % 3 for r in rows]
        return [(rows[0].user_id, window[0], k, met.count(k)) for k in sorted(set(met))]

    done = stateful.window_rows(e, ["user_id"], "ms", DAY, DAY, kinds, "user_id long, window_start long, kind long, n long", "ts", "2 seconds", shards=SHARDS)
    return replay.table(done).where("user_id >= 0")


@query(f"SELECT user_id, ws AS window_start, max(ms) - min(ms) AS span FROM (SELECT *, (ms // {DAY // 2} - k) * {DAY // 2} AS ws FROM {EVENTS}, (VALUES (0), (1)) t(k)) GROUP BY ALL")
def stream_window_row(spark, sf):
    """A callable gives one row for each hopping window of a key."""
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf), 3, order="ms", ends=ENDS)
    span = lambda window, rows: [(rows[0].user_id, window[0], rows[-1].ms - rows[0].ms)]
    done = stateful.window_rows(e, ["user_id"], "ms", DAY, DAY // 2, span, "user_id long, window_start long, span long", "ts", "2 seconds", shards=SHARDS)
    return replay.table(done).where("user_id >= 0")


_SIZE, _SLIDE = 6 * HOUR, 3 * HOUR


@query(f"""WITH RECURSIVE r AS (SELECT event_type, user_id, ms, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS i FROM {_ARRIVED}),
w(event_type, i, start, alone, fired) AS (
    SELECT event_type, i, ms - ms % {_SIZE}, false, CAST(NULL AS BIGINT) FROM r WHERE i = 1
    UNION ALL
    SELECT w.event_type, r.i, CASE WHEN r.ms >= w.start + {_SIZE} THEN w.start + {_SLIDE} ELSE w.start END,
        r.ms < w.start OR r.ms >= w.start + {_SIZE + _SLIDE}, CASE WHEN r.ms >= w.start + {_SIZE} THEN w.start END
    FROM w JOIN r ON r.event_type = w.event_type AND r.i = w.i + 1),
placed AS (SELECT r.*, w.alone, w.fired FROM r JOIN w USING (event_type, i))
SELECT event_type AS clock, CAST(user_id AS VARCHAR) AS key, ms - ms % {_SIZE} AS window_start, CAST(1 AS BIGINT) AS n FROM placed WHERE alone
UNION ALL
SELECT f.event_type, CAST(p.user_id AS VARCHAR), f.fired, count(*) FROM placed f JOIN placed p ON p.event_type = f.event_type AND p.i < f.i AND NOT p.alone
    AND p.ms >= f.fired AND p.ms < f.fired + {_SIZE} WHERE f.fired IS NOT NULL GROUP BY f.event_type, f.i, f.fired, p.user_id""")
def stream_one_clock_slide(spark, sf):
    """One clock for all keys of an event type, rows one by one as they arrive: far jumps and late rows fire alone."""
    replay = Replay(spark)
    e = _arrived(events(spark, sf).select("event_id", "event_type", F.col("user_id").cast("string").alias("user"), "ms")).drop("event_id")
    done = stateful.compat_slide(replay.stream(e, 3, order="seq"), "event_type", "user", "ms", "seq", _SIZE, _SLIDE)
    return replay.table(done).select("clock", "key", "window_start", "n")


@query(f"SELECT user_id, ms // {HOUR} * {HOUR} AS window_start, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def stream_live_state(spark, sf):
    """The windows that a running query holds, read from its state."""
    replay = Replay(spark)
    e = replay.stream(_slim(spark, sf), 2, order="event_id")
    held = replay.state(e.groupBy("user_id", F.window("ts", f"{HOUR} milliseconds")).count())
    return held.select("key.user_id", F.unix_millis("key.window.start").alias("window_start"), F.col("value.count").alias("n"))


@query(f"SELECT v.event_id AS view, p.event_id AS purchase FROM {EVENTS} v JOIN {EVENTS} p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ms BETWEEN v.ms - {HOUR} AND v.ms + {12 * HOUR}")
def stream_interval_join(spark, sf):
    """Two streams, joined by key within an interval of event time."""
    replay = Replay(spark)
    e = events(spark, sf).select("event_id", "user_id", F.timestamp_millis("ms").alias("ts"), "event_type")
    side = lambda kind: replay.stream(e.where(F.col("event_type") == kind).drop("event_type"), 2, order="event_id").withWatermark("ts", "30 days")
    v = side("view").toDF("view", "viewer", "viewed")
    p = side("purchase").toDF("purchase", "buyer", "bought")
    return replay.table(joins.interval(v, p, [("viewer", "buyer")], "viewed", "bought", HOUR, 12 * HOUR).select("view", "purchase"))


@query("SELECT event_id, user_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_dimension(spark, sf):
    """Every batch is joined to the dimension's snapshot of the time."""
    replay = Replay(spark)
    names = Dimension(lambda: load(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    e = replay.stream(load(spark, sf, "events").select("event_id", "user_id"), 2, order="event_id")
    done = lambda b: joins.with_dimension(b, names.current(), [("user_id", "c_custkey")], {"c_mktsegment": "segment"}).drop("c_custkey")
    return replay.each_batch(e, done, "event_id long, user_id long, segment string")


@query("SELECT r_regionkey, r_name FROM region")
def stream_inserted(spark, sf):
    """Rows that a program inserts one by one."""
    replay = Replay(spark)
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    source = InsertableStream(spark, r.schema, f"{replay.folder}/inserted")
    for row in r.collect():  # a region table of a few rows, as a program would insert them
        source.insert(*row).flush()
    return replay.table(source.read())


@query(f"SELECT count(*) AS rows, max(ms) AS newest FROM {EVENTS}")
def stream_metrics(spark, sf):
    """What the listener has seen of a replay, beside the newest row that came out."""
    replay, metrics = Replay(spark), run.Metrics()
    spark.streams.addListener(metrics)
    try:
        out = replay.table(replay.stream(_slim(spark, sf).select("event_id", "ms"), 3, order="event_id"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(metrics)
    return out.agg(F.lit(sum(b["rows"] for b in metrics.batches)).cast("long").alias("rows"), F.max("ms").alias("newest"))
