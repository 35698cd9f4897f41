"""Registered queries over the driver tables, each with DuckDB SQL of the same result.

Times are epoch milliseconds and money integer cents, so both sides add exact numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relstream.functions import scalar
from relstream.operators import aggs, joins, over, table, windows
from relstream.plans.book import EVENTS as _EV
from relstream.plans.book import HOUR, ORACLES, QUERIES, query
from relstream.plans.book import events as _events
from relstream.sources.tables import load

__all__ = ["ORACLES", "QUERIES"]


# ---- projections and filters -------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND value > 50 AND user_id BETWEEN 10 AND 100")
def filter_events(spark, sf):
    return table.project(table.where(load(spark, sf, "events"), "event_type = 'click' and value > 50 and user_id between 10 and 100"), "event_id", "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net_cents FROM lineitem")
def select_computed(spark, sf):
    return table.select(load(spark, sf, "lineitem"), {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"), "net_cents": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")})


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority FROM orders WHERE o_orderstatus <> 'O'")
def select_null_drops_row(spark, sf):
    return table.select(load(spark, sf, "orders"), {"o_orderkey": F.col("o_orderkey"), "priority": F.upper("o_orderpriority")}, keep=F.col("o_orderstatus") != "O")


@query("SELECT n_name, n_regionkey FROM nation")
def project_cols(spark, sf):
    return table.project(load(spark, sf, "nation"), "n_name", "n_regionkey")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def project_negative(spark, sf):
    return table.project_negative(load(spark, sf, "part"), "p_retailprice", "no_such_column")


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def rename_cols(spark, sf):
    return table.rename(load(spark, sf, "region"), {"r_regionkey": "id", "r_name": "name"})


@query("SELECT *, c_nationkey % 5 AS bucket FROM customer")
def add_columns(spark, sf):
    return table.add_columns(load(spark, sf, "customer"), {"bucket": F.col("c_nationkey") % 5})


@query("SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS piece FROM orders")
def flat_select_pieces(spark, sf):
    return table.flat_select(load(spark, sf, "orders"), F.split("o_orderpriority", "-"), "piece", {"o_orderkey": F.col("o_orderkey")})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def union_all_tables(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return table.union_all([o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")])


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def rehash_counts(spark, sf):
    return aggs.group_by(table.rehash(load(spark, sf, "lineitem"), "l_suppkey"), ["l_suppkey"], {"n": aggs.count_rows()})


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def rebalance_preserves_rows(spark, sf):
    return table.rebalance(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT nullif(c_nationkey % 7, 3) AS k, count(*) AS n FROM customer GROUP BY 1")
def index_keys(spark, sf):
    return table.index(load(spark, sf, "customer").select(F.nullif(F.col("c_nationkey") % 7, F.lit(3)).alias("k")), "k")


# ---- joins -------------------------------------------------------------------------------------------------------

_PAIR = ("o_orderkey", "c_name")


def _customers(spark, sf):
    """All customers; those of nation 3 have a null key, those of nation 5 one that no order has."""
    own = F.when(F.col("c_nationkey") == 5, -F.col("c_custkey")).when(F.col("c_nationkey") != 3, F.col("c_custkey"))
    return load(spark, sf, "customer").select(own.alias("c_custkey"), "c_name", "c_nationkey")


def _orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey")


_C = "(SELECT CASE WHEN c_nationkey = 5 THEN -c_custkey WHEN c_nationkey <> 3 THEN c_custkey END AS c_custkey, c_name, c_nationkey FROM customer)"
_O = "(SELECT o_orderkey, o_custkey FROM orders)"


@query(f"SELECT * FROM {_O} o JOIN {_C} c ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_inner(spark, sf):
    return joins.inner(_orders(spark, sf), _customers(spark, sf), [("o_custkey", "c_custkey")])


@query(f"SELECT * FROM {_O} o LEFT JOIN {_C} c ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_left(spark, sf):
    return joins.left(_orders(spark, sf), _customers(spark, sf), [("o_custkey", "c_custkey")])


@query(f"SELECT * FROM {_O} o RIGHT JOIN {_C} c ON o_custkey IS NOT DISTINCT FROM c_custkey")
def join_right(spark, sf):
    return joins.right(_orders(spark, sf), _customers(spark, sf), [("o_custkey", "c_custkey")])


@query(f"SELECT * FROM {_O} o FULL JOIN {_C} c ON o_custkey = c_custkey")
def join_full(spark, sf):
    return joins.full(_orders(spark, sf), _customers(spark, sf), [("o_custkey", "c_custkey")])


@query("SELECT s_suppkey, nullif(s_nationkey % 10, 4) AS k, n_name AS nation FROM supplier JOIN nation ON nullif(s_nationkey % 10, 4) IS NOT DISTINCT FROM nullif(n_nationkey, 4)")
def join_null_safe(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey") % 10, F.lit(4)).alias("k"))
    n = load(spark, sf, "nation").select(F.nullif("n_nationkey", F.lit(4)).alias("nk"), "n_name")
    return joins.inner(s, n, [("k", "nk")], {"n_name": "nation"}).drop("nk")


@query("SELECT event_id, lo FROM events JOIN (SELECT n_nationkey * 20 AS lo, n_nationkey * 20 + 7 AS hi FROM nation) r ON user_id >= lo AND user_id < hi")
def join_theta_range(spark, sf):
    r = load(spark, sf, "nation").select((F.col("n_nationkey") * 20).alias("lo"), (F.col("n_nationkey") * 20 + 7).alias("hi"))
    return joins.in_range(load(spark, sf, "events").select("event_id", "user_id"), r, "user_id", "lo", "hi", 20).select("event_id", "lo")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_nationkey < p_size AND p_size < s_nationkey + 2 AND s_suppkey = p_partkey % 50")
def join_theta(spark, sf):
    s, p = load(spark, sf, "supplier"), load(spark, sf, "part")
    return joins.theta(s, p, "s_nationkey < p_size and p_size < s_nationkey + 2 and s_suppkey = p_partkey % 50").select("s_suppkey", "p_partkey")


@query("SELECT event_id, user_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey")
def join_dimension(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return joins.with_dimension(load(spark, sf, "events").select("event_id", "user_id"), c, [("user_id", "c_custkey")], {"c_mktsegment": "segment"}).drop("c_custkey")


@query(f"SELECT e.event_id, max(v.event_id) AS last_view FROM (SELECT * FROM {_EV} WHERE event_type = 'purchase') e LEFT JOIN (SELECT * FROM {_EV} WHERE event_type = 'view') v ON e.user_id = v.user_id AND v.ms <= e.ms GROUP BY e.event_id")
def join_as_of(spark, sf):
    e = _events(spark, sf)
    right = e.filter("event_type = 'view'").select("user_id", "ms", F.col("event_id").alias("last_view"))
    return joins.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ms"), right, "ms", "ms", [("user_id", "user_id")], ["last_view"]).select("event_id", "last_view")


@query(f"SELECT * FROM {_O} o WHERE EXISTS (SELECT 1 FROM {_C} c WHERE c_custkey = o_custkey)")
def semi(spark, sf):
    return joins.semi(_orders(spark, sf), _customers(spark, sf), [("o_custkey", "c_custkey")])


@query(f"SELECT * FROM {_O} o WHERE NOT EXISTS (SELECT 1 FROM {_C} c WHERE c_custkey = o_custkey)")
def anti(spark, sf):
    return joins.anti(_orders(spark, sf), _customers(spark, sf), [("o_custkey", "c_custkey")])


# ---- grouping ----------------------------------------------------------------------------------------------------


@query(f"SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM {_EV} GROUP BY event_type")
def group_count_sum(spark, sf):
    return aggs.group_by(_events(spark, sf), ["event_type"], {"n": aggs.count_rows(), "cents": aggs.sum0("cents")})


@query(f"SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN cents END), 0) AS BIGINT) AS spent FROM {_EV} GROUP BY user_id")
def group_sum0(spark, sf):
    return aggs.group_by(_events(spark, sf), ["user_id"], {"spent": aggs.sum0(F.when(F.col("event_type") == "purchase", F.col("cents")))})


@query("SELECT l_returnflag, round(CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) / count(*), 6) AS avg_all FROM lineitem GROUP BY l_returnflag")
def group_avg_all(spark, sf):
    return aggs.group_by(load(spark, sf, "lineitem"), ["l_returnflag"], {"avg_all": F.round(aggs.avg_all(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))), 6)})


@query("SELECT l_suppkey, max(l_extendedprice) AS most, min(l_quantity) AS least FROM lineitem GROUP BY l_suppkey")
def group_max(spark, sf):
    return aggs.group_by(load(spark, sf, "lineitem"), ["l_suppkey"], {"most": F.max("l_extendedprice"), "least": F.min("l_quantity")})


@query("SELECT user_id, string_agg(coalesce(nullif(event_type, 'view'), 'null'), ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def group_concat(spark, sf):
    return aggs.group_by(load(spark, sf, "events"), ["user_id"], {"types": aggs.group_concat(F.nullif("event_type", F.lit("view")), ["event_id"])})


@query("SELECT nullif(user_id % 4, 1) AS k, count(*) AS n FROM events GROUP BY 1")
def group_null_key(spark, sf):
    return aggs.group_by(load(spark, sf, "events").withColumn("k", F.nullif(F.col("user_id") % 4, F.lit(1))), ["k"], {"n": aggs.count_rows()})


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 70")
def group_having_drop(spark, sf):
    return aggs.group_by(load(spark, sf, "events"), ["user_id"], {"n": aggs.count_rows()}, "n > 70")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def group_multi_key(spark, sf):
    return aggs.group_by(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": aggs.count_rows(), "quantity": aggs.sum0("l_quantity")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(aggs.count_rows().alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return load(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(aggs.count_rows().alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, sf):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return load(spark, sf, "lineitem").groupingSets([[f], [s]], f, s).agg(aggs.count_rows().alias("n"))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct(spark, sf):
    return load(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT CASE WHEN s_acctbal > 0 THEN s_nationkey END FROM supplier")
def except_(spark, sf):
    s = load(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")))
    return load(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(s)


@query()
def approx_distinct(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


# ---- analytic windows --------------------------------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type NULLS FIRST, event_id) AS rn FROM events")
def over_row_number(spark, sf):
    return over.over(load(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_type", "event_id"], {"rn": F.row_number()}).select("event_id", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT event_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS running FROM {_EV}")
def over_running_sum(spark, sf):
    return over.over(_events(spark, sf).select("event_id", "user_id", "cents"), ["user_id"], ["event_id"], {"running": F.sum("cents")}).select("event_id", "running")


@query("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def over_lag_lead(spark, sf):
    return over.over(load(spark, sf, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], {"prev": F.lag("event_id"), "next": F.lead("event_id")}).drop("user_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def over_whole_partition(spark, sf):
    return over.over(load(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [], {"n": aggs.count_rows()}).select("event_id", "n")


@query("SELECT event_id, row_number() OVER (PARTITION BY nullif(user_id % 5, 2) ORDER BY nullif(event_type, 'click') NULLS FIRST, event_id) AS rn FROM events")
def over_nulls_first(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.nullif(F.col("user_id") % 5, F.lit(2)).alias("k"), F.nullif("event_type", F.lit("click")).alias("t"))
    return over.over(e, ["k"], ["t", "event_id"], {"rn": F.row_number()}).select("event_id", F.col("rn").cast("long").alias("rn"))


@query("SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)")
def over_ranks(spark, sf):
    e = over.over(load(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_type"], {"r": F.rank(), "d": F.dense_rank()})
    e = over.over(e, ["user_id"], ["event_id"], {"q": F.ntile(4)})
    return e.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("r", "d", "q")])


@query(f"SELECT event_type, event_id, cents, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cents DESC, event_id) AS rn FROM {_EV}) WHERE rn <= 20")
def topn_per_group(spark, sf):
    return aggs.top_n(_events(spark, sf).select("event_type", "event_id", "cents"), 20, [F.desc("cents"), F.asc("event_id")], ["event_type"], "rn")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def topn_global(spark, sf):
    return aggs.top_n(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 50, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])


# ---- time windows ------------------------------------------------------------------------------------------------


@query(f"SELECT user_id, ms // {HOUR} * {HOUR} AS window_start, ms // {HOUR} * {HOUR} + {HOUR} AS window_end, count(*) AS n FROM {_EV} GROUP BY ALL")
def tumble_count(spark, sf):
    return windows.tumble(_events(spark, sf), HOUR, ["user_id"], "ts", {"n": aggs.count_rows()})


_SLID = f"""(SELECT user_id, ws AS window_start, ws + {HOUR} AS window_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
FROM (SELECT *, (ms // {HOUR // 2} - k) * {HOUR // 2} AS ws FROM {_EV}, (VALUES (0), (1)) t(k))
WHERE ws >= (SELECT min(ms) // {HOUR} * {HOUR} FROM {_EV}) GROUP BY ALL)"""


def _slid(spark, sf):
    e = _events(spark, sf)
    return windows.slide(e, HOUR, HOUR // 2, ["user_id"], "ts", {"n": aggs.count_rows(), "cents": aggs.sum0("cents")}, windows.first_ms(e, "ts"))


@query(f"SELECT * FROM {_SLID}")
def slide_sum(spark, sf):
    return _slid(spark, sf)


@query(f"""SELECT window_start, rank, user_id, segment, n, cents FROM (
SELECT window_start, user_id, c_mktsegment AS segment, n, cents, row_number() OVER (PARTITION BY window_start ORDER BY cents DESC, user_id) AS rank
FROM {_SLID} s LEFT JOIN customer ON user_id = c_custkey) WHERE rank <= 100""")
def slide_top100(spark, sf):
    """Flagship: sales per user in hopping windows, enriched, the top 100 of each window."""
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    top = aggs.top_n(_slid(spark, sf), 100, [F.desc("cents"), F.asc("user_id")], ["window_start"], "rank")
    return joins.with_dimension(top, c, [("user_id", "c_custkey")], {"c_mktsegment": "segment"}).select("window_start", "rank", "user_id", "segment", "n", "cents")


def _session_sql(timeout: int, source: str = _EV) -> str:
    return f"""SELECT user_id, min(ms) AS window_start, max(ms) + 1 AS window_end, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM (
SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= {timeout} THEN 1 ELSE 0 END AS new FROM {source})) GROUP BY user_id, s"""


def _at_ms(e: DataFrame) -> DataFrame:
    return e.withColumn("ts", F.timestamp_millis("ms"))


@query(_session_sql(6 * HOUR))
def session_count(spark, sf):
    return windows.session(_at_ms(_events(spark, sf)), 6 * HOUR, ["user_id"], "ts", {"n": aggs.count_rows()})


@query(_session_sql(2 * HOUR, f"(SELECT event_id, user_id, ms // {HOUR} * {HOUR} AS ms FROM {_EV})"))
def session_equal_gap(spark, sf):
    """Times on whole hours, so that gaps equal the timeout often: these split."""
    e = _events(spark, sf).withColumn("ms", scalar.floor_to("ms", HOUR))
    return windows.session(_at_ms(e), 2 * HOUR, ["user_id"], "ts", {"n": aggs.count_rows()})


@query(f"SELECT event_id, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS cents FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN CURRENT ROW AND {24 * HOUR - 1} FOLLOWING)")
def over_by_duration(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ms", F.col("cents").alias("c"))
    return over.duration_over(e, ["user_id"], "ms", 24 * HOUR, {"n": aggs.count_rows(), "cents": F.sum("c")}).select("event_id", "n", "cents")


@query(f"SELECT event_id, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS cents FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def over_by_size(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ms", F.col("cents").alias("c"))
    return over.rows_over(e, ["user_id"], ["ms", "event_id"], 5, {"n": aggs.count_rows(), "cents": F.sum("c")}).select("event_id", "n", "cents")


@query(f"SELECT window_start, count(*) AS users, CAST(sum(n) AS BIGINT) AS n FROM {_SLID} GROUP BY window_start")
def chained_slide_session(spark, sf):
    """Sliding windows per user, then a second stage that gathers all users of a window."""
    return aggs.group_by(_slid(spark, sf), ["window_start"], {"users": aggs.count_rows(), "n": aggs.sum0("n")})


_ARRIVAL = f"(SELECT event_id, user_id, ms, max(ms) OVER (ORDER BY ms + (event_id * 7919 % 11) * 600000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM {_EV})"


@query(f"SELECT user_id, ms // {HOUR} * {HOUR} AS window_start, count(*) AS late FROM {_ARRIVAL} WHERE ms // {HOUR} * {HOUR} + {HOUR} <= clock GROUP BY ALL")
def late_rows_tumble(spark, sf):
    """Rows that arrive after their tumbling window has closed, per user and window.

    The clock is the running maximum over the arrival order. It is computed in three levels: rows within a second of
    arrival, seconds within an hour, and hours, so no task sorts more rows than arrive in a second or seconds than an hour
    has; only one number an hour meets in one task.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    e = _events(spark, sf).withColumn("at", F.col("ms") + (F.col("event_id") * 7919 % 11) * 600_000).withColumn("second", F.floor(F.col("at") / 1000))
    seconds = e.groupBy("second").agg(F.max("ms").alias("m")).withColumn("hour", F.floor(F.col("second") / 3600))
    hours = seconds.groupBy("hour").agg(F.max("m").alias("h")).select("hour", F.max("h").over(before(Window.orderBy("hour"))).alias("hours_past"))
    seconds = seconds.join(hours, "hour").withColumn("seconds_past", F.max("m").over(before(Window.partitionBy("hour").orderBy("second"))))
    e = e.join(seconds.select("second", F.greatest("hours_past", "seconds_past").alias("past")), "second")
    e = e.withColumn("own", F.max("ms").over(Window.partitionBy("second").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    late = e.withColumn("window_start", scalar.floor_to("ms", HOUR)).filter(F.col("window_start") + HOUR <= F.greatest("own", "past"))
    return aggs.group_by(late, ["user_id", "window_start"], {"late": aggs.count_rows()})


# ---- scalars -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, substring(p_name, 1, 3) AS head, substring(p_name, 4) AS tail FROM part")
def substr0(spark, sf):
    return load(spark, sf, "part").select("p_partkey", scalar.substr0("p_name", 0, 3).alias("head"), scalar.substr0("p_name", 3).alias("tail"))


@query("SELECT p_partkey, trim(p_brand, 'B') AS b, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '1') AS r FROM part")
def trim_char(spark, sf):
    return load(spark, sf, "part").select("p_partkey", scalar.trim_char("p_brand", "B").alias("b"), scalar.ltrim_char("p_brand", "B").alias("l"), scalar.rtrim_char("p_brand", "1").alias("r"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, epoch_us(date_trunc('second', o_orderdate)) // 1000 AS ms FROM orders")
def date_parse_format(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", scalar.format_date_ms(F.unix_millis("o_orderdate")).alias("text"))
    return o.withColumn("ms", scalar.parse_date_ms("text", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS s, CAST(p_size AS BIGINT) AS l, CAST(trim(' ' || p_size || ' ') AS INTEGER) AS i FROM part")
def casts(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", scalar.to_str("p_partkey").alias("s"), scalar.to_long("p_size").alias("l"), scalar.parse_text(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")), "int").alias("i"))


from relstream.plans import streams, surface  # noqa: E402, F401  (they register their queries)
