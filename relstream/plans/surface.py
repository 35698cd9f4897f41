"""Sources, sinks, callables and the rest of the surface as registered queries over driver tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.functions import scalar
from relstream.operators import aggs, joins, over, table, windows
from relstream.plans.book import EVENTS, HOUR, events, query
from relstream.schema import SchemaBuilder
from relstream.session import shared_folder
from relstream.sources import jdbc, records
from relstream.sources.dimension import Dimension
from relstream.sources.tables import latest_partition, load

DAY = 24 * HOUR


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- tables ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 'ss'), (-1, NULL), (NULL, 'dd'), (1, '')) t(c1, c2)")
def table_build(spark, sf):
    return table.build(spark, SchemaBuilder().column("c1", "int").column("c2", "varchar").build(), [(1, "ss"), (-1, None), (None, "dd"), (1, "")])


@query("SELECT r_regionkey, r_name FROM region")
def table_from_rows(spark, sf):
    """A few collected rows to a table and, with their types, to bytes and back."""
    few = load(spark, sf, "region")
    rows = table.rows_to_table(spark, few.collect())
    return table.deserialize(spark, table.serialize(rows.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def table_append(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    more = load(spark, sf, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_nationkey"))
    return table.append(table.append(n, more), table.empty_like(n))


@query("SELECT event_id, user_id FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def index_rows(spark, sf):
    """All rows of one key from an index that lies in files sorted by it."""
    e = load(spark, sf, "events").select("event_id", "user_id")
    return table.Index(e, "user_id").store(_folder(spark, "index")).rows(e.agg(F.min("user_id")).first()[0])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_limit_offset(spark, sf):
    return table.order_by(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", limit=20, offset=10)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table.union_distinct([load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf, "supplier").select("s_nationkey")])


# ---- aggregates and scalars --------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS dev, count(*) FILTER (l_discount > 0.05) AS cheap,
quantile_cont(l_quantity, 0.5) AS middle, round(CAST(sum(l_quantity) AS DOUBLE), 2) AS total, min(l_shipdate) = max(l_shipdate) AS one_day FROM lineitem GROUP BY l_returnflag""")
def group_stats(spark, sf):
    return aggs.group_by(load(spark, sf, "lineitem"), ["l_returnflag"], {
        "dev": F.round(F.stddev_samp("l_quantity"), 6), "cheap": F.count_if(F.col("l_discount") > 0.05), "middle": F.percentile("l_quantity", 0.5),
        "total": F.round(aggs.sum0_double("l_quantity"), 2), "one_day": F.min("l_shipdate") == F.max("l_shipdate"),
    })


@query("SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def approx_distinct_bound(spark, sf):
    """Approximate distinct counts are within six standard errors (2 % each) of the exact ones."""
    parts = load(spark, sf, "lineitem").select("l_returnflag", "l_partkey").distinct()  # a sketch of distinct values is that of all
    found = parts.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count("l_partkey").alias("n"))
    return found.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) <= 0.12 * F.col("n")).alias("close"))


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS d, CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DECIMAL(38, 2)) / 100 AS DECIMAL(38, 2)) AS m FROM part")
def casts_wide(spark, sf):
    p = load(spark, sf, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    text = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return p.select("p_partkey", scalar.to_double("p_retailprice").alias("d"), scalar.to_decimal(text, 2).alias("m"))


@query("SELECT o_orderkey, epoch_us(date_trunc('second', o_orderdate)) // 1000 + 14400000 AS ms FROM orders")
def date_with_zone(spark, sf):
    """A date text with its zone is one instant, whatever the session's zone."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" -04:00"))
    return load(spark, sf, "orders").select("o_orderkey", scalar.parse_date_ms(text, "yyyy-MM-dd HH:mm:ss XXX").alias("ms"))


# ---- callables ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) % 2 = 0")
def callable_where(spark, sf):
    return table.where_rows(load(spark, sf, "part").select("p_partkey", "p_name"), lambda r: len(r.p_name) % 2 == 0)


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND length(n_name) > s_suppkey % 12")
def callable_join(spark, sf):
    """Keys match, then a callable decides on the joined row."""
    s, n = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), load(spark, sf, "nation").select("n_nationkey", "n_name")
    return joins.inner_rows(s, n, [("s_nationkey", "n_nationkey")], lambda r: len(r.n_name) > r.s_suppkey % 12).select("s_suppkey", "n_name")


@query("SELECT p_partkey AS k, p_size * 2 AS twice FROM part WHERE p_size > 10")
def callable_select(spark, sf):
    return table.select_rows(load(spark, sf, "part"), lambda r: (r.p_partkey, r.p_size * 2) if r.p_size > 10 else None, T.StructType.fromDDL("k long, twice int"))


@query("SELECT o_orderkey AS k, unnest(string_split(o_orderpriority, '-')) AS piece FROM orders WHERE o_orderstatus <> 'P'")
def callable_flat(spark, sf):
    split = lambda r: [(r.o_orderkey, p) for p in r.o_orderpriority.split("-")] if r.o_orderstatus != "P" else None
    return table.flat_rows(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), split, T.StructType.fromDDL("k long, piece string"))


@query(f"SELECT user_id, count(*) AS n, CAST(max(cents) AS BIGINT) AS most FROM {EVENTS} GROUP BY user_id HAVING count(*) > 5")
def callable_group(spark, sf):
    whole = lambda g: (int(g.user_id.iloc[0]), len(g), int(g.cents.max())) if len(g) > 5 else None
    return aggs.group_rows(events(spark, sf).select("user_id", "cents"), ["user_id"], whole, T.StructType.fromDDL("user_id long, n long, most long"))


@query(f"SELECT event_id, user_id, cents, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS running FROM {EVENTS}")
def callable_over(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "cents")
    return over.over_rows(e, ["user_id"], ["event_id"], lambda g: pd.DataFrame({"running": g.cents.cumsum()}), T.StructType.fromDDL("running long"))


@query(f"SELECT user_id, ws AS window_start, count(*) AS n FROM (SELECT *, (ms // {DAY // 2} - k) * {DAY // 2} AS ws FROM {EVENTS}, (VALUES (0), (1)) t(k)) WHERE ws >= (SELECT min(ms) // {DAY} * {DAY} FROM {EVENTS}) GROUP BY ALL")
def callable_slide(spark, sf):
    e = events(spark, sf).select("user_id", "ts")
    one = lambda w, rows: [(int(rows.user_id.iloc[0]), w[0], len(rows))]
    return windows.slide_rows(e, DAY, DAY // 2, ["user_id"], "ts", one, T.StructType.fromDDL("user_id long, window_start long, n long"), windows.first_ms(e, "ts"))


@query(f"""SELECT user_id, min(ms) AS window_start, max(ms) + 1 AS window_end, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM (
SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM {EVENTS})) GROUP BY user_id, s""")
def callable_session(spark, sf):
    one = lambda w, rows: [(int(rows.user_id.iloc[0]), *w, len(rows))]
    return windows.session_rows(events(spark, sf).select("user_id", "ts"), 6 * HOUR, ["user_id"], "ts", one, T.StructType.fromDDL("user_id long, window_start long, window_end long, n long"))


# ---- sources and sinks -------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def jdbc_round_trip(spark, sf):
    """A table created, filled and read in key ranges over JDBC, in a database of this process."""
    url = f"jdbc:derby:memory:r{uuid.uuid4().hex};create=true"
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("NAME"), F.col("n_regionkey").alias("REGION"))
    jdbc.prepare(spark, url, "NATION", n.schema, [["REGION"]], drop=True, types={"string": "VARCHAR(100)"}, exists=False)
    jdbc.write(n, url, "NATION")
    return jdbc.read(spark, url, "NATION", key="ID", partitions=3).toDF("id", "name", "region")


_RECORD = SchemaBuilder().column("__time__", "bigint").column("event_id", "bigint").column("event_type", "varchar").column("cents", "bigint").build()


def _records(spark, sf):
    return events(spark, sf).select((F.floor(F.col("ms") / 1000) * 1000).alias("__time__"), "event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), "cents")


@query(f"SELECT ms // 1000 * 1000 AS __time__, event_id, nullif(event_type, 'view') AS event_type, cents FROM {EVENTS}")
def queue_codec(spark, sf):
    """Rows as queue messages, with keys of four bytes, and back."""
    return records.decode(records.messages(_records(spark, sf)), _RECORD)


@query(f"SELECT ms // 1000 * 1000 AS __time__, event_id, nullif(event_type, 'view') AS event_type, cents, 'events' AS __topic__ FROM {EVENTS}")
def log_codec(spark, sf):
    """Rows as log-service items and back."""
    return records.from_log_rows(records.log_rows(_records(spark, sf), "events"), T.StructType([*_RECORD.fields, T.StructField("__topic__", T.StringType())]))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = (SELECT max(l_returnflag) FROM lineitem)")
def partition_latest(spark, sf):
    folder = _folder(spark, "partitions")
    load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").write.partitionBy("l_returnflag").parquet(folder)
    return latest_partition(spark, folder, "l_returnflag")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def dimension_rows(spark, sf):
    return Dimension(lambda: load(spark, sf, "customer").select("c_custkey", "c_nationkey")).rows(c_nationkey=7)
