"""The registered time-series queries over the driver's tables, with DuckDB oracles.

Views: events are non-aligned series (device user_id, one series for each
event_type) and aligned rows (value, event_type, props); lineitem is a set of
series with repeated times (device l_suppkey, series l_returnflag); orders are
aligned rows by o_custkey. Times are microseconds since 1970.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs, scalars
from tidemark.functions.predicates import Filter, time_between, time_eq, time_gt, time_gteq, time_lt, time_lteq, value_eq, value_gt, value_lt
from tidemark.model import Category, Column, Compression, DataType, Encoding, TableSchema
from tidemark.operators import scan, stats
from tidemark.sources import catalog
from tidemark.sources.store import unpivoted

KINDS = ["click", "error", "purchase", "signup", "view"]
#: Bounds inside the events' times.
LOW, HIGH = 1_704_500_000_000_000, 1_706_000_000_000_000
PAGE, PER_CHUNK = 100, 4

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


# Views

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def _stamp(micros: int):
    """A bound as the tables store times, so that it reaches the scan."""
    return F.expr(f"timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=micros)}'")


def _pruned(df: DataFrame, stored: str, flt: Filter | None) -> DataFrame:
    """The rows whose stored time can pass the filter."""
    below = flt.time_only(F.col(stored), _stamp) if flt is not None else None
    return df if below is None else df.where(below)


def events(spark, sf_dir, flt: Filter | None = None) -> DataFrame:
    e = _pruned(_read(spark, sf_dir, "events"), "ts", flt)
    return e.select(F.col("user_id").alias("device"), F.col("event_type").alias("measurement"), _micros("ts").alias("time"), F.col("event_id").alias("seq"), "value")


def events_aligned(spark, sf_dir, flt: Filter | None = None) -> DataFrame:
    e = _pruned(_read(spark, sf_dir, "events"), "ts", flt)
    return e.select(F.col("user_id").alias("device"), _micros("ts").alias("time"), F.col("event_id").alias("seq"), "value", "event_type", "props")


def _leg(spark, sf_dir, kind: str, flt: Filter | None = None) -> DataFrame:
    return events(spark, sf_dir, flt).where(F.col("measurement") == kind).drop("measurement")


def orders_aligned(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("device"), _micros("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"), "o_totalprice", "o_orderstatus", "o_orderpriority")


def lineitem_series(spark, sf_dir) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("device"), F.col("l_returnflag").alias("measurement"), _micros("l_shipdate").alias("time"), F.col("l_extendedprice").alias("seq"), F.col("l_extendedprice").alias("value"))


_EV = "(SELECT user_id AS device, event_type AS measurement, epoch_us(ts) AS time, event_id AS seq, value FROM events)"
_LI = "(SELECT l_suppkey AS device, l_returnflag AS measurement, epoch_us(l_shipdate) AS time, l_extendedprice AS seq, l_extendedprice AS value FROM lineitem)"
_ORD = "(SELECT o_custkey AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, o_totalprice, o_orderstatus, o_orderpriority FROM orders)"


# Scans and filters of one series

@_query(f"SELECT device, time, seq, value AS click FROM {_EV} WHERE device = 7 AND measurement = 'click'")
def series_scan(spark, sf_dir):
    return scan.series(_leg(spark, sf_dir, "click").where("device = 7"), "click")


def _filtered(name: str, flt: Filter, condition: str, kind: str = "click") -> None:
    def run(spark, sf_dir):
        return scan.series(_leg(spark, sf_dir, kind, flt), kind, flt)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT device, time, seq, value AS {kind} FROM {_EV} WHERE measurement = '{kind}' AND ({condition})"


_filtered("time_gt", time_gt(LOW), f"time > {LOW}")
_filtered("time_gteq", time_gteq(LOW), f"time >= {LOW}")
_filtered("time_lt", time_lt(HIGH), f"time < {HIGH}")
_filtered("time_lteq", time_lteq(HIGH), f"time <= {HIGH}")
_filtered("time_between_incl", time_between(LOW, HIGH), f"time BETWEEN {LOW} AND {HIGH}")
_filtered("time_between_excl", time_between(LOW, HIGH, inclusive=False), f"time > {LOW} AND time < {HIGH}")
_filtered("value_gt", value_gt(50.0), "value > 50 AND NOT isnan(value)")
_filtered("value_lt", value_lt(10.0), "value < 10 AND NOT isnan(value)")
_filtered("filter_and", time_gteq(LOW) & value_gt(50.0), f"time >= {LOW} AND value > 50 AND NOT isnan(value)")
_filtered("filter_or", time_lt(LOW) | value_gt(90.0), f"time < {LOW} OR (value > 90 AND NOT isnan(value))")
_filtered("filter_not", ~(value_gt(50.0) | time_lt(LOW)), f"NOT (coalesce(value > 50 AND NOT isnan(value), false) OR time < {LOW})")
_filtered("filter_not_time", ~time_between(LOW, HIGH), f"NOT (time BETWEEN {LOW} AND {HIGH})")


@_query(f"SELECT e.device, e.time, e.seq, e.value AS view FROM {_EV} e WHERE measurement = 'view' AND time = (SELECT max(time) FROM {_EV} WHERE measurement = 'view')")
def time_eq_latest(spark, sf_dir):
    leg = _leg(spark, sf_dir, "view")
    return scan.series(leg, "view", time_eq(leg.agg(F.max("time")).first()[0] or 0))


@_query("SELECT l_suppkey AS device, epoch_us(l_shipdate) AS time, l_orderkey AS seq, l_quantity AS quantity FROM lineitem WHERE l_quantity = 25 AND NOT isnan(l_quantity)")
def value_eq_double(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    leg = li.select(F.col("l_suppkey").alias("device"), _micros("l_shipdate").alias("time"), F.col("l_orderkey").alias("seq"), F.col("l_quantity").alias("value"))
    return scan.series(leg, "quantity", value_eq(25.0))


@_query("SELECT l_suppkey AS device, epoch_us(l_shipdate) AS time, l_orderkey AS seq, l_linenumber AS linenumber FROM lineitem WHERE l_linenumber = 3")
def value_eq_int(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    leg = li.select(F.col("l_suppkey").alias("device"), _micros("l_shipdate").alias("time"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("value"))
    return scan.series(leg, "linenumber", value_eq(3))


@_query(f"SELECT device, time, seq, o_orderstatus FROM {_ORD} WHERE o_orderstatus = 'F'")
def value_eq_string(spark, sf_dir):
    return scan.aligned(orders_aligned(spark, sf_dir), ["o_orderstatus"], value_eq("F"))


#: Values with nulls and NaN put in, to hold predicates to two-valued logic.
_HOLED = "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL ELSE value END"


def _holed(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("device"), _micros("ts").alias("time"), F.col("event_id").alias("seq"), F.expr(_HOLED).alias("v"))


def _two_valued(name: str, flt: Filter, condition: str) -> None:
    def run(spark, sf_dir):
        return scan.aligned(_holed(spark, sf_dir), ["v"], flt).select("device", "time", "seq")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT device, time, seq FROM (SELECT user_id AS device, epoch_us(ts) AS time, event_id AS seq, {_HOLED} AS v FROM events) WHERE {condition}"


_GT = "coalesce(v > 20 AND NOT isnan(v), false)"
_two_valued("nan_value_gt", value_gt(20.0), _GT)
_two_valued("nan_not_value_gt", ~value_gt(20.0), f"NOT {_GT}")
_two_valued("nan_not_not_value_gt", ~~value_gt(20.0), _GT)
_two_valued("nan_mixed", (~value_gt(20.0) & time_gteq(LOW)) | value_lt(5.0), f"(NOT {_GT} AND time >= {LOW}) OR coalesce(v < 5 AND NOT isnan(v), false)")


# Merges

def _merge_sql(source: str, legs: list[str], names: list[str], where: str = "") -> str:
    """The merge as one aggregate over numbered repeats."""
    columns = ", ".join(f"max(value) FILTER (measurement = '{m}') AS \"{n}\"" for m, n in zip(legs, names))
    wanted = ", ".join(f"'{m}'" for m in legs)
    numbered = f"SELECT *, row_number() OVER (PARTITION BY device, time, measurement ORDER BY seq) AS occ FROM {source} WHERE measurement IN ({wanted}) AND value IS NOT NULL"
    return f"SELECT * FROM (SELECT device, time, occ::INTEGER AS occ, {columns} FROM ({numbered}) GROUP BY device, time, occ) {where}"


def _merged(spark, sf_dir, kinds, flt=None):
    return scan.merge_long([(events(spark, sf_dir, flt), list(dict.fromkeys(kinds)))], kinds, flt)


@_query(_merge_sql(_EV, ["click", "view"], ["click", "view"]))
def merge_two(spark, sf_dir):
    return _merged(spark, sf_dir, ["click", "view"])


@_query(_merge_sql(_EV, KINDS, KINDS))
def merge_five(spark, sf_dir):
    return _merged(spark, sf_dir, KINDS)


@_query(_merge_sql(_EV, ["click", "view"], ["click", "view"], f"WHERE time >= {LOW}"))
def merge_time_filter(spark, sf_dir):
    return _merged(spark, sf_dir, ["click", "view"], time_gteq(LOW))


@_query(_merge_sql(_EV, ["click", "view"], ["click", "view"], "WHERE click > 50 AND NOT isnan(click)"))
def merge_value_filter_col0(spark, sf_dir):
    return _merged(spark, sf_dir, ["click", "view"], value_gt(50.0))


@_query(_merge_sql(_EV, ["click", "view"], ["click", "view"], f"WHERE NOT coalesce(click > 50 AND NOT isnan(click), false) AND time < {HIGH}"))
def merge_not_value(spark, sf_dir):
    return _merged(spark, sf_dir, ["click", "view"], ~value_gt(50.0) & time_lt(HIGH))


@_query(_merge_sql(_LI, ["A", "N", "R"], ["A", "N", "R"]))
def merge_dup_ts(spark, sf_dir):
    return scan.merge_long([(lineitem_series(spark, sf_dir), ["A", "N", "R"])], ["A", "N", "R"])


@_query("""SELECT device, time, occ::INTEGER AS occ, max(price) AS price, max(status) AS status FROM (
SELECT o_custkey AS device, epoch_us(o_orderdate) AS time, 0 AS k, o_totalprice AS price, NULL AS status, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS occ FROM orders
UNION ALL SELECT o_custkey, epoch_us(o_orderdate), 1, NULL, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) FROM orders WHERE o_orderstatus <> 'O') GROUP BY device, time, occ""")
def merge_mixed_types(spark, sf_dir):
    o = orders_aligned(spark, sf_dir)
    price = o.select("device", "time", "seq", F.col("o_totalprice").alias("value"))
    status = o.where("o_orderstatus <> 'O'").select("device", "time", "seq", F.col("o_orderstatus").alias("value"))
    return scan.merge([price, status], ["price", "status"])


@_query(f"SELECT device, time, occ::INTEGER AS occ, value AS click, value AS click_2 FROM (SELECT *, row_number() OVER (PARTITION BY device, time ORDER BY seq) AS occ FROM {_EV} WHERE measurement = 'click' AND value IS NOT NULL)")
def merge_same_twice(spark, sf_dir):
    return _merged(spark, sf_dir, ["click", "click"])


# Aligned devices

@_query(f"SELECT device, time, seq, o_totalprice, o_orderstatus FROM {_ORD}")
def aligned_scan(spark, sf_dir):
    return scan.aligned(orders_aligned(spark, sf_dir), ["o_totalprice", "o_orderstatus"])


@_query(f"SELECT device, time, seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN seq % 2 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM {_ORD}")
def aligned_nulls(spark, sf_dir):
    o = orders_aligned(spark, sf_dir)
    wide = o.select("device", "time", "seq", F.when(F.col("seq") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("seq") % 2 != 0, F.col("o_orderpriority")).alias("priority"))
    return scan.aligned(wide, ["price", "priority"])


@_query(f"SELECT device, time, seq, value, props FROM (SELECT user_id AS device, epoch_us(ts) AS time, event_id AS seq, value, props FROM events) WHERE time BETWEEN {LOW} AND {HIGH} AND value > 25 AND NOT isnan(value)")
def aligned_filter(spark, sf_dir):
    flt = time_between(LOW, HIGH) & value_gt(25.0)
    return scan.aligned(events_aligned(spark, sf_dir, flt), ["value", "props"], flt)


@_query(f"SELECT device, time, seq, o_totalprice, o_totalprice AS o_totalprice_2 FROM {_ORD}")
def aligned_same_twice(spark, sf_dir):
    return scan.aligned(orders_aligned(spark, sf_dir), ["o_totalprice", "o_totalprice"])


# Statistics

_STATS = "count(value) AS count, min(time) FILTER (value IS NOT NULL) AS start_time, max(time) FILTER (value IS NOT NULL) AS end_time, arg_min(value, (time, seq)) AS first, arg_max(value, (time, seq)) AS last"
_NUMERIC = _STATS + ", min(value) FILTER (NOT isnan(value::DOUBLE)) AS min, max(value) FILTER (NOT isnan(value::DOUBLE)) AS max, round(sum(value::DOUBLE), 2) AS sum"
def _rounded(df):
    return df.withColumn("sum", F.round("sum", 2))



@_query(f"SELECT device, measurement, {_NUMERIC} FROM {_EV} GROUP BY device, measurement")
def series_stats(spark, sf_dir):
    return _rounded(stats.series_stats(events(spark, sf_dir), DataType.DOUBLE, ["device", "measurement"]))


@_query("""SELECT device, count(value) AS count, min(time) AS start_time, max(time) AS end_time, arg_min(value, (time, seq)) AS first, arg_max(value, (time, seq)) AS last, sum(value::BIGINT)::BIGINT AS sum
FROM (SELECT o_custkey AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, o_orderstatus = 'F' AS value FROM orders) GROUP BY device""")
def bool_stats(spark, sf_dir):
    legs = orders_aligned(spark, sf_dir).select("device", "time", "seq", (F.col("o_orderstatus") == "F").alias("value"))
    return stats.series_stats(legs, DataType.BOOLEAN, ["device"])


@_query(f"SELECT device, {_STATS.replace('value', 'event_type')} FROM (SELECT user_id AS device, epoch_us(ts) AS time, event_id AS seq, event_type FROM events) GROUP BY device")
def text_stats(spark, sf_dir):
    legs = events_aligned(spark, sf_dir).select("device", "time", "seq", F.col("event_type").alias("value"))
    return stats.series_stats(legs, DataType.STRING, ["device"])


@_query("""SELECT device, count(value) AS count, min(time) AS start_time, max(time) AS end_time, arg_min(value, (time, seq)) AS first, arg_max(value, (time, seq)) AS last, min(value) AS min, max(value) AS max, round(sum(value::DOUBLE), 2) AS sum
FROM (SELECT o_custkey AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, o_orderkey % 1000 AS value FROM orders) GROUP BY device""")
def int_stats(spark, sf_dir):
    legs = orders_aligned(spark, sf_dir).select("device", "time", "seq", (F.col("seq") % 1000).alias("value"))
    return _rounded(stats.series_stats(legs, DataType.INT64, ["device"]))


@_query(f"SELECT device, count({'v'}) AS count, min(time) FILTER (v IS NOT NULL) AS start_time, max(time) FILTER (v IS NOT NULL) AS end_time, min(v) FILTER (NOT isnan(v)) AS min, max(v) FILTER (NOT isnan(v)) AS max FROM (SELECT user_id AS device, epoch_us(ts) AS time, event_id AS seq, {_HOLED} AS v FROM events) GROUP BY device")
def nan_stats(spark, sf_dir):
    legs = _holed(spark, sf_dir).withColumnRenamed("v", "value")
    return stats.series_stats(legs, DataType.DOUBLE, ["device"]).select("device", "count", "start_time", "end_time", "min", "max")


@_query(f"SELECT device, count(*) AS count, min(time) AS start_time, max(time) AS end_time FROM {_ORD} GROUP BY device")
def time_column_stats(spark, sf_dir):
    return stats.time_stats(orders_aligned(spark, sf_dir), ["device"])


_PAGES = f"(SELECT *, page // {PER_CHUNK} AS chunk FROM (SELECT *, (row_number() OVER (PARTITION BY device, measurement ORDER BY time, seq) - 1) // {{0}} AS page FROM {_EV} WHERE value IS NOT NULL))"
_SMALL = 5


@_query(f"SELECT device, measurement, chunk, page, {_NUMERIC} FROM {_PAGES.format(_SMALL)} GROUP BY device, measurement, chunk, page")
def page_stats(spark, sf_dir):
    return _rounded(stats.page_stats(events(spark, sf_dir), DataType.DOUBLE, ["device", "measurement"], _SMALL, PER_CHUNK))


@_query(f"SELECT device, measurement, chunk, {_NUMERIC} FROM {_PAGES.format(_SMALL)} GROUP BY device, measurement, chunk")
def chunk_stats(spark, sf_dir):
    """Chunk statistics, merged from page statistics."""
    return _rounded(_chunks(spark, sf_dir))


def _chunks(spark, sf_dir):
    keys = ["device", "measurement"]
    pages = stats.page_stats(events(spark, sf_dir), DataType.DOUBLE, keys, _SMALL, PER_CHUNK)
    return stats.merge_stats(pages, DataType.DOUBLE, [*keys, "chunk"], "page")


@_query(f"SELECT device, measurement, {_NUMERIC} FROM {_EV} GROUP BY device, measurement")
def stats_merge(spark, sf_dir):
    """Series statistics, merged from pages to chunks to series."""
    return _rounded(stats.merge_stats(_chunks(spark, sf_dir), DataType.DOUBLE, ["device", "measurement"], "chunk"))


_CHUNK_SQL = f"(SELECT device, measurement, chunk, {_NUMERIC} FROM {_PAGES.format(_SMALL)} GROUP BY device, measurement, chunk)"


@_query(f"SELECT device, measurement, chunk, count FROM {_CHUNK_SQL} WHERE end_time >= {LOW} AND start_time <= {HIGH}")
def chunk_prune_time(spark, sf_dir):
    return catalog.surviving(_chunks(spark, sf_dir), time_between(LOW, HIGH), DataType.DOUBLE).select("device", "measurement", "chunk", "count")


@_query(f"SELECT device, measurement, chunk, count FROM {_CHUNK_SQL} WHERE max > 95 OR (min < 1 AND end_time > {LOW})")
def chunk_prune_value(spark, sf_dir):
    flt = value_gt(95.0) | (value_lt(1.0) & time_gt(LOW))
    return catalog.surviving(_chunks(spark, sf_dir), flt, DataType.DOUBLE).select("device", "measurement", "chunk", "count")


# Catalog

def _index(spark, sf_dir):
    return catalog.series_index(_chunks(spark, sf_dir), DataType.DOUBLE)


@_query("SELECT DISTINCT user_id AS device FROM events")
def devices(spark, sf_dir):
    return catalog.devices(events(spark, sf_dir))


_INDEX_SQL = f"(SELECT device, measurement, 'DOUBLE' AS type, count(*) AS n_chunks, sum(count)::BIGINT AS count, min(start_time) AS start_time, max(end_time) AS end_time FROM {_CHUNK_SQL} GROUP BY device, measurement)"


@_query(f"SELECT * FROM {_INDEX_SQL}")
def series_index(spark, sf_dir):
    return _index(spark, sf_dir).select("device", "measurement", "type", "n_chunks", "count", "start_time", "end_time")


@_query(f"SELECT count(DISTINCT device) AS devices, count(*) AS measurements, sum(n_chunks)::BIGINT AS chunks, sum(count)::BIGINT AS points, min(start_time) AS min_time, max(end_time) AS max_time FROM {_INDEX_SQL}")
def file_totals(spark, sf_dir):
    return catalog.totals(_index(spark, sf_dir))


@_query(f"SELECT type, sum(n_chunks)::BIGINT AS n_chunks FROM {_INDEX_SQL} GROUP BY type")
def chunks_by_type(spark, sf_dir):
    return catalog.chunks_by_type(_index(spark, sf_dir))


@_query(f"SELECT 'root.ev.u' || device AS device, measurement, type, n_chunks, count AS points, start_time, end_time FROM {_INDEX_SQL}")
def describe_series(spark, sf_dir):
    index = _index(spark, sf_dir).withColumn("device", F.array(F.lit("root"), F.lit("ev"), F.concat(F.lit("u"), F.col("device").cast("string"))))
    return catalog.describe(index)


@_query("SELECT user_id AS device, event_type AS measurement, ts IS NOT NULL AS there FROM (SELECT user_id, event_type, min(ts) AS ts FROM events WHERE user_id = 7 GROUP BY user_id, event_type)")
def series_of_device(spark, sf_dir):
    return _index(spark, sf_dir).where("device = 7").select("device", "measurement", (F.col("count") > 0).alias("there"))


# Device paths

_GEO = "(SELECT 'root.' || replace(r_name, ' ', '_') || '.' || replace(n_name, ' ', '_') AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _geo(spark, sf_dir):
    under = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("root."), under("r_name"), F.lit("."), under("n_name")).alias("path"))


@_query(f"SELECT path, string_split(path, '.')[1] AS table_name, len(string_split(path, '.'))::INTEGER AS n_segments, string_split(path, '.')[3] AS last FROM {_GEO}")
def device_path(spark, sf_dir):
    rows = _geo(spark, sf_dir).withColumn("segments", scalars.split_path(F.col("path")))
    return rows.select("path", scalars.table_name(F.col("segments")).alias("table_name"), scalars.segment_count(F.col("segments")).alias("n_segments"), F.element_at("segments", 3).alias("last"))


@_query("SELECT 'root.`' || n_name || '.x`.' || n_nationkey AS path, 3 AS n_segments, 'root.`' || n_name || '.x`.' || n_nationkey AS display FROM nation")
def device_path_quoted(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select(F.concat(F.lit("root.`"), F.col("n_name"), F.lit(".x`."), F.col("n_nationkey").cast("string")).alias("path"))
    rows = rows.withColumn("segments", scalars.split_quoted_path(F.col("path")))
    return rows.select("path", F.size("segments").alias("n_segments"), scalars.display_path(F.col("segments")).alias("display"))


@_query(f"SELECT a.path AS path, count(b.path) AS n_before FROM {_GEO} a LEFT JOIN {_GEO} b ON string_split(b.path, '.') < string_split(a.path, '.') GROUP BY a.path")
def device_order(spark, sf_dir):
    """How many devices come before each, segment by segment. Nations: a fixed, small table."""
    g = _geo(spark, sf_dir).withColumn("s", scalars.split_path(F.col("path")))
    other = g.select(F.col("path").alias("other"), F.col("s").alias("t"))
    return g.join(F.broadcast(other), F.col("t") < F.col("s"), "left").groupBy("path").agg(F.count("other").alias("n_before"))


# Ingest shapes

_UNPIVOT = " UNION ALL ".join(f"SELECT o_custkey AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, '{n}' AS measurement, {e} AS value FROM orders WHERE ({e}) IS NOT NULL" for n, e in (("price", "o_totalprice"), ("half", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 END")))


@_query(_UNPIVOT)
def record_unpivot(spark, sf_dir):
    o = orders_aligned(spark, sf_dir)
    wide = o.select("device", "time", "seq", F.col("o_totalprice").alias("price"), F.when(F.col("seq") % 2 == 0, F.col("o_totalprice") / 2).alias("half"))
    return unpivoted(wide, ["price", "half"])


@_query(f"SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE epoch_us(ts) >= {LOW} GROUP BY user_id")
def tag_field_query(spark, sf_dir):
    """A table with user_id as tag and value as field."""
    schema = TableSchema("events", (Column("user_id", DataType.INT64, Category.TAG), Column("value", DataType.DOUBLE)))
    e = _read(spark, sf_dir, "events").withColumn("time", _micros("ts")).select("time", *(c.name for c in schema.columns))
    tag, value = schema.tags()[0].name, schema.fields()[0].name
    return e.where(F.col("time") >= LOW).groupBy(tag).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))


@_query(" UNION ALL ".join(f"SELECT '{e.__name__}' AS kind, {int(m)} AS code, '{m.name}' AS name" for e in (DataType, Encoding, Compression, Category) for m in e))
def code_names(spark, sf_dir):
    """The assigned codes of each enumeration, looked up among all of 0 to 63."""
    codes = spark.range(64).select(F.col("id").cast("int").alias("code"))
    parts = [codes.select(F.lit(e.__name__).alias("kind"), "code", F.element_at(scalars.code_names(e), F.col("code")).alias("name")) for e in (DataType, Encoding, Compression, Category)]
    return reduce(DataFrame.unionByName, parts).where("name is not null")


# Encodings

_TIMES = f"(SELECT device, measurement, time, seq, time AS value FROM {_EV})"
_DIFF = f"(SELECT *, value - lag(value) OVER w AS delta, row_number() OVER w AS rn FROM {_TIMES} WINDOW w AS (PARTITION BY device, measurement ORDER BY time, seq))"
_DIFF2 = f"(SELECT *, delta - lag(delta) OVER (PARTITION BY device, measurement ORDER BY time, seq) AS delta_of_delta FROM {_DIFF})"
_KEYS = ["device", "measurement"]


def _times(spark, sf_dir):
    return events(spark, sf_dir).withColumn("value", F.col("time"))


@_query(f"SELECT device, measurement, time, CASE WHEN rn = 1 THEN value END AS first, delta, delta_of_delta FROM {_DIFF2}")
def enc_ts2diff(spark, sf_dir):
    return codecs.ts2diff(_times(spark, sf_dir), _KEYS).select("device", "measurement", "time", "first", "delta", "delta_of_delta")


@_query(f"SELECT device, measurement, time, time AS value FROM {_EV}")
def dec_ts2diff(spark, sf_dir):
    coded = codecs.ts2diff(_times(spark, sf_dir), _KEYS).drop("value")
    return codecs.ts2diff_decode(coded, _KEYS).select("device", "measurement", "time", "value")


_PRIORITY = "(SELECT o_custkey % 50 AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, o_orderstatus AS value FROM orders)"
_RUNS = f"""(SELECT device, run, min(value) AS value, count(*) AS length, min(time) AS start_time, max(time) AS end_time FROM (
SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY time, seq) AS run FROM (
SELECT *, CASE WHEN value IS DISTINCT FROM lag(value) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM {_PRIORITY} WINDOW w AS (PARTITION BY device ORDER BY time, seq))) GROUP BY device, run)"""


def _statuses(spark, sf_dir):
    o = orders_aligned(spark, sf_dir)
    return o.select((F.col("device") % 50).alias("device"), "time", "seq", F.col("o_orderstatus").alias("value"))


@_query(f"SELECT device, run::BIGINT AS run, value, length, start_time, end_time FROM {_RUNS}")
def enc_rle(spark, sf_dir):
    return codecs.rle(_statuses(spark, sf_dir), ["device"])


@_query(f"SELECT device, row_number() OVER (PARTITION BY device ORDER BY time, seq) - 1 AS seq, value FROM {_PRIORITY}")
def dec_rle(spark, sf_dir):
    return codecs.rle_decode(codecs.rle(_statuses(spark, sf_dir), ["device"]), ["device"])


_DICT = "(SELECT device, row_number() OVER (PARTITION BY device ORDER BY f) - 1 AS id, value, uses FROM (SELECT device, value, min((time, seq)) AS f, count(*) AS uses FROM {0} GROUP BY device, value))"
_EV_TYPES = "(SELECT user_id AS device, epoch_us(ts) AS time, event_id AS seq, event_type AS value FROM events)"


def _types(spark, sf_dir):
    return events_aligned(spark, sf_dir).select("device", "time", "seq", F.col("event_type").alias("value"))


@_query(f"SELECT * FROM {_DICT.format(_EV_TYPES)}")
def enc_dictionary(spark, sf_dir):
    return codecs.dictionary(_types(spark, sf_dir), ["device"])


@_query(f"SELECT device, time, seq, value FROM {_EV_TYPES}")
def dec_dictionary(spark, sf_dir):
    rows = _types(spark, sf_dir)
    entries = codecs.dictionary(rows, ["device"])
    return codecs.dictionary_decode(codecs.dictionary_encode(rows, entries, ["device"]), entries, ["device"])


_ZZ = "(CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END)"
_WIDTH = "(CASE WHEN {0} = 0 THEN 0 ELSE length(ltrim({0}::BIGINT::BIT::VARCHAR, '0')) END)"
_SIGNED = "(SELECT event_id AS seq, epoch_us(ts) AS time, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (event_id * event_id) AS value FROM events)"


def _signed(spark, sf_dir):
    return events_aligned(spark, sf_dir).select("seq", "time", (F.when(F.col("seq") % 2 == 0, 1).otherwise(-1) * F.col("seq") * F.col("seq")).alias("value"))


@_query(f"SELECT seq, value, {_ZZ.format('value')} AS zigzag, greatest(1, (({_WIDTH.format(_ZZ.format('value'))} + 6) // 7))::INTEGER AS n_bytes FROM {_SIGNED}")
def enc_zigzag(spark, sf_dir):
    return codecs.zigzag_bytes(_signed(spark, sf_dir)).select("seq", "value", "zigzag", "n_bytes")


@_query(f"SELECT seq, value FROM {_SIGNED}")
def dec_zigzag(spark, sf_dir):
    return _signed(spark, sf_dir).select("seq", scalars.unzigzag(scalars.zigzag(F.col("value"))).alias("value"))


@_query(f"SELECT seq, value FROM {_SIGNED}")
def dec_varint(spark, sf_dir):
    packed = scalars.varint(scalars.zigzag(F.col("value")))
    return _signed(spark, sf_dir).select("seq", scalars.unzigzag(scalars.unvarint(packed)).alias("value"))


_SP = f"(SELECT device, measurement, time, seq, (row_number() OVER (PARTITION BY device, measurement ORDER BY time, seq) - 1) // 8 AS block, {_ZZ.format('coalesce(delta_of_delta, delta)')} AS zz FROM {_DIFF2} WHERE delta IS NOT NULL)"


@_query(f"SELECT device, measurement, block, count(*) AS n, max({_WIDTH.format('zz')})::INTEGER AS width, (count(*) * max({_WIDTH.format('zz')}))::BIGINT AS n_bits FROM {_SP} GROUP BY device, measurement, block")
def enc_sprintz_blocks(spark, sf_dir):
    return codecs.sprintz_blocks(_times(spark, sf_dir), _KEYS, size=8)


_LN = "(SELECT o_custkey % 50 AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, o_orderkey AS bits FROM orders)"


def _bits(spark, sf_dir):
    return orders_aligned(spark, sf_dir).select((F.col("device") % 50).alias("device"), "time", "seq", F.col("seq").alias("bits"))


@_query(f"SELECT device, time, seq, CASE WHEN before IS NULL THEN bits ELSE xor(bits, before) END AS xor FROM (SELECT *, lag(bits) OVER (PARTITION BY device ORDER BY time, seq) AS before FROM {_LN})")
def enc_xor(spark, sf_dir):
    return codecs.xor_previous(_bits(spark, sf_dir), ["device"]).select("device", "time", "seq", "xor")


@_query(f"SELECT device, block, count(*) AS n, max({_WIDTH.format('bits')})::INTEGER AS width, (count(*) * max({_WIDTH.format('bits')}))::BIGINT AS n_bits FROM (SELECT *, (row_number() OVER (PARTITION BY device ORDER BY time, seq) - 1) // 128 AS block FROM {_LN}) GROUP BY device, block")
def enc_bitpack(spark, sf_dir):
    return codecs.packed_blocks(_bits(spark, sf_dir), ["device"], "bits")


@_query("SELECT event_type, sum(4 + octet_length(encode(props)))::BIGINT AS plain_bytes, (count(*) * 8)::BIGINT AS value_bytes FROM events GROUP BY event_type")
def enc_plain_size(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(codecs.plain_bytes(DataType.STRING, "props")).cast("long").alias("plain_bytes"), F.sum(codecs.plain_bytes(DataType.DOUBLE)).cast("long").alias("value_bytes"))


# Encodings of each type of number: values that wrap, and floating ones by their bits

_WRAP32 = "(((({0}) + 2147483648) & 4294967295) - 2147483648)::INTEGER"
_NUMBERS = {
    "i32": (DataType.INT32, _WRAP32.format("event_id * 1000003 * 1009"), "((event_id * 1000003 * 1009 + 2147483648) & 4294967295) - 2147483648", "value::BIGINT"),
    "i64": (DataType.INT64, "event_id * 1000003 - 7", "event_id * 1000003 - 7", "value::BIGINT"),
    "f32": (DataType.FLOAT, "CAST(value AS FLOAT)", "value", "value::FLOAT::BIT::INTEGER::BIGINT"),
    "f64": (DataType.DOUBLE, "value", "value", "value::DOUBLE::BIT::BIGINT"),
}


def _number_legs(spark, sf_dir, name):
    kind, _, made, _ = _NUMBERS[name]
    e = _read(spark, sf_dir, "events").withColumn("value", F.expr(made).cast(kind.spark))
    return e.select((F.col("user_id") % 40).alias("device"), _micros("ts").alias("time"), F.col("event_id").alias("seq"), "value")


def _number_sql(name):
    _, made, _, bits = _NUMBERS[name]
    return f"(SELECT *, {bits} AS bits FROM (SELECT user_id % 40 AS device, epoch_us(ts) AS time, event_id AS seq, {made} AS value FROM events))"


def _register_numbers(name: str) -> None:
    kind = _NUMBERS[name][0]
    wide = kind in (DataType.INT64, DataType.DOUBLE)
    wrap = (lambda x: f"(CASE WHEN ({x}) > 9223372036854775807 THEN ({x}) - 18446744073709551616 WHEN ({x}) < -9223372036854775808 THEN ({x}) + 18446744073709551616 ELSE ({x}) END)::BIGINT") if wide else (lambda x: _WRAP32.format(x))
    number = "HUGEINT" if wide else "BIGINT"
    source, over = _number_sql(name), "OVER (PARTITION BY device ORDER BY time, seq)"
    delta = f"(SELECT *, {wrap(f'bits::{number} - before::{number}')} AS delta FROM (SELECT *, lag(bits) {over} AS before, row_number() {over} AS rn FROM {source}))"
    own = "BIGINT" if wide else "INTEGER"

    def encode(spark, sf_dir):
        return codecs.ts2diff(_number_legs(spark, sf_dir, name), ["device"]).select("device", "time", "seq", "first", "delta", "delta_of_delta")

    QUERIES[f"enc_ts2diff_{name}"] = encode
    ORACLES[f"enc_ts2diff_{name}"] = f"SELECT device, time, seq, CASE WHEN rn = 1 THEN bits::{own} END AS first, delta, {wrap(f'delta::{number} - earlier::{number}')} AS delta_of_delta FROM (SELECT *, lag(delta) {over} AS earlier FROM {delta})"
    plain = f"SELECT device, time, seq, value FROM {source}"

    def decode(spark, sf_dir):
        coded = codecs.ts2diff(_number_legs(spark, sf_dir, name), ["device"]).drop("value")
        return codecs.ts2diff_decode(coded, ["device"], kind).select("device", "time", "seq", "value")

    QUERIES[f"dec_ts2diff_{name}"] = decode
    ORACLES[f"dec_ts2diff_{name}"] = plain

    def encode_xor(spark, sf_dir):
        legs = codecs.with_bits(_number_legs(spark, sf_dir, name))
        return codecs.xor_previous(legs, ["device"]).select("device", "time", "seq", "xor")

    QUERIES[f"enc_gorilla_{name}"] = encode_xor
    ORACLES[f"enc_gorilla_{name}"] = f"SELECT device, time, seq, (CASE WHEN before IS NULL THEN bits ELSE xor(bits, before) END)::{own} AS xor FROM (SELECT *, lag(bits) {over} AS before FROM {source})"

    def decode_xor(spark, sf_dir):
        coded = codecs.xor_previous(codecs.with_bits(_number_legs(spark, sf_dir, name)), ["device"]).drop("bits", "value")
        return codecs.xor_decode(coded, ["device"]).withColumn("value", codecs.of_bits("bits", kind)).select("device", "time", "seq", "value")

    QUERIES[f"dec_gorilla_{name}"] = decode_xor
    ORACLES[f"dec_gorilla_{name}"] = plain

    def decode_sprintz(spark, sf_dir):
        heads, blocks = codecs.sprintz(_number_legs(spark, sf_dir, name), ["device"])
        return codecs.sprintz_decode(heads, blocks, ["device"], kind)

    QUERIES[f"dec_sprintz_{name}"] = decode_sprintz
    ORACLES[f"dec_sprintz_{name}"] = f"SELECT device, row_number() {over} - 1 AS seq, value FROM {source}"


for _name in _NUMBERS:
    _register_numbers(_name)


@_query(f"SELECT device, row_number() OVER (PARTITION BY device ORDER BY time, seq) - 1 AS seq, bits AS value FROM {_LN}")
def dec_bitpack(spark, sf_dir):
    return codecs.unpack(codecs.pack(_bits(spark, sf_dir), ["device"], "bits"), ["device"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.in_order(merge_five(spark, sf_dir))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
