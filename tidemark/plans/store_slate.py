"""Registered queries over a stored dataset: the driver's tables written through ``Writer``, asked through ``TsEngine``.

The dataset is written once for each session and data folder, in two commits:
events are series of root.ev.u<user> (half of them in each commit), orders are
aligned rows of root.ord.c<customer> with holes, line numbers are whole-number
series of root.li.s<supplier>, nations come as single records, regions as a
tablet, a table has users as tags. Oracles ask the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import time_between, time_gteq, value_gt
from tidemark.functions.scalars import display_path
from tidemark.model import Category, Column, DataType, Measurement, Record, TableSchema, Tablet
from tidemark.plans.engine import TsEngine
from tidemark.plans.slate import HIGH, LOW, _micros, _read
from tidemark.sources.shared import own_folder
from tidemark.sources.store import Writer

QUERIES = {}
ORACLES: dict[str, str] = {}
_roots: dict[tuple[str, str], str] = {}


def _query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_engine(spark, sf_dir))
        ORACLES[f.__name__] = oracle
        return f

    return register


def _engine(spark: SparkSession, sf_dir: str) -> TsEngine:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots:
        root = own_folder(spark)
        _write(spark, sf_dir, root)
        _roots[key] = root
    return TsEngine.open(spark, _roots[key])


def _write(spark: SparkSession, sf_dir: str, root: str) -> None:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    events = _read(spark, sf_dir, "events").withColumn("time", _micros("ts"))
    series = events.select(name("root.ev.u", "user_id").alias("device"), F.col("event_type").alias("measurement"), "time", F.col("event_id").alias("seq"), "value")
    w = Writer(spark, root)
    w.write_series(series.where("seq % 2 = 0"), DataType.DOUBLE)
    o = _read(spark, sf_dir, "orders")
    w.write_aligned("orders", o.select(name("root.ord.c", "o_custkey").alias("device"), _micros("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"),
                                       F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status")))
    schema = TableSchema("users", (Column("user_id", DataType.INT64, Category.TAG), Column("value", DataType.DOUBLE)))
    w.register_table(schema)
    w.write_table("users", events.select("time", F.col("user_id").cast("long").alias("user_id"), "value"))
    nations = _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows, whatever the scale
    for r in nations:
        device = f"root.nation.`n.{r['n_nationkey']}`"
        w.register(device, Measurement("region", DataType.INT64))
        w.write_record(Record(device, 1000 + r["n_nationkey"]).add("region", DataType.INT64, int(r["n_regionkey"])))
    w.register_aligned("root.both", [Measurement("x", DataType.INT32), Measurement("y", DataType.DOUBLE)])
    w.register("root.both", Measurement("m", DataType.INT64))
    w.write_aligned_record(Record("root.both", 1).add("x", DataType.INT32, 5))
    w.write_record(Record("root.both", 1).add("m", DataType.INT64, 6))
    w.flush()
    w.write_series(series.where("seq % 2 <> 0"), DataType.DOUBLE)
    li = _read(spark, sf_dir, "lineitem")
    w.write_series(li.select(name("root.li.s", "l_suppkey").alias("device"), F.lit("line").alias("measurement"), _micros("l_shipdate").alias("time"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"), F.col("l_linenumber").cast("int").alias("value")), DataType.INT32)
    regions = _read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # 5 rows
    tablet = Tablet("root.region", [Measurement("name", DataType.STRING), Measurement("key", DataType.INT64)], 16)
    for k, r in enumerate(regions):
        tablet.add_time(k, 10 * k)
        tablet.set(k, 0, r["r_name"])
        if k != 2:
            tablet.set(k, 1, int(r["r_regionkey"]))
    w.write_tablet(tablet)
    w.close()


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("device", display_path(F.col("device")))


_EV = "(SELECT 'root.ev.u' || user_id AS device, event_type AS measurement, epoch_us(ts) AS time, event_id AS seq, value FROM events WHERE value IS NOT NULL)"
_LI = "(SELECT 'root.li.s' || l_suppkey AS device, 'line' AS measurement, epoch_us(l_shipdate) AS time, l_orderkey * 8 + l_linenumber AS seq, l_linenumber AS value FROM lineitem)"
_ORD = "(SELECT 'root.ord.c' || o_custkey AS device, epoch_us(o_orderdate) AS time, o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, o_orderstatus AS status FROM orders)"
_NAT = "(SELECT 'root.nation.`n.' || n_nationkey || '`' AS device, 'region' AS measurement, 1000 + n_nationkey AS time, n_regionkey AS value FROM nation)"
_REG = "(SELECT 'root.region' AS device, 10 * r_regionkey AS time, r_name AS name, CASE WHEN r_regionkey <> 2 THEN r_regionkey END AS key FROM region)"
_ALL = f"""(SELECT device, measurement, 'DOUBLE' AS type, time FROM {_EV} UNION ALL SELECT device, measurement, 'INT32', time FROM {_LI}
UNION ALL SELECT device, measurement, 'INT64', time FROM {_NAT} UNION ALL SELECT device, 'name', 'STRING', time FROM {_REG} UNION ALL SELECT device, 'key', 'INT64', time FROM {_REG} WHERE key IS NOT NULL
UNION ALL SELECT 'root.both', m, k, t FROM (VALUES ('m', 'INT64', 1), ('<aligned-time>', 'INT64', 1), ('x', 'INT32', 1), ('y', 'DOUBLE', NULL)) b(m, k, t)
UNION ALL SELECT device, '<aligned-time>', 'INT64', time FROM {_ORD} UNION ALL SELECT device, 'price', 'DOUBLE', CASE WHEN price IS NOT NULL THEN time END FROM {_ORD} UNION ALL SELECT device, 'status', 'STRING', CASE WHEN status IS NOT NULL THEN time END FROM {_ORD})"""
_SERIES = f"(SELECT device, measurement, type, count(time) AS points, min(time)::BIGINT AS start_time, max(time)::BIGINT AS end_time FROM {_ALL} GROUP BY device, measurement, type)"
_U = "device IN ('root.ev.u3', 'root.ev.u7', 'root.ev.u9')"
_DEVICES = ["root.ev.u3", "root.ev.u7", "root.ev.u9"]


@_query(f"SELECT device, time, seq, value AS click FROM {_EV} WHERE device = 'root.ev.u7' AND measurement = 'click'")
def store_series(e):
    return _shown(e.query("root.ev.u7", ["click"]))


@_query(f"SELECT device, time, seq, value AS view FROM {_EV} WHERE {_U} AND measurement = 'view' AND time BETWEEN {LOW} AND {HIGH} AND value > 20")
def store_series_filter(e):
    return _shown(e.query(_DEVICES, ["view"], time_between(LOW, HIGH) & value_gt(20.0), ordered=False))


def _merge_oracle(where: str = "") -> str:
    numbered = f"SELECT *, row_number() OVER (PARTITION BY device, time, measurement ORDER BY seq) AS occ FROM {_EV} WHERE {_U} AND measurement IN ('click', 'view')"
    return f"SELECT * FROM (SELECT device, time, occ::INTEGER AS occ, max(value) FILTER (measurement = 'click') AS click, max(value) FILTER (measurement = 'view') AS view, max(value) FILTER (measurement = 'click') AS click_2 FROM ({numbered}) GROUP BY device, time, occ) {where}"


@_query(_merge_oracle())
def store_merge(e):
    return _shown(e.query(_DEVICES, ["click", "view", "click"]))


@_query(_merge_oracle(f"WHERE time >= {LOW} AND click > 30"))
def store_merge_filter(e):
    return _shown(e.query(_DEVICES, ["click", "view", "click"], time_gteq(LOW) & value_gt(30.0)))


@_query(f"SELECT device, time, seq, price, status FROM {_ORD} WHERE device = 'root.ord.c7'")
def store_aligned(e):
    return _shown(e.query("root.ord.c7", ["price", "status"]))


@_query(f"SELECT device, time, seq, price, price AS price_2 FROM {_ORD} WHERE device IN ('root.ord.c1', 'root.ord.c7', 'root.ord.c11') AND price > 1000")
def store_aligned_filter(e):
    return _shown(e.query(["root.ord.c1", "root.ord.c7", "root.ord.c11"], ["price", "price"], value_gt(1000.0)))


@_query(f"SELECT device, time, value AS region FROM {_NAT} WHERE device IN ('root.nation.`n.3`', 'root.nation.`n.4`')")
def store_records(e):
    return _shown(e.query(["root.nation.`n.3`", "root.nation.`n.4`"], ["region"])).select("device", "time", "region")


@_query("SELECT 'root.both' AS device, 1 AS time, 5 AS x, NULL::DOUBLE AS y")
def store_aligned_record(e):
    return _shown(e.query("root.both", ["x", "y"])).select("device", "time", "x", "y")


@_query(f"SELECT device, time, 1 AS occ, name, key FROM {_REG}")
def store_tablet(e):
    return _shown(e.query("root.region", ["name", "key"]))


@_query("SELECT user_id, count(*) AS n, count(value) AS n_values, max(value) AS top FROM events GROUP BY user_id")
def store_table(e):
    return e.table("users").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.max("value").alias("top"))


@_query("SELECT name, type, category FROM (VALUES ('user_id', 'INT64', 'TAG'), ('value', 'DOUBLE', 'FIELD')) t(name, type, category)")
def store_table_schema(e):
    columns = e.reader.table_schema("users").columns
    return e.reader.spark.createDataFrame([(c.name, c.type.name, c.category.name) for c in columns], "name string, type string, category string")


@_query(f"SELECT DISTINCT device FROM {_ALL}")
def store_devices(e):
    return _shown(e.devices())


@_query(f"SELECT * FROM {_SERIES}")
def store_describe(e):
    return e.describe().drop("n_chunks")


@_query(f"SELECT measurement, type, points FROM {_SERIES} WHERE device = 'root.ev.u7'")
def store_series_of(e):
    return e.series_of("root.ev.u7").select("measurement", "type", F.col("count").alias("points"))


@_query(f"SELECT count(DISTINCT device) AS devices, count(*) AS measurements, sum(points)::BIGINT AS points, min(start_time) AS min_time, max(end_time) AS max_time FROM {_SERIES}")
def store_totals(e):
    return e.totals().drop("chunks")


@_query(f"SELECT type, count(*) AS n_series FROM {_SERIES} GROUP BY type")
def store_types(e):
    return e.reader.index().groupBy("type").agg(F.count(F.lit(1)).alias("n_series"))


_FIRST_LAST = "count(value) AS count, arg_min(value, (time, seq))::DOUBLE AS first, arg_max(value, (time, seq))::DOUBLE AS last, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, round(sum(value::DOUBLE), 2) AS sum"


@_query(f"SELECT device, measurement, {_FIRST_LAST} FROM (SELECT * FROM {_LI} UNION ALL SELECT device, 'price', time, seq, price FROM {_ORD} WHERE price IS NOT NULL) GROUP BY device, measurement")
def store_statistics(e):
    """Statistics that the catalog answers, of series and of aligned columns."""
    found = _shown(e.reader.index()).where("measurement in ('line', 'price') and count > 0")
    return found.select("device", "measurement", "count", *(F.col(c).cast("double").alias(c) for c in ("first", "last", "min", "max")), F.round(F.col("sum").cast("double"), 2).alias("sum"))


@_query(f"SELECT count(value) AS count, min(time) AS start_time, max(time) AS end_time, min(value) AS min, max(value) AS max FROM {_EV} WHERE device = 'root.ev.u7' AND measurement = 'click'")
def store_chunks(e):
    """The chunks of one series, of two commits, merged."""
    return e.series_chunks("root.ev.u7", "click").agg(F.sum("count").alias("count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min("min").alias("min"), F.max("max").alias("max"))


@_query(f"SELECT name AS device, name IN (SELECT device FROM {_ALL}) AS there FROM (VALUES ('root.ev.u7'), ('root.ev.none'), ('root.ord.c7'), ('root.region'), ('root')) t(name)")
def store_might_exist(e):
    return e.reader.spark.createDataFrame([(d, e.device_might_exist(d)) for d in ("root.ev.u7", "root.ev.none", "root.ord.c7", "root.region", "root")], "device string, there boolean")


@_query("SELECT name, type FROM (VALUES ('name', 'STRING'), ('key', 'INT64')) t(name, type)")
def store_column_meta(e):
    return e.reader.spark.createDataFrame([(n, t.name) for n, t in e.column_meta("root.region", ["name", "key"])], "name string, type string")


@_query("SELECT what, error FROM (VALUES ('device', 'NotFoundError'), ('measurement', 'NotFoundError'), ('no measurements', 'InvalidArgError'), ('mixed', 'InvalidArgError'), ('no dataset', 'NotFoundError'), ('no series', 'NotFoundError'), ('no table', 'NotFoundError')) t(what, error)")
def store_errors(e):
    """What is refused, and with which error."""
    tries = {
        "device": lambda: e.query("root.ev.none", ["click"]), "measurement": lambda: e.query("root.ev.u7", ["none"]), "no measurements": lambda: e.query("root.ev.u7", []),
        "mixed": lambda: e.query("root.both", ["x", "m"]), "no dataset": lambda: TsEngine.open(e.reader.spark, f"{e.reader.root}/none"),
        "no series": lambda: e.series_chunks("root.ev.u7", "none"), "no table": lambda: e.table("none"),
    }
    rows = []
    for what, attempt in tries.items():
        try:
            attempt()
            rows.append((what, "none"))
        except Exception as error:  # the kind of error is the result
            rows.append((what, type(error).__name__))
    return e.reader.spark.createDataFrame(rows, "what string, error string")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
