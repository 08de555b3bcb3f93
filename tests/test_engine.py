import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, scalars
from tidemark.functions.predicates import Custom, time_between, time_gt, time_lt, value_eq, value_gt, value_lt
from tidemark.model import Category, Column, Compression, Config, CorruptedError, DataType, Encoding, InvalidArgError, Measurement, NotFoundError, Record, TableSchema, Tablet, TypeMismatchError
from tidemark.operators import scan, stats
from tidemark.plans.engine import TsEngine
from tidemark.sources.store import Writer
from tidemark.streaming import ingest

I64 = (1 << 63) - 1


def legs(spark, rows, kind="long", device="d"):
    return spark.createDataFrame([(device, t, s, v) for t, s, v in rows], f"device string, time long, seq long, value {kind}")


def got(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A dataset with the fixtures: two chunks, interleaved series, an aligned device, all types, a table."""
    root = f"file://{tmp_path_factory.mktemp('ts')}/data"
    w = Writer(spark, root)
    for d, m in (("root.sg.d1", "m"), ("root.sg.dual", "m1"), ("root.sg.dual", "m2")):
        w.register(d, Measurement(m, DataType.INT64, Encoding.TS_2DIFF))
    for i in range(20):
        w.write_record(Record("root.sg.d1", i).add("m", DataType.INT64, i if i < 10 else 90 + i))
        w.write_record(Record("root.sg.dual", i).add("m1" if i % 2 == 0 else "m2", DataType.INT64, i))
    w.register_aligned("root.sg.al", [Measurement("i", DataType.INT64), Measurement("d", DataType.DOUBLE)])
    for i in range(100):
        r = Record("root.sg.al", i).add("i", DataType.INT64, i)
        w.write_aligned_record(r.add("d", DataType.DOUBLE, float(i)) if i % 10 else r.add_null("d"))
    t = Tablet("root.sg1.`d.1`", [Measurement("b", DataType.BOOLEAN), Measurement("i", DataType.INT32), Measurement("f", DataType.FLOAT), Measurement("x", DataType.DOUBLE), Measurement("t", DataType.TEXT), Measurement("s", DataType.STRING)])
    for row, values in enumerate([(True, 1, 0.5, 0.1, b"\xff\x00", "é"), (False, -1, 1.5, math.inf, b"", "")]):
        t.add_time(row, 1_000_000 * (row + 1))
        for c, v in enumerate(values):
            t.set(row, c, v)
    t.add_time(2, 3_000_000)
    t.set(2, 1, 7)
    w.write_tablet(t)
    schema = TableSchema("weather", (Column("region", DataType.STRING, Category.TAG), Column("temperature", DataType.DOUBLE)))
    w.register_table(schema)
    w.write_table("weather", spark.createDataFrame([(1, "n", 20.5), (2, "s", None)], "time long, region string, temperature double"))
    w.close()
    with pytest.raises(InvalidArgError):
        w.close()
    return TsEngine.open(spark, root), root, schema


def test_two_chunk_series(stored):
    e = stored[0]
    rows = got(e.query("root.sg.d1", ["m"]), "time", "m")
    assert rows == [(i, i if i < 10 else 90 + i) for i in range(20)]
    assert e.query("root.sg.d1", ["m"], time_lt(-I64 - 1)).count() == 0
    assert [(r.m, r.m_2) for r in e.query("root.sg.d1", ["m", "m"]).collect()] == [(v, v) for _, v in rows]


def test_errors(stored, spark, tmp_path):
    e = stored[0]
    for bad, kind in ((("root.sg.d1", ["nope"]), NotFoundError), (("root.none", ["m"]), NotFoundError), (("root.sg.d1", []), InvalidArgError), ((["root.sg.d1", "root.sg.al"], ["i"]), NotFoundError)):
        with pytest.raises(kind):
            e.query(*bad)
    with pytest.raises(TypeMismatchError):
        e.query("root.sg.d1", ["m"], value_gt(1.5))
    with pytest.raises(NotFoundError):
        TsEngine.open(spark, f"file://{tmp_path}/nothing")
    (tmp_path / "odd" / "meta").mkdir(parents=True)
    (tmp_path / "odd" / "meta" / "x.txt").write_text('{"magic": "other"}')
    with pytest.raises(CorruptedError):
        TsEngine.open(spark, f"file://{tmp_path}/odd")
    w = Writer(spark, f"file://{tmp_path}/w")
    with pytest.raises(NotFoundError):
        w.write_record(Record("d", 0).add("m", DataType.INT32, 1))
    w.register("d", Measurement("m", DataType.INT32))
    with pytest.raises(TypeMismatchError):
        w.write_record(Record("d", 0).add("m", DataType.INT64, 1))
    with pytest.raises(NotFoundError):
        w.write_table("t", spark.range(1))


def test_interleaved_merge(stored):
    e = stored[0]
    rows = got(e.query("root.sg.dual", ["m1", "m2"]), "time", "m1", "m2")
    assert rows == [(t, t if t % 2 == 0 else None, t if t % 2 else None) for t in range(20)]
    assert [r[0] for r in got(e.query("root.sg.dual", ["m1", "m2"], time_between(4, 8)), "time")] == [4, 5, 6, 7, 8]


def test_aligned(stored):
    e = stored[0]
    assert got(e.query("root.sg.al", ["i", "d"], time_between(10, 20)), "time", "i", "d") == [(i, i, float(i) if i % 10 else None) for i in range(10, 21)]
    assert e.query("root.sg.al", ["d"]).count() == 100  # rows that are all null stay
    assert e.query("root.sg.al", ["d"], ~value_gt(50.0)).count() == 51 + 4
    assert e.query("root.sg.al", ["d"], Custom(lambda t, v: v > 97.0)).count() == 2


def test_all_types(stored):
    e = stored[0]
    rows = got(e.query("root.sg1.`d.1`", ["b", "i", "f", "x", "t", "s"]), "time", "b", "i", "f", "x", "t", "s")
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows] == [
        (1_000_000, True, 1, 0.5, 0.1, b"\xff\x00", "é"), (2_000_000, False, -1, 1.5, math.inf, b"", ""), (3_000_000, None, 7, None, None, None, None)]
    assert e.query("root.sg1.`d.1`", ["s"], value_eq("é")).count() == 1
    assert e.query("root.sg1.`d.1`", ["t"], value_eq(b"")).count() == 1
    assert e.query("root.sg1.`d.1`", ["b"], value_gt(False)).count() == 1


def test_catalog(stored):
    e, _, schema = stored
    assert sorted(".".join(r["device"]) for r in e.devices().collect()) == ["root.sg.al", "root.sg.d1", "root.sg.dual", "root.sg1.d.1"]
    assert [r["measurement"] for r in e.series_of("root.sg.al").collect()] == ["", "d", "i"]
    assert e.device_might_exist("root.sg.d1") and not e.device_might_exist("root.sg.d")
    with pytest.raises(NotFoundError):
        e.series_of("root.x")
    t = e.totals().first()
    assert (t.devices, t.measurements, t.points) == (4, 1 + 2 + 3 + 6, 20 + 20 + 100 + 90 + 100 + 13)
    assert t.min_time == 0 and t.max_time == 3_000_000
    assert ("`d.1`" in {r["device"].split(".", 2)[2] for r in e.describe().collect() if "sg1" in r["device"]})
    assert {r["type"] for r in e.chunks_by_type().collect()} == {"INT64", "DOUBLE", "BOOLEAN", "INT32", "FLOAT", "TEXT", "STRING"}
    assert e.reader.table_schema("weather") == schema and e.table("weather").count() == 2
    assert e.column_meta("root.sg.al", ["d"])[-1] == ("d", DataType.DOUBLE)


def test_empty_dataset(spark, tmp_path):
    root = f"file://{tmp_path}/empty"
    Writer(spark, root).close()
    e = TsEngine.open(spark, root)
    assert e.devices().count() == 0 and e.totals().first().points == 0


def test_distributed_writes_and_append(spark, tmp_path):
    root = f"file://{tmp_path}/wide"
    wide = spark.range(50).select(F.concat(F.lit("root.d"), (F.col("id") % 3).cast("string")).alias("device"), F.col("id").alias("time"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("a"), (F.col("id") / 2).alias("b"))
    w = Writer(spark, root)
    w.write_wide(wide, ["a", "b"])
    w.close()
    e = TsEngine.open(spark, root)
    assert e.query("root.d0", ["b"]).count() == 17 and e.query("root.d0", ["a"]).count() == 9
    more = Writer(spark, root, mode="append")
    more.write_series(spark.createDataFrame([("root.d9", "b", 1, 1, 2.0)], "device string, measurement string, time long, seq long, value double"), DataType.DOUBLE)
    more.close()
    e = TsEngine.open(spark, root)
    assert e.query("root.d9", ["b"]).count() == 1 and e.query("root.d0", ["b", "a"]).count() == 17
    assert e.query(["root.d0", "root.d1"], ["b"]).select("device").distinct().count() == 2


def test_flushes_and_codecs(spark, tmp_path):
    for codec in Compression:
        root = f"file://{tmp_path}/{codec.name}"
        w = Writer(spark, root, Config(compression=codec, page_points=4))
        w.register("root.d", Measurement("m", DataType.INT64))
        w.register_aligned("root.a", [Measurement("x", DataType.INT32)])
        for part in range(2):
            for i in range(10):
                w.write_record(Record("root.d", 10 * part + i).add("m", DataType.INT64, i))
            w.write_aligned_record(Record("root.a", part).add("x", DataType.INT32, part))
            w.flush()
        w.close()
        with pytest.raises(InvalidArgError):
            w.write_record(Record("root.d", 0).add("m", DataType.INT64, 1))
        e = TsEngine.open(spark, root)
        assert [len(b) for b in e.blocks(e.query("root.d", ["m"]), 8)] == [8, 8, 4] and e.query("root.a", ["x"]).count() == 2
        s = e.series_of("root.d").first()
        assert (s["count"], s.start_time, s.end_time, s["first"], s["last"], s["sum"]) == (20, 0, 19, "0", "9", "90.0")
        if codec is Compression.SNAPPY:
            break


def test_a_device_both_ways(spark, tmp_path):
    root = f"file://{tmp_path}/both"
    w = Writer(spark, root)
    w.register("root.d", Measurement("m", DataType.INT64))
    w.register_aligned("root.d", [Measurement("x", DataType.INT32)])
    w.write_record(Record("root.d", 1).add("m", DataType.INT64, 1))
    w.write_aligned_record(Record("root.d", 1).add("x", DataType.INT32, 1))
    with pytest.raises(NotFoundError):
        w.write_aligned_record(Record("root.d", 1).add("y", DataType.INT32, 1))
    with pytest.raises(TypeMismatchError):
        w.write_aligned_record(Record("root.d", 1).add("x", DataType.INT64, 1))
    w.close()
    with pytest.raises(InvalidArgError):
        TsEngine.open(spark, root).query("root.d", ["x", "m"])


@pytest.mark.parametrize("codec", list(Compression))
def test_every_codec_is_written(spark, tmp_path, codec):
    w = Writer(spark, f"file://{tmp_path}/c", Config(compression=codec))
    w.write_series(spark.range(30).selectExpr("'d' device", "'m' measurement", "id time", "id seq", "id value"), DataType.INT64)
    w.close()
    assert TsEngine.open(spark, f"file://{tmp_path}/c").query("d", ["m"]).count() == 30


def test_filters_read_stored_dictionaries(spark):
    """At this size the values are stored as a dictionary, which the reader asks before it reads a row group."""
    import duckdb

    from tidemark.plans import store_slate

    sf_dir = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = duck.execute(store_slate.ORACLES["store_series_filter"]).df().sort_values("seq")
    found = store_slate.QUERIES["store_series_filter"](spark, sf_dir).toPandas().sort_values("seq")
    assert found[["device", "time", "seq", "view"]].values.tolist() == want[["device", "time", "seq", "view"]].values.tolist()


def merge_by_hand(streams):
    heads, out = [0] * len(streams), []
    while any(h < len(s) for h, s in zip(heads, streams)):
        now = min(s[h][0] for h, s in zip(heads, streams) if h < len(s))
        row = [now]
        for k, s in enumerate(streams):
            if heads[k] < len(s) and s[heads[k]][0] == now:
                row.append(s[heads[k]][1])
                heads[k] += 1
            else:
                row.append(None)
        out.append(tuple(row))
    return out


def test_merge_with_repeated_times(spark):
    a, b = [(5, 1, "a"), (5, 2, "b"), (6, 3, "c")], [(5, 1, "x"), (7, 2, "y")]
    df = scan.in_order(scan.merge([legs(spark, a, "string"), legs(spark, b, "string")], ["m1", "m2"]))
    assert got(df, "time", "m1", "m2") == [(5, "a", "x"), (5, "b", None), (6, "c", None), (7, None, "y")]


@pytest.mark.parametrize("seed", range(3))
def test_random_merges(spark, seed):
    rng = random.Random(seed)
    streams = [sorted((rng.randrange(12), i, rng.randrange(100)) for i in range(rng.randrange(1, 15))) for _ in range(rng.randrange(2, 5))]
    df = scan.in_order(scan.merge([legs(spark, s) for s in streams], [f"m{k}" for k in range(len(streams))]))
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in df.collect()] == merge_by_hand([[(t, v) for t, _, v in s] for s in streams])


def test_merge_arity_and_plan(spark):
    with pytest.raises(InvalidArgError):
        scan.merge([], [])
    with pytest.raises(InvalidArgError):
        scan.merge([legs(spark, [(1, 1, 1)])], ["a", "b"])
    df = scan.merge([legs(spark, [(1, 1, 1)])] * 4, list("abcd"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # one shuffle, however many legs


def test_mixed_types_merge(spark):
    df = scan.merge([legs(spark, [(1, 1, 5)]), legs(spark, [(1, 1, 2.5)], "double"), legs(spark, [(2, 1, bytearray(b"\xff"))], "binary")], ["i", "d", "t"])
    assert dict(df.dtypes)["i"] == "bigint" and dict(df.dtypes)["d"] == "double" and dict(df.dtypes)["t"] == "binary"
    assert df.count() == 2


def test_truth_table(spark):
    wide = spark.createDataFrame([("d", i, i, v) for i, v in enumerate([5.0, math.nan, None, -0.0, math.inf])], "device string, time long, seq long, v double")
    passing = lambda f: sorted(r.time for r in scan.aligned(wide, ["v"], f).collect())
    assert passing(value_eq(5.0)) == [0] and passing(~value_eq(5.0)) == [1, 2, 3, 4] and passing(~~value_eq(5.0)) == [0]
    assert passing(value_gt(1.0)) == [0, 4] and passing(value_lt(1.0)) == [3] and passing(value_eq(0.0)) == [3]
    assert passing(value_eq(math.nan)) == [] and passing(~value_gt(math.nan)) == [0, 1, 2, 3, 4]
    assert passing(value_gt(1.0) | time_gt(2)) == [0, 3, 4] and passing(~(value_gt(1.0) & time_lt(3))) == [1, 2, 3, 4]


def test_time_bounds_at_extremes(spark):
    df = legs(spark, [(-I64 - 1, 1, 1), (I64, 2, 2)])
    for f, n in ((time_gt(-I64 - 1), 1), (time_lt(I64), 1), (time_between(-I64 - 1, I64), 2), (time_between(-I64 - 1, I64, False), 0)):
        assert scan.series(df, "m", f).count() == n


def test_statistics(spark):
    df = legs(spark, [(3, 1, 2.0), (1, 2, math.nan), (1, 3, None), (2, 4, -1.0)], "double")
    r = stats.series_stats(df, DataType.DOUBLE, ["device"]).first()
    assert (r["count"], r.start_time, r.end_time, r.min, r.max, r["last"]) == (3, 1, 3, -1.0, 2.0, 2.0) and math.isnan(r["first"]) and math.isnan(r["sum"])
    empty = stats.series_stats(df.where("value is null"), DataType.DOUBLE, ["device"]).first()
    assert empty["count"] == 0 and empty.min is None and empty["first"] is None
    b = stats.series_stats(legs(spark, [(1, 1, True), (2, 2, True), (3, 3, False)], "boolean"), DataType.BOOLEAN, ["device"]).first()
    assert b["sum"] == 2 and b["last"] is False
    assert "min" not in stats.series_stats(legs(spark, [(1, 1, "x")], "string"), DataType.STRING, ["device"]).columns


def test_merged_statistics_equal_direct(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), i, rng.randrange(-99, 99)) for i in range(200)]
    df = legs(spark, rows)
    pages = stats.page_stats(df, DataType.INT64, ["device"], 7, 3)
    chunks = stats.merge_stats(pages, DataType.INT64, ["device", "chunk"], "page")
    whole = stats.merge_stats(chunks, DataType.INT64, ["device"], "chunk")
    direct = stats.series_stats(df, DataType.INT64, ["device"])
    assert whole.select(*direct.columns).collect() == direct.collect()


def test_pruning_loses_nothing(spark):
    rng = random.Random(5)
    df = legs(spark, [(i, i, rng.randrange(100)) for i in range(300)]).withColumn("device", F.lit("d"))
    paged = stats.with_pages(df, ["device"], 10, 2)
    chunks = stats.merge_stats(stats.page_stats(df, DataType.INT64, ["device"], 10, 2), DataType.INT64, ["device", "chunk"], "page")
    for f in (time_between(37, 61), value_gt(97), value_lt(2) & time_gt(100), value_eq(50) | time_lt(3), ~value_gt(10)):
        held = {r.chunk for r in paged.where(f.row(F.col("time"), F.col("value"), DataType.INT64)).select("chunk").collect()}
        assert held <= {r.chunk for r in chunks.where(f.statistic(DataType.INT64)).collect()}


def test_pushdown_reaches_the_scan(stored, spark):
    e = stored[0]
    explain = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    plan = explain(e.query("root.sg.dual", ["m1", "m2"], time_between(4, 8)))
    assert "GreaterThanOrEqual(time,4)" in plan and "LessThanOrEqual(time,8)" in plan
    assert "EqualTo(device_path,root.sg.dual)" in plan
    plan = explain(e.query("root.sg.d1", ["m"], value_gt(5)))
    assert "GreaterThan(value,5)" in plan


def test_bounds_reach_stored_times(spark):
    from tidemark.plans import slate

    explain = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    for name in ("time_between_incl", "filter_and", "merge_time_filter", "aligned_filter", "filter_not_time"):
        plan = explain(slate.queries()[name](spark, "/root/testdata/sf0.001"))
        assert any("(ts," in line for line in plan.split("\n") if line.startswith("PushedFilters")), name
    assert "GreaterThan(value,50.0)" in explain(slate.queries()["value_gt"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("values", [[I64, -I64 - 1, I64, 0], [5], [3, 3, 3], list(range(40))])
def test_delta_round_trip(spark, values):
    df = legs(spark, [(i, i, v) for i, v in enumerate(values)])
    back = codecs.ts2diff_decode(codecs.ts2diff(df, ["device"]).drop("value"), ["device"])
    assert [r.value for r in back.orderBy("time").collect()] == values


def test_xor_round_trip(spark):
    rng = random.Random(9)
    values = [1.0, -0.1, -0.0, math.inf, -math.inf, 1e-310, 0.5 + 1.5] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(40)]
    df = legs(spark, [(i, i, v) for i, v in enumerate(values)], "double").withColumn("bits", codecs.double_bits("value"))
    back = codecs.xor_decode(codecs.xor_previous(df, ["device"]).drop("bits"), ["device"]).withColumn("again", codecs.double_of_bits("bits"))
    assert [repr(r.again) for r in back.orderBy("time").collect()] == [repr(v) for v in values]


def test_rle_and_dictionary_round_trip(spark):
    values = ["a", "a", None, None, "b", "a"]
    df = legs(spark, [(i, i, v) for i, v in enumerate(values)], "string")
    assert [r.value for r in codecs.rle_decode(codecs.rle(df, ["device"]), ["device"]).orderBy("seq").collect()] == values
    entries = codecs.dictionary(df, ["device"])
    assert [(r.id, r.value, r.uses) for r in entries.orderBy("id").collect()] == [(0, "a", 3), (1, None, 2), (2, "b", 1)]
    coded = codecs.dictionary_encode(df, entries, ["device"])
    assert [r.value for r in codecs.dictionary_decode(coded, entries, ["device"]).orderBy("seq").collect()] == values


def test_numbers(spark):
    ns = [0, 1, -1, 63, -64, 64, I64, -I64 - 1, 1 << 35]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    z = scalars.zigzag(F.col("n"))
    rows = df.select("n", z.alias("z"), scalars.unzigzag(z).alias("back"), scalars.varint_length(z).alias("len"), scalars.varint(z).alias("v"), scalars.unvarint(scalars.varint(z)).alias("again")).collect()
    for r in rows:
        expected = 2 * r.n if r.n >= 0 else -2 * r.n - 1
        assert r.z & (1 << 64) - 1 == expected and r.back == r.n and r.len == len(r.v) == max(1, -(-expected.bit_length() // 7)) and r.again == r.z


def test_size_claims(spark):
    """Steady series pack to a small part of their plain size."""
    df = legs(spark, [(i, i, i) for i in range(1000)])
    bits = codecs.sprintz_blocks(df, ["device"]).agg(F.sum("n_bits")).first()[0]
    assert bits / 8 + 8 < 8000 / 15
    words = legs(spark, [(i, i, "sensor_%02d" % (i % 5)) for i in range(100)], "string")
    plain = words.agg(F.sum(codecs.plain_bytes(DataType.STRING))).first()[0]
    d = codecs.dictionary(words, ["device"]).agg(F.sum(F.length("value") + 4), F.max(scalars.bit_width(F.col("id")))).first()
    assert plain > 5 * (d[0] + 100 * d[1] / 8)


def test_device_filter(spark):
    assert scalars.murmur3(b"", 0) == 0 and scalars.murmur3(b"hello", 0) == 0x248BFA47 and scalars.murmur3(b"hello, world", 0) == 0x149BBB7F
    bits = scalars.bloom_bits(100, 0.05)
    assert bits % 8 == 0 and bits >= 623 and scalars.bloom_bits(1, 0.05) == 64
    df = spark.createDataFrame([(f"root.d{i}",) for i in range(100)], "p string")
    held = {b for r in df.select(scalars.bloom_positions(bits)("p").alias("b")).collect() for b in r.b}
    assert all(scalars.murmur3(f"root.d{i}".encode(), s) % bits in held for i in range(100) for s in scalars.BLOOM_SEEDS)


def test_streaming_ingest(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    struct = "device string, measurement string, time long, seq long, value long"
    for k, rows in enumerate([[("d", "m", 10, 3, 5), ("d", "m", 20, 4, 6)], [("d", "m", 5, 1, 9), ("e", "m", 7, 2, None)]]):
        spark.createDataFrame(rows, struct).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(struct).parquet(str(source))
        ingest.start(stream, DataType.INT64, f"{out}/data", f"{out}/stats", f"{out}/checkpoint").awaitTermination()
    r = ingest.folded(spark.read.parquet(f"{out}/stats"), DataType.INT64).where("device = 'd'").first()
    assert (r["count"], r.start_time, r.end_time, r["first"], r["last"], r.min, r.max, r["sum"]) == (3, 5, 20, 9, 6, 5, 9, 20.0)
    assert spark.read.parquet(f"{out}/data").count() == 3


def test_writers_flush_by_themselves(spark, tmp_path):
    root = f"file://{tmp_path}/auto"
    w = Writer(spark, root, Config(group_bytes=24 * 20))
    w.register("root.d", Measurement("m", DataType.INT64))
    for i in range(45):
        w.write_record(Record("root.d", i).add("m", DataType.INT64, i))
    assert TsEngine.open(spark, root).query("root.d", ["m"]).count() == 40
    w.close()
    e = TsEngine.open(spark, root)
    chunks = e.series_chunks("root.d", "m").collect()
    assert [(r.chunk, r["count"], r["first"]) for r in chunks] == [(0, 20, 0), (1, 20, 20), (2, 5, 40)]
    with pytest.raises(NotFoundError):
        e.series_chunks("root.d", "none")


def test_a_failed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/failed"
    frame = lambda n: spark.range(n).selectExpr("'root.`a.b`' device", "'m' measurement", "id time", "id seq", "id value")
    w = Writer(spark, root)
    w.write_series(frame(10), DataType.INT64)
    w.close()
    from tidemark.sources import catalog

    again = Writer(spark, root)
    again.write_series(frame(3), DataType.INT64)
    with monkeypatch.context() as m:
        m.setattr(catalog, "chunk_index", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            again.close()
    assert TsEngine.open(spark, root).query("root.`a.b`", ["m"]).count() == 10
    again.close()
    assert TsEngine.open(spark, root).query("root.`a.b`", ["m"]).count() == 3 and TsEngine.open(spark, root).totals().first()["points"] == 3


def test_a_merge_scans_a_type_once(stored, spark):
    explain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    e = stored[0]
    plan = explain(e.query("root.sg.dual", ["m1", "m2", "m1"], ordered=False))
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1


def test_other_types_have_no_differences(spark):
    from tidemark.model import UnsupportedError

    with pytest.raises(UnsupportedError):
        codecs.ts2diff(legs(spark, [(1, 1, "a")], "string"), ["device"])
