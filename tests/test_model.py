import pytest

from tidemark.model import (
    LEGAL, Category, Column, Compression, Config, DataType, Encoding, InvalidArgError, Measurement, MeasurementGroup, NotFoundError, NullMask, Record, Registry,
    TableSchema, Tablet, TypeMismatchError, UnsupportedError, check_encoding, format_path, parse_path,
)


@pytest.mark.parametrize("path, segments", [
    ("root.sg1.d1", ["root", "sg1", "d1"]), ("root.`sg.1`.d1", ["root", "sg.1", "d1"]), ("", []), ("a..b", ["a", "", "b"]), (".a", ["", "a"]), ("a.", ["a", ""]), ("a", ["a"]),
])
def test_paths(path, segments):
    assert parse_path(path) == segments
    assert parse_path(format_path(segments)) == segments


def test_unclosed_quote():
    with pytest.raises(InvalidArgError):
        parse_path("root.`sg")


def test_segment_order_is_not_text_order():
    assert "a-b" < "a.b" and not parse_path("a-b") < parse_path("a.b")


@pytest.mark.parametrize("kind, codes", [(DataType, [0, 1, 2, 3, 4, 5, 6]), (Encoding, [0, 1, 2, 4, 8, 16, 32]), (Compression, [0, 1, 2, 3, 7])])
def test_codes(kind, codes):
    for code in range(40):
        if code in codes:
            assert int(kind.of(code)) == code
        else:
            with pytest.raises(InvalidArgError):
                kind.of(code)


def test_encodings():
    for kind in DataType:
        for encoding in Encoding:
            if encoding in LEGAL[kind]:
                check_encoding(kind, encoding)
            else:
                with pytest.raises(UnsupportedError):
                    Config().set_encoding(kind, encoding)
    assert sum(map(len, LEGAL.values())) == 1 + 6 + 6 + 4 + 4 + 2 + 2


def test_registry_keeps_the_first_and_group_the_last():
    r, g = Registry(), MeasurementGroup()
    for kind in (DataType.INT32, DataType.INT64):
        r.register("d", Measurement("m", kind))
        g.add(Measurement("m", kind))
    g.add(Measurement("a", DataType.INT32))
    assert r.need("d", "m").type is DataType.INT32 and g.get("m").type is DataType.INT64
    assert [m.name for m in g] == ["a", "m"]
    with pytest.raises(NotFoundError):
        r.need("d", "x")


def test_table_schema_round_trip():
    schema = TableSchema("weather", (Column("region", DataType.STRING, Category.TAG), Column("plant_id", DataType.INT32, Category.TAG), Column("temperature", DataType.FLOAT), Column("humidity", DataType.DOUBLE)))
    assert TableSchema.from_struct("weather", schema.struct()) == schema
    assert [c.name for c in schema.tags()] == ["region", "plant_id"] and [c.name for c in schema.fields()] == ["temperature", "humidity"]
    assert schema.find("humidity").type is DataType.DOUBLE and schema.find("x") is None


def test_record_types():
    r = Record("root.d1", 1000).add("t", DataType.FLOAT, 25.5).add_null("h")
    r.check_types({"t": DataType.FLOAT, "h": DataType.INT32})
    r.check_types({"other": DataType.INT32})
    r.check_types({})
    Record("d", 0).check_types({"t": DataType.FLOAT})
    with pytest.raises(TypeMismatchError) as e:
        r.check_types({"t": DataType.INT32})
    assert e.value.expected is DataType.INT32 and e.value.actual is DataType.FLOAT
    assert len(r) == 2 and r.find("t").value == 25.5 and r.find("x") is None


def test_null_mask():
    m = NullMask(10)
    m.set(0), m.set(9)
    assert m.to_bytes() == bytes([1, 2]) and m.count() == 2 and m.get(9) and not m.none_set()
    m.clear(0)
    assert NullMask(10, m.to_bytes()).count() == 1
    m.clear_all()
    assert m.none_set()
    with pytest.raises(InvalidArgError):
        m.get(10)


def test_tablet():
    t = Tablet("d", [Measurement("i", DataType.INT32), Measurement("s", DataType.TEXT)], capacity=3)
    t.add_time(0, 11), t.add_time(1, 20)
    t.set(0, 0, 5), t.set(1, 1, "x")
    assert t.rows() == [(11, 5, None), (20, None, b"x")] and t.is_null(0, 1)
    for bad in (lambda: t.add_time(0, 10), lambda: t.add_time(3, 0), lambda: t.set(0, 2, 1), lambda: t.add_time(9, 0)):
        with pytest.raises(InvalidArgError):
            bad()
    for bad in ("x", True, 1 << 40, 1.5):
        with pytest.raises(TypeMismatchError):
            t.set(0, 0, bad)
    t.set_null(0, 0)
    assert t.is_null(0, 0)
    t.reset()
    assert len(t) == 0
