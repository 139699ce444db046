"""Message definitions, ros1 bytes, MCAP files, flattened names."""

import struct

import pytest
from pyspark.sql import types as T

from riverlog.engine import Engine
from riverlog.errors import RiverlogError
from riverlog.functions.rosmsg import PRIMITIVES, Decoder, DefinitionError, encode, parse, spark_type
from riverlog.functions.schema import flatten
from riverlog.sources import mcap
from riverlog.sources.store import LogStore

#: A message with each primitive, records and both kinds of arrays.
EVERYTHING = """
# a comment
uint8 u8
uint16 u16
uint32 u32
uint64 u64
int8 i8
int16 i16
int32 i32
int64 i64
float32 f32
float64 f64
string s
bool b
time t
duration d
char c
byte y
int32 LIMIT=7
string NAME=a name # with a mark
my_type flat_record
my_type[] varlen_array
my_type[1] fixed_array
uint8[] raw
float64[3] cov
===
MSG: pkg/my_type
uint8 u8
"""
VALUES = (1, 2, 3, 4, 5, 6, 7, 8, 9.0, 10.0, "hello", True, 11 * 10**9, 12 * 10**9, 13, 14, (15,), [(16,), (17,)], [(18,)], b"\x01\x02", [1.0, 2.0, 3.0])


def test_definitions():
    fields = parse(EVERYTHING)
    assert [f.name for f in fields[:4]] == ["u8", "u16", "u32", "u64"] and "LIMIT" not in {f.name for f in fields}
    kind = spark_type(fields)
    assert kind["u8"].dataType == T.ShortType() and kind["raw"].dataType == T.BinaryType() and kind["cov"].dataType == T.ArrayType(T.DoubleType())
    assert kind["varlen_array"].dataType == T.ArrayType(T.StructType([T.StructField("u8", T.ShortType())]))
    names = [f.name for f in flatten(kind)]
    assert names[-5:] == ["fixed_array[0].u8", "raw", "cov[0]", "cov[1]", "cov[2]"]
    assert "varlen_array" not in " ".join(names)


def test_long_arrays_have_no_names():
    kind = spark_type(parse("float64[9] a\nfloat64[10] b\nfloat64[] c\nstring d"))
    assert [f.name for f in flatten(kind)] == [*(f"a[{k}]" for k in range(9)), "d"]


def test_headers_and_packages():
    text = "Header header\nPose pose\n===\nMSG: std_msgs/Header\nuint32 seq\ntime stamp\nstring frame_id\n===\nMSG: geometry_msgs/Pose\nPoint position\n===\nMSG: geometry_msgs/Point\nfloat64 x\n"
    assert [f.name for f in flatten(spark_type(parse(text)))] == ["header.seq", "header.stamp", "header.frame_id", "pose.position.x"]


def test_ros2_definitions():
    text = "int32<=5 a\nstring<=10 s\nint32[<=4] b\nint32 c 7\nwstring w\ngeometry_msgs/msg/Point p\nint32 X=3\n===\nMSG: geometry_msgs/Point\nfloat64 x\n"
    fields = {f.name: f for f in parse(text, ros2=True)}
    assert (fields["s"].bound, fields["b"].bound, fields["b"].size, fields["c"].default) == (10, 4, 0, "7")
    assert fields["p"].record[0].name == "x" and "X" not in fields


@pytest.mark.parametrize("text", ["nothing x", "int32", "int32 a b", "string<=5 s", "A a\n===\nMSG: p/A\nA a"])
def test_bad_definitions(text):
    with pytest.raises(DefinitionError):
        parse(text)


def test_decoding_everything():
    fields = parse(EVERYTHING)
    raw = encode(fields, VALUES)
    assert Decoder(fields)(raw) == VALUES
    some = Decoder(fields, {"u16", "s"})(raw)
    assert some[1] == 2 and some[10] == "hello" and some[0] is None and some[11] is None
    assert Decoder(fields, set())(b"") == (None,) * len(fields)  # nothing wanted, nothing read


@pytest.mark.parametrize("kind", sorted(set(PRIMITIVES) - {"string", "wstring", "time", "duration", "bool"}))
def test_primitives(kind):
    code = PRIMITIVES[kind][0]
    value = 1.5 if kind.startswith("float") else 100
    assert Decoder(parse(f"{kind} x"))(struct.pack("<" + code, value)) == (value,)


def test_unsigned_values_wrap_and_short_messages_fail():
    assert Decoder(parse("uint64 x"))(b"\xff" * 8) == (-1,)
    assert encode(parse("uint64 x"), (-1,)) == b"\xff" * 8
    for text, raw in [("string s", b"\x05\0\0\0ab"), ("uint8[] s", b"\x05\0\0\0ab"), ("int32 x", b"\0")]:
        with pytest.raises((RiverlogError, struct.error)):
            Decoder(parse(text))(raw)


def file(compression="zstd", n=3):
    fields = parse("string data\nint16 count")
    out = mcap.Writer(compression=compression, chunk_bytes=30)
    for k in range(n):
        for topic in ("topic-0", "topic-1"):
            out.add(topic, k, 10 * (k + 1), encode(fields, ("hello", 2024)), schema=("package/test", "ros1msg", b"string data\nint16 count"), metadata={"a": "b"})
    return out.close()


@pytest.mark.parametrize("compression", ["zstd", "lz4", ""])
def test_files(compression):
    got = list(mcap.messages(file(compression)))
    assert [(m.topic, m.sequence, m.log_time) for m in got] == [(t, k, 10 * (k + 1)) for k in range(3) for t in ("topic-0", "topic-1")]
    assert (got[0].schema_name, got[0].message_encoding, got[0].metadata, len(got[0].data)) == ("package/test", "ros1", {"a": "b"}, 11)
    assert list(mcap.messages(mcap.Writer().close())) == []


def test_damaged_files():
    good = file()
    for bad in (b"", b"x" * 100, good[:60]):
        with pytest.raises((RiverlogError, struct.error)):
            list(mcap.messages(bad))
    at = good.index(b"zstd") + 40
    with pytest.raises(Exception):
        list(mcap.messages(good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :]))


def test_import_query_and_write(spark, tmp_path):
    (tmp_path / "a.mcap").write_bytes(file())
    store = LogStore(spark, f"file://{tmp_path}/store")
    assert mcap.import_file(store, str(tmp_path / "a.mcap"), "robot") == {"topic-0": 1, "topic-1": 2}
    engine = Engine(spark, store)
    rows = engine.query("from robot topic-0, topic-1 where topic-0.count = 2024 or topic-1.count = 1;").collect()
    assert [(r["topic"], r["log_time"]) for r in rows] == [("topic-0", 10), ("topic-0", 20), ("topic-0", 30)]
    assert rows[0]["data_0"]["data"] == "hello" and rows[0]["size_bytes"] == 11
    mcap.import_file(store, str(tmp_path / "a.mcap"), "robot")  # again: nothing new
    assert engine.query("from robot topic-1;").count() == 3
    (frame,) = store.frames("topic-0")
    mcap.write(frame.orderBy("log_time"), str(tmp_path / "b.mcap"), "string data\nint16 count", "package/test")
    back = mcap.read(spark, str(tmp_path / "b.mcap"))
    assert [(r["sequence"], bytes(r["raw"])) for r in back.collect()] == [(m.sequence, m.data) for m in mcap.messages(file()) if m.topic == "topic-0"]


def test_other_encodings_are_named(spark, tmp_path):
    out = mcap.Writer()
    out.add("a", 1, 5, b"\x01\0\0\0", schema=("p/A", "ros1msg", b"int32 x"))
    out.add("b", 1, 6, b"{}", schema=("B", "jsonschema", b"{}"), encoding="json")
    (tmp_path / "a.mcap").write_bytes(out.close())
    store = LogStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(RiverlogError, match="1 of topic b in json"):
        mcap.import_file(store, str(tmp_path / "a.mcap"), "robot")
    assert mcap.import_file(store, str(tmp_path / "a.mcap"), "robot", skip_others=True) == {"a": 1}
    assert [r["data_0"]["x"] for r in Engine(spark, store).query("from robot a;").collect()] == [1]
    assert not (tmp_path / "store" / "db" / "staging").exists() or not list((tmp_path / "store" / "db" / "staging").iterdir())


def test_results_of_several_topics(spark, tmp_path):
    (tmp_path / "a.mcap").write_bytes(file())
    store = LogStore(spark, f"file://{tmp_path}/store")
    mcap.import_file(store, str(tmp_path / "a.mcap"), "robot")
    engine, text = Engine(spark, store), "from robot topic-0, topic-1;"
    mcap.write_result(engine.query(text), str(tmp_path / "b.mcap"), mcap.schemas_of(store))
    key = lambda m: (m.topic, m.sequence, m.log_time, m.definition, m.data)
    got = list(mcap.messages((tmp_path / "b.mcap").read_bytes()))
    assert [key(m) for m in got] == [key(m) for m in mcap.messages(file())]
    mcap.write_result(engine.query(text, skeleton=True), str(tmp_path / "c.mcap"), mcap.schemas_of(store))
    bare = list(mcap.messages((tmp_path / "c.mcap").read_bytes()))
    assert [(m.topic, m.log_time) for m in bare] == [(m.topic, m.log_time) for m in got] and {(m.data, m.definition) for m in bare} == {(b"", b"")}
    mcap.write_result(engine.query("from robot topic-0 limit 0;"), str(tmp_path / "d.mcap"), mcap.schemas_of(store))
    assert list(mcap.messages((tmp_path / "d.mcap").read_bytes())) == []


NESTED = "string head\nInner one\nInner[] many\nInner[2] two\nint32 last\n===\nMSG: p/Inner\nfloat64[] d\nstring name\nuint8[] raw\nint16 n\n"


@pytest.mark.parametrize("wanted", [{"one.n"}, {"many.name"}, {"two.raw", "head"}, {"one", "many.n", "last"}, {"one.d", "two"}])
def test_nested_projection(wanted):
    inner = [([1.5] * k, "x" * k, bytes(k), k) for k in range(4)]
    values = ("head", inner[1], inner, inner[2:], 7)
    fields = parse(NESTED)

    def chosen(fields, values, under=""):
        out = []
        for f, v in zip(fields, values, strict=True):
            name = under + f.name
            if name in wanted:
                out.append(v)
            elif not any(w.startswith(name + ".") for w in wanted):
                out.append(None)
            elif f.size is None:
                out.append(chosen(f.record, v, name + "."))
            else:
                out.append([chosen(f.record, x, name + ".") for x in v])
        return tuple(out)

    assert Decoder(fields, wanted)(encode(fields, values)) == chosen(fields, values)


@pytest.mark.parametrize("name", ["none", "one.none", "last.x"])
def test_unknown_projection(name):
    with pytest.raises(DefinitionError):
        Decoder(parse(NESTED), {name})
