"""Queries over small topics with known results: scans, predicates, merges, as-of joins, paging, output, errors."""

import math

import pytest
from pyspark.sql import functions as F

from riverlog.engine import Engine
from riverlog.errors import FieldNotFoundError, FieldTypeError, PlanError, TableNotFoundError
from riverlog.operators import asof
from riverlog.sources.base import Topics

NUMBERS = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "bigint", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "f32": "float", "f64": "double"}


@pytest.fixture(scope="module")
def engine(spark):
    """Topics t0 to t9 of one producer: row c has c in all numbers, "hello", and the log time c + i * c."""
    source = Topics()
    data = F.struct(*(F.col("id").cast(kind).alias(name) for name, kind in NUMBERS.items()), F.lit("hello").alias("s"), (F.col("id") % 2 == 0).alias("b"))
    for i in range(10):
        source.add(f"t{i}", spark.range(5).select((F.col("id") * (1 + i)).alias("log_time"), F.lit("device").alias("producer"), F.col("id").alias("sequence"), data.alias("data")))
    return Engine(spark, source)


def run(engine, text, **more):
    return [f"{r['topic']}:{r['log_time']}" for r in engine.query(text, **more).collect()]


def times(engine, text):
    return [r["log_time"] for r in engine.query(text).collect()]


def test_scans(engine):
    assert times(engine, "from device t0;") == [0, 1, 2, 3, 4]
    assert times(engine, "from device t0 desc;") == [4, 3, 2, 1, 0]
    assert times(engine, "from device t0 where t0.u8 = 100;") == []
    assert times(engine, "from * between 2 and 6 t1;") == [2, 4]
    assert times(engine, "from device between 6 and 2 t1;") == []


@pytest.mark.parametrize("name", NUMBERS)
@pytest.mark.parametrize("op, want", [("=", [1]), ("<", [0]), (">", [2, 3, 4]), ("<=", [0, 1]), (">=", [1, 2, 3, 4]), ("!=", [0, 2, 3, 4])])
def test_numbers(engine, name, op, want):
    assert times(engine, f"from device t0 where t0.{name} {op} 1;") == want


@pytest.mark.parametrize("op, n", [("= 'hello'", 5), ("<= 'hello'", 5), (">= 'hello'", 5), ("< 'hello'", 0), ("> 'hello'", 0), ("!= 'hello'", 0), ("~ 'ello'", 5), ("~ '^ello'", 0), ("~ '^hello$'", 5), ("~* 'HeLLo'", 5), ("~ 'HeLLo'", 0)])
def test_text(engine, op, n):
    assert len(times(engine, f"from device t0 where t0.s {op};")) == n


def test_boolean_logic(engine):
    assert times(engine, "from device t0 where t0.b = true;") == [0, 2, 4]
    assert times(engine, "from device t0 where t0.b != true;") == [1, 3]
    assert times(engine, "from device t0 where t0.u8 = 1 or t0.u8 = 3;") == [1, 3]
    assert times(engine, "from device t0 where (t0.u8 = 1 or t0.u8 = 3) and t0.i8 > 1;") == [3]
    assert times(engine, "from device t0 where t0.u8 = 1 or t0.u8 >= 3 and t0.b = true;") == [1, 4]


@pytest.mark.parametrize(
    "text, want",
    [
        ("t0, t1", "t0:0 t1:0 t0:1 t0:2 t1:2 t0:3 t0:4 t1:4 t1:6 t1:8"),
        ("t0, t1 where t1.u8 = 0", "t0:0 t1:0 t0:1 t0:2 t0:3 t0:4"),
        ("t0, t1 where t0.u8 = 0 or t1.u8 = 0", "t0:0 t1:0"),
        ("t0 precedes t1 by less than 2 nanoseconds", "t0:0 t1:0 t0:2 t1:2 t0:4 t1:4"),
        ("t0 succeeds t1 by less than 2 nanoseconds", "t1:0 t0:0 t0:1 t1:2 t0:2 t0:3 t1:4 t0:4"),
        ("t1 precedes t8 by less than 100 nanoseconds", "t1:0 t8:0 t1:8 t8:9 t8:18 t8:27 t8:36"),
        ("t1 precedes immediate t8 by less than 100 nanoseconds", "t1:0 t8:0 t1:8 t8:9"),
        ("t0 precedes immediate t1 by less than 10 nanoseconds where t0.u8 = 0", "t0:0 t1:0"),
        ("t0 as a, t1 as b where a.u8 = 0 or b.u8 = 0", "t0:0 t1:0"),
        ("t0 as a, t1 where a.u8 = 0 or t1.u8 = 0", "t0:0 t1:0"),
        ("t0 as a precedes t1 as b by less than 10 nanoseconds where a.u8 = 0 or b.u8 = 0", "t0:0 t1:0"),
        ("t0 as a precedes t1 as b by less than 10 nanoseconds where a.u8 = 0 or b.u8 = 0 limit 1", "t0:0"),
        ("t0 as a precedes t1 as b by less than 10 nanoseconds where a.u8 = 0 or b.u8 = 0 offset 1", "t1:0"),
        ("t0 precedes t1 by less than 2 nanoseconds desc", "t1:4 t0:4 t1:2 t0:2 t1:0 t0:0"),
        ("t0, t0", "t0:0 t0:0 t0:1 t0:1 t0:2 t0:2 t0:3 t0:3 t0:4 t0:4"),
    ],
)
def test_queries(engine, text, want):
    got = run(engine, f"from device {text};")
    assert got == want.split() or "desc" in text and sorted(got) == sorted(want.split()) and [x.split(":")[1] for x in got] == [x.split(":")[1] for x in want.split()]


def frame(spark, times, branch):
    return spark.createDataFrame([(t, "p", branch, k) for k, t in enumerate(times)], "log_time long, producer string, branch int, sequence long")


CASES = [
    ([0, 1, 2, 3, 4], [0, 2, 4, 6, 8], False, 2, [0, 0, 2, 2, 4, 4]),
    ([1, 5, 10], [4, 7, 15], True, 0, [1, 4, 5, 7, 10, 15]),
    ([1, 3, 5, 10], [4, 7, 15], True, 0, [3, 4, 5, 7, 10, 15]),
    ([1, 3, 4, 10], [4, 7, 15], True, 2, [4, 4]),
    ([], [1, 2], False, 0, []),
    ([1, 2], [], False, 0, []),
    ([5], [1, 4], False, 0, []),
]


@pytest.mark.parametrize("left, right, immediate, within, want", CASES)
@pytest.mark.parametrize("bucket", [0, 1, 3, 1000])
def test_as_of_rows(spark, left, right, immediate, within, want, bucket):
    l, r = frame(spark, left, 0), frame(spark, right, 1)
    out = asof.bucketed_rows(l, r, bucket, immediate, within) if bucket else asof.rows(l, r, immediate, within)
    assert [x["log_time"] for x in out.orderBy("log_time", "branch", "sequence").collect()] == want


def brute_as_of(rows, immediate, within):
    """rows: (time, side, number) in order; the kept ones."""
    out, last, fresh = [], None, False
    for t, side, k in rows:
        if side == 0:
            last, fresh = (t, side, k), True
        elif last is not None and (not within or t - last[0] < within) and (fresh or not immediate):
            # the first right row after a left one brings it along; an immediate match is that first row alone
            if fresh:
                out.append(last)
            out.append((t, side, k))
            fresh = False
        elif last is not None:
            fresh = False
    return sorted(out)


@pytest.mark.parametrize("immediate", [False, True])
@pytest.mark.parametrize("within", [0, 4])
def test_as_of_against_a_loop(spark, immediate, within):
    import random

    rng = random.Random(within * 2 + immediate)
    left, right = (sorted(rng.randint(0, 300) for _ in range(80)) for _ in range(2))
    rows = sorted([(t, 0, k) for k, t in enumerate(left)] + [(t, 1, k) for k, t in enumerate(right)])
    for bucket in (0, 7):
        l, r = frame(spark, left, 0), frame(spark, right, 1)
        out = asof.bucketed_rows(l, r, bucket, immediate, within) if bucket else asof.rows(l, r, immediate, within)
        assert sorted((x["log_time"], x["branch"], x["sequence"]) for x in out.collect()) == brute_as_of(rows, immediate, within)


def test_large_producers_are_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(asof, "SMALL_BYTES", 0)
    left = spark.range(400).select((F.col("id") * 3).alias("log_time"), F.when(F.col("id") < 300, "p").otherwise("q").alias("producer"), F.lit(0).alias("branch"), F.col("id").alias("sequence"))
    right = left.select((F.col("log_time") + 1).alias("log_time"), "producer", F.lit(1).alias("branch"), "sequence")
    assert asof.bucket_width(left, right) == 0  # no producer is large
    monkeypatch.setattr(asof, "PARTITION_ROWS", 50)
    width = asof.bucket_width(left, right)
    assert 0 < width < 900
    both = left.union(right).where("producer = 'p'")
    assert both.groupBy(F.expr(f"log_time div {width}")).count().agg(F.max("count")).first()[0] <= 100
    assert sorted(asof.spread_rows(left, right, True, 2).collect()) == sorted(asof.rows(left, right, True, 2).collect())


def test_pairs(spark):
    out = asof.pairs(frame(spark, [1, 5, 10], 0), frame(spark, [4, 7, 8, 15], 1))
    assert sorted((r["left"]["log_time"], r["right"]["log_time"]) for r in out.collect()) == [(1, 4), (5, 7), (5, 8), (10, 15)]
    out = asof.neighbor_pairs(frame(spark, [1, 5], 0), frame(spark, [4, 7], 1), within=2)
    assert sorted((r["left"]["log_time"], r["right"]["log_time"], r["left_first"]) for r in out.collect()) == [(5, 4, False)]


def test_several_producers_are_joined_each_for_itself(spark):
    rows = [("p", 1, "a"), ("q", 2, "a"), ("p", 3, "b"), ("q", 4, "b"), ("r", 5, "b")]
    source = Topics()
    for topic in "ab":
        source.add(topic, spark.createDataFrame([(t, p, k, (1,)) for k, (p, t, x) in enumerate(rows) if x == topic], "log_time long, producer string, sequence long, data struct<v:int>"))
    e = Engine(spark, source)
    assert run(e, "from * a precedes b;") == ["a:1", "a:2", "b:3", "b:4"]
    assert run(e, "from q, p a precedes b;") == ["a:1", "a:2", "b:3", "b:4"]
    assert run(e, "from q a precedes b;") == ["a:2", "b:4"]
    assert run(e, "from * a, b;") == ["a:1", "a:2", "b:3", "b:4", "b:5"]


def test_ties_follow_the_order_of_naming(spark):
    source = Topics()
    for topic in "ab":
        source.add(topic, spark.createDataFrame([(7, p, k, (1,)) for k, p in enumerate("qp")], "log_time long, producer string, sequence long, data struct<v:int>"))
    got = [(r["producer"], r["topic"]) for r in Engine(spark, source).query("from q, p b, a;").collect()]
    assert got == [("q", "b"), ("q", "a"), ("p", "b"), ("p", "a")]


@pytest.mark.parametrize("n, want", [(0, []), (1, [0]), (2, [0, 1]), (9, [0, 1, 2, 3, 4])])
def test_limit(engine, n, want):
    assert times(engine, f"from device t0 limit {n};") == want


@pytest.mark.parametrize("n, want", [(0, [0, 1, 2, 3, 4]), (3, [3, 4]), (5, []), (9, [])])
def test_offset(engine, n, want):
    assert times(engine, f"from device t0 offset {n};") == want


def test_paging(engine):
    assert times(engine, "from device t0 limit 2 offset 1;") == times(engine, "from device t0 offset 1 limit 2;") == [1, 2]
    assert run(engine, "from device t0 offset 1;", limit=2, offset=1) == ["t0:2", "t0:3"]
    assert run(engine, "from device t0 limit 3;", limit=0, offset=0) == ["t0:0", "t0:1", "t0:2"]


def test_skeleton_and_payloads(engine):
    assert not any(c.startswith("data") for c in engine.query("from device t0, t1;", skeleton=True).columns)
    rows = engine.query("from device t0, t1;").collect()
    assert all((r["data_0"] is None) == (r["topic"] == "t1") and (r["data_1"] is None) == (r["topic"] == "t0") for r in rows)


def test_explain(engine):
    (row,) = engine.query("explain from device t0, t1 where t0.u8 = 3;").collect()
    assert "merge\n  scan t0 as t0 where t0.u8 = 3\n  scan t1 as t1" in row["plan"] and "Physical Plan" in row["plan"]


@pytest.mark.parametrize(
    "text, error",
    [
        ("from device t0 where t0.nothing = 1;", FieldNotFoundError),
        ("from device t0 where t0.u8.x = 1;", FieldNotFoundError),
        ("from device t0 where t0.u8 = 'a';", FieldTypeError),
        ("from device t0 where t0.u8 = 1.5;", FieldTypeError),
        ("from device t0 where t0.s = 1;", FieldTypeError),
        ("from device t0 where t0.u8 ~ '1';", FieldTypeError),
        ("from device t0 where t0.b > true;", FieldTypeError),
        ("from device t0 where t0.u8 = true;", FieldTypeError),
        ("from device nowhere;", TableNotFoundError),
        ("from nobody t0;", TableNotFoundError),
        ("truncate device t0 now;", PlanError),
    ],
)
def test_errors(engine, text, error):
    with pytest.raises(error):
        engine.query(text)


def test_nan_compares_as_ieee_has_it(spark):
    rows = [(k, "p", k, (x, [x, 1.0])) for k, x in enumerate([1.0, math.nan, math.inf, -math.inf])]
    e = Engine(spark, Topics().add("t", spark.createDataFrame(rows, "log_time long, producer string, sequence long, data struct<x:double,a:array<double>>")))
    assert times(e, "from p t where t.x > 0.5;") == [0, 2]
    assert times(e, "from p t where t.x >= 1;") == [0, 2]
    assert times(e, "from p t where t.x < 2;") == [0, 3]
    assert times(e, "from p t where t.x != 1;") == [1, 2, 3]
    assert times(e, "from p t where t.a[1] = 1 and t.a[0] < 5;") == [0, 3]
    assert times(e, "from p t where t.a[7] = 1;") == []


def test_schemas_that_differ(spark):
    source = Topics()
    source.add("t", spark.createDataFrame([(1, "p", 1, ("x",))], "log_time long, producer string, sequence long, data struct<a:string>"))
    source.add("t", spark.createDataFrame([(2, "p", 2, ("x", "y"))], "log_time long, producer string, sequence long, data struct<a:string,b:string>"))
    e = Engine(spark, source)
    assert times(e, "from p t;") == [1, 2] and times(e, "from p t where t.a = 'x';") == [1, 2]
    with pytest.raises(FieldNotFoundError):
        e.query("from p t where t.b = 'y';")
    assert len({r["schema_hash"] for r in e.query("from p t;").collect()}) == 2


def test_json_lines(spark):
    rows = [(100, "p", 3, ('say "hi"', bytearray(b"\x10\x11"), [1, 2], (5,)))]
    e = Engine(spark, Topics().add("/foo", spark.createDataFrame(rows, "log_time long, producer string, sequence long, data struct<s:string,raw:binary,a:array<int>,r:struct<u8:int>>")))
    (line,) = e.json_lines("from p /foo;").collect()
    assert line["line"] == '{"topic":"/foo","sequence":3,"log_time":0.000000100,"publish_time":0.000000100,"data":{"s":"say \\"hi\\"","raw":"EBE=","a":[1,2],"r":{"u8":5}}}'


def test_predicates_reach_the_scan(spark, data):
    from riverlog.queries import engine as over

    e = over(spark, data)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.query("from * between '2024-01-05' and '2024-01-12' /purchase where /purchase.value > 50;")._jdf.queryExecution().toString()
    assert "GreaterThan(value,50.0)" in plan and "EqualTo(event_type,purchase)" in plan and "GreaterThanOrEqual(ts" in plan
    narrow = e.query("from * /purchase;", skeleton=True)._jdf.queryExecution().toString()
    assert "props" not in narrow.split("ReadSchema")[-1]
