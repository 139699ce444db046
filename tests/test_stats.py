"""Statistics over time bins, quantiles, roll-ups, trigram signatures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riverlog.engine import Engine
from riverlog.errors import FieldNotFoundError, FieldTypeError, PlanError, TableNotFoundError
from riverlog.functions import trigrams
from riverlog.operators import stats
from riverlog.sources.base import Topics
from riverlog.sources.store import LogStore

S = stats.SECOND


def topic(spark, times, producer="p"):
    return spark.createDataFrame([(t, producer, k, 11, ("hello", 2024)) for k, t in enumerate(times)], "log_time long, producer string, sequence long, size_bytes long, data struct<data:string,count:smallint>")


def engine(spark, frame):
    return Engine(spark, Topics().add("t", frame))


def bins(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["start"] // S, r["end"] // S), {})[r["field"], r["name"]] = r["value"] if r["text_value"] is None else r["text_value"]
    return out


def want(n, low, high):
    return {("count", "mean"): 2024.0, ("count", "min"): 2024.0, ("count", "max"): 2024.0, ("count", "sum"): 2024.0 * n, ("count", "count"): n, ("data", "min"): "hello", ("data", "max"): "hello", ("", "messageCount"): n, ("", "bytesUncompressed"): 11.0 * n, ("", "minObservedTime"): low, ("", "maxObservedTime"): high}


def test_statrange(spark):
    e = engine(spark, topic(spark, [10, 100, 1000, 90 * S]))
    one, two = want(3, 10, 1000), want(1, 90 * S, 90 * S)
    assert bins(e.statrange("t", 0, 1001, 600 * S, quantiles=None)) == {(0, 60): one}
    assert bins(e.statrange("t", 0, 100 * S, 600 * S, quantiles=None)) == {(0, 60): one, (60, 120): two}
    assert bins(e.statrange("t", 0, 100 * S, 38_400 * S, quantiles=None)) == {(0, 3840): want(4, 10, 90 * S)}
    assert bins(e.statrange("t", 100, 60 * S, 600 * S, quantiles=None)) == {(0, 60): one}  # half-open: the next bin isn't touched
    assert bins(e.statrange("t", 60 * S, 61 * S, 600 * S, quantiles=None)) == {(60, 120): two}


@pytest.mark.parametrize("how", ["exact", "approx", "sketch"])
def test_quantiles(spark, how):
    rng = random.Random(1)
    values = [rng.uniform(-50, 400) for _ in range(3000)] + [0.0, math.nan, math.inf]
    frame = spark.createDataFrame([(k, "p", k, (v,)) for k, v in enumerate(values)], "log_time long, producer string, sequence long, data struct<x:double>")
    got = {r["name"]: r["value"] for r in engine(spark, frame).statrange("t", 0, 10**9, 60 * S, quantiles=how).where("name like 'P%'").collect()}
    ordered = sorted(v for v in values if math.isfinite(v))
    for name, q in stats.QUANTILES.items():
        exact = ordered[int(q * (len(ordered) - 1))]
        assert abs(got[name] - exact) <= abs(exact) * 0.011 + 0.5


def test_values_that_are_not_finite_are_left_out(spark):
    frame = spark.createDataFrame([(k, "p", k, (x,)) for k, x in enumerate([math.nan, math.inf, -math.inf, 100.0])], "log_time long, producer string, sequence long, data struct<x:double>")
    (row,) = engine(spark, frame).statistics("t", "x", ["mean", "min", "max", "count", "messageCount"], 0, 60, 60).collect()
    assert (row["mean"], row["min"], row["max"], row["count"], row["messageCount"]) == (100, 100, 100, 1, 4)


def test_statistics(spark):
    frame = topic(spark, [10, 100, 90 * S]).union(topic(spark, [50], "q"))
    e = engine(spark, frame)
    rows = e.statistics("t", "count", ["count", "P50"], 0, 100, 60).orderBy("start").collect()
    assert [(r["start"] // S, r["end"] // S, r["count"], r["P50"]) for r in rows] == [(0, 60, 3, 2024), (60, 120, 1, 2024)]
    assert [r["count"] for r in e.statistics("t", "count", ["count"], 0, 100, 60, producer="q").collect()] == [1]
    by = e.statistics("t", "data", ["min"], 0, 50, 70, by_producer=True).orderBy("producer").collect()
    assert [(r["producer"], r["min"]) for r in by] == [("p", "hello"), ("q", "hello")]


def test_errors(spark):
    e = engine(spark, topic(spark, [1]).withColumn("data", F.struct("data.*", F.lit(True).alias("b"))))
    for field, names, error in [("nothing", ["min"], FieldNotFoundError), ("b", ["min"], FieldTypeError), ("count", ["sum"], FieldNotFoundError), ("data", ["mean"], FieldNotFoundError)]:
        with pytest.raises(error):
            e.statistics("t", field, names, 0, 1, 60)
    with pytest.raises(PlanError, match="too granular"):
        e.statistics("t", "count", ["min"], 0, 1, 59)
    with pytest.raises(TableNotFoundError):
        e.statistics("other", "count", ["min"], 0, 1, 60)


@pytest.mark.parametrize("asked, width", [(60, 60), (3839, 60), (3840, 3840), (245_759, 3840), (245_760, 245_760), (10**12, 1_006_632_960)])
def test_granularity_snaps_to_the_widths(asked, width):
    assert stats.snap(asked * S) == width


def test_partials_merge_to_the_same_statistics(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**13), rng.choice("pq"), k, 7, (f"x{rng.randrange(99):02}", rng.randrange(100))) for k in range(500)]
    frame = Topics().add("t", spark.createDataFrame(rows, "log_time long, producer string, sequence long, size_bytes long, data struct<data:string,count:int>")).frames("t")[0]
    fine = stats.partials(frame, 60, by=("producer", "schema_hash"))
    columns = ["start", "type", "n", "total", "low", "high", "text_low", "text_high", "observed_low", "observed_high"]
    rolled = stats.merged(stats.merged(fine, 60, ("schema_hash",)), 3840, ()).select(F.coalesce("field", F.lit("")).alias("field"), *columns)
    direct = stats.partials(frame, 3840, by=()).select(F.coalesce("field", F.lit("")).alias("field"), *columns)
    assert sorted(map(str, rolled.collect())) == sorted(map(str, direct.collect()))


def test_statistics_see_visible_rows_only(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}")
    e = Engine(spark, store)
    store.ingest(topic(spark, [10 * S, 50 * S]), "t")
    store.delete("p", "t", 40 * S, 60 * S)
    assert [r["count"] for r in e.statistics("t", "count", ["count"], 0, 100, 60).collect()] == [1]
    assert [(r["producer"], r["messages"], r["bytes"]) for r in e.tables().collect()] == [("p", 1, 11)]


def test_available_statistics(spark):
    frame = spark.createDataFrame([(1, "p", 1, ("a", (1.5, True), [1.0]))], "log_time long, producer string, sequence long, data struct<s:string,r:struct<x:double,b:boolean>,a:array<double>>")
    got = {r["field"]: (r["type"], r["statistics"]) for r in engine(spark, frame).available_statistics("t").collect()}
    assert got == {"s": ("text", ["min", "max"]), "r.x": ("numeric", ["mean", "min", "max", "count", *stats.QUANTILES])}


def test_trigrams_never_deny_what_is_there(spark):
    words = ["hello world", "foo", "ab", None, "barbaz", "ünïcode"]
    groups = spark.createDataFrame([(k % 2, w) for k, w in enumerate(words)], "g int, w string")
    signed = groups.select("g", trigrams.signature(F.col("w")).alias("sig")).groupBy("g").agg(trigrams.merge("sig").alias("sig"))
    got = groups.join(signed, "g").select("w", trigrams.may_contain(F.col("sig"), F.col("w")).alias("may"), trigrams.may_contain(F.col("sig"), F.lit("zzzqqq")).alias("other")).collect()
    assert all(r["may"] for r in got) and not all(r["other"] for r in got)
