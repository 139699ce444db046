"""The log store: ingest, de-duplication, deletes, truncation, exports, tails, catalog; and visibility rules on their own."""

import pytest
from pyspark.sql import functions as F

from riverlog.engine import Engine
from riverlog.errors import TableNotFoundError
from riverlog.operators.visibility import deduplicated, masked, without_range
from riverlog.sources.store import BUCKET_NS, LogStore, databases
from riverlog.streaming import tail as tails

SECOND = 10**9
EVER = (1 << 63) - 1


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}")


def rows(spark, times, producer="p", first=0, value="hello"):
    return spark.createDataFrame([(producer, first + k, t, (value, 2024)) for k, t in enumerate(times)], "producer string, sequence long, log_time long, data struct<data:string,count:smallint>")


def seen(store, topic="t", **more):
    return sorted(r["log_time"] // SECOND for f in store.frames(topic, **more) for r in f.collect())


def play(spark, store, script):
    """w(a,b) writes rows at a and b seconds, d(a,b) deletes [a, b)."""
    for step in script.split():
        a, b = (int(x) * SECOND for x in step[2:-1].split(","))
        if step[0] == "w":
            store.ingest(rows(spark, [a, b]), "t")
        else:
            store.delete("p", "t", a, b)


@pytest.mark.parametrize(
    "script, want",
    [
        ("w(10,50)", [10, 50]),
        ("w(60,100) w(10,50)", [10, 50, 60, 100]),
        ("w(10,50) w(40,70)", [10, 40, 50, 70]),
        ("w(40,70) w(10,50)", [10, 40, 50, 70]),
        ("w(10,50) w(5,15)", [5, 10, 15, 50]),
        ("w(15,20) w(5,10)", [5, 10, 15, 20]),
        ("w(10,50) d(10,20)", [50]),
        ("w(10,50) d(20,30)", [10, 50]),
        ("w(10,50) d(40,51)", [10]),
        ("w(10,50) d(40,50)", [10, 50]),
        ("w(10,50) d(40,70) w(60,100)", [10, 60, 100]),
        ("w(10,50) d(40,70) w(60,100) d(90,120)", [10, 60]),
        ("w(10,50) d(5,20) d(40,60)", []),
        ("w(10,20) w(30,40) w(60,80) d(15,35)", [10, 40, 60, 80]),
        ("w(10,20) w(30,40) w(60,80) d(15,65)", [10, 80]),
    ],
)
def test_writes_and_deletes(spark, store, script, want):
    play(spark, store, script)
    assert seen(store) == want


def test_rows_that_are_there_are_not_added_again(spark, store):
    store.ingest(rows(spark, [10, 12, 10, 12]).withColumn("sequence", F.lit(0)), "t")
    assert len(store.frames("t")[0].collect()) == 2
    store.ingest(rows(spark, [12, 13]).withColumn("sequence", F.lit(0)), "t")
    assert sorted(r["log_time"] for r in store.frames("t")[0].collect()) == [10, 12, 13]
    store.ingest(rows(spark, [10], producer="q").withColumn("sequence", F.lit(0)), "t")
    assert store.frames("t")[0].count() == 4
    store.delete("p", "t", 0, 100)
    store.ingest(rows(spark, [12]).withColumn("sequence", F.lit(0)), "t")  # hidden rows keep nothing out
    assert sorted((r["producer"], r["log_time"]) for r in store.frames("t")[0].collect()) == [("p", 12), ("q", 10)]


def test_truncation(spark, store):
    play(spark, store, "w(10,50)")
    engine = Engine(spark, store)
    written = store.catalog("commits").agg(F.max("written_at")).first()[0]
    play(spark, store, "w(20,60)")
    engine.query(f"truncate p t {written};")
    assert seen(store) == [20, 60]
    engine.query("truncate p t now;")
    assert seen(store) == []
    play(spark, store, "w(10,70)")
    assert seen(store) == [10, 70]
    assert [r["log_time"] for r in engine.query("from p t;").collect()] == [10 * SECOND, 70 * SECOND]


def test_versions_and_history(spark, store):
    first = store.ingest(rows(spark, [10 * SECOND]), "t")
    store.delete("p", "t", 0, EVER)
    last = store.ingest(rows(spark, [20 * SECOND], producer="q"), "t")
    assert (first, last) == (1, 3)
    assert seen(store, at_version=1) == [10] and seen(store, at_version=2) == [] and seen(store) == [20]
    assert seen(store, min_version=1) == [20] and seen(store, min_version=3) == []
    assert sorted(map(tuple, store.tables().collect())) == [("p", "t", 1), ("q", "t", 3)]
    assert [tuple(r) for r in store.producers(["t"]).orderBy("producer").collect()] == [("p", ["t"]), ("q", ["t"])]
    assert store.topics() == ["t"]
    engine = Engine(spark, store)
    counts = [engine.statistics("t", "count", ["count"], 0, 100, 60, at_version=v).collect() for v in (1, 2, 3)]
    assert [[r["count"] for r in x] for x in counts] == [[1], [], [1]]
    LogStore(spark, store.base.rpartition("/")[0], "a/b").ingest(rows(spark, [1]), "t")
    assert databases(spark, store.base.rpartition("/")[0]) == ["a/b", "db"] and databases(spark, store.base + "/nothing") == []


def test_schemas(spark, store):
    store.ingest(rows(spark, [10 * SECOND]), "t", "test", "ros1msg", "string data\nint16 count\n")
    two = spark.createDataFrame([("p", 0, 100 * SECOND, ("a", "b"))], "producer string, sequence long, log_time long, data struct<data:string,more:string>")
    store.ingest(two, "t", "test", "ros1msg", "string data\nstring more\n")
    assert [f.count() for f in store.frames("t")] == [1, 1]
    hashes = {r["schema_hash"] for f in store.frames("t") for r in f.collect()}
    assert len(hashes) == 2 and {store.schema(h)["name"] for h in hashes} == {"test"}
    with pytest.raises(TableNotFoundError):
        store.schema("nothing")
    engine = Engine(spark, store)
    assert [r["log_time"] // SECOND for r in engine.query("from p t where t.data ~ '.';").collect()] == [10, 100]
    kinds = engine.statrange("t", 0, 200 * SECOND, 600 * SECOND, quantiles=None)
    assert kinds.where("type = 'message' and name = 'messageCount'").count() == 2  # a row for each schema


def test_export_and_tail(spark, store):
    for k, times in enumerate([[10, 100, 1000], [15, 200, 2000], [20, 300, 3000]]):
        store.ingest(rows(spark, times), f"topic-{k}")

    def export(topics, start, end):
        found, versions = store.export(topics, start, end)
        return None if found is None else [r["log_time"] for r in found.collect()], versions

    assert export({"topic-0": 0}, 0, 1001)[0] == [10, 100, 1000]
    assert export({"topic-0": 0}, 10, 1000)[0] == [10, 100]
    assert export({"topic-0": 0}, 100, 1001)[0] == [100, 1000]
    assert export({"topic-0": 0, "topic-1": 0}, 13, 16)[0] == [15]
    got, versions = export({f"topic-{k}": 0 for k in range(3)}, 0, 1001)
    assert got == [10, 15, 20, 100, 200, 300, 1000] and versions == {"topic-0": 1, "topic-1": 2, "topic-2": 3}
    assert export(versions, 0, 1001) == (None, versions)
    assert export({"nothing": 0}, 0, 1001) == (None, {"nothing": 0})
    found = list(tails.tail(store, ["topic-0"], polls=2, idle_s=0))
    assert [r["log_time"] for r in found[0].collect()] == [10, 100, 1000] and len(found) == 1


def test_buckets_are_pruned(spark, store):
    store.ingest(rows(spark, [5, BUCKET_NS + 5, 9 * BUCKET_NS + 5]), "t")
    (frame,) = store.frames("t", (BUCKET_NS, 2 * BUCKET_NS))
    assert [r["log_time"] for r in frame.collect()] == [BUCKET_NS + 5]
    plan = frame._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:300]


def test_compaction_keeps_what_is_visible(spark, store):
    play(spark, store, "w(10,50) w(20,30) d(25,60) w(40,45)")
    before = seen(store)
    version = store.compact("t")
    assert seen(store) == before == [10, 20, 40, 45]
    assert {r["version"] for f in store.frames("t") for r in f.collect()} <= {1, 2, 4} and version == 5
    assert store.compact("nothing") is None


def two_schemas(spark, store):
    store.ingest(rows(spark, [k * SECOND for k in range(5)]), "t")
    other = spark.createDataFrame([("p", k, (10 + k) * SECOND, ("a", "b")) for k in range(5)], "producer string, sequence long, log_time long, data struct<data:string,more:string>")
    store.ingest(other, "t")
    store.ingest(rows(spark, [BUCKET_NS + 5], first=50), "t")


def test_compaction_of_two_schemas(spark, store):
    two_schemas(spark, store)
    store.ingest(rows(spark, [3 * SECOND], producer="q"), "t")
    store.delete("p", "t", 1 * SECOND, 3 * SECOND)
    store.truncate("q", "t")
    want = [0, 3, 4, 10, 11, 12, 13, 14, BUCKET_NS // SECOND]
    then = store.version()
    assert seen(store) == want
    first = store.compact("t")
    assert seen(store) == want and seen(store, at_version=then) == want and seen(store, at_version=2) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    assert seen(store, min_version=2) == [BUCKET_NS // SECOND]  # a tail sees no row anew
    assert store.export({"t": 4}, 0, EVER)[0] is None
    # what comes after works on rewritten rows as on others
    store.ingest(rows(spark, [3 * SECOND, 99 * SECOND], first=3), "t")  # one of them is there already
    assert seen(store) == sorted([*want, 99])
    store.delete("p", "t", 10 * SECOND, 12 * SECOND)
    want = [0, 3, 4, 12, 13, 14, 99, BUCKET_NS // SECOND]
    assert seen(store) == want
    second = store.compact("t")
    assert seen(store) == want and second > first and len(store.files("t").select("version").distinct().collect()) == 1
    assert store.vacuum("t") and seen(store) == want and not store.vacuum("t")
    store.truncate("p", "t")
    assert seen(store) == []
    store.compact("t")
    assert seen(store) == [] and store.files("t").count() == 0
    store.ingest(rows(spark, [7 * SECOND]), "t")
    assert seen(store) == [7]


def test_truncation_by_time_after_compaction(spark, store):
    store.ingest(rows(spark, [10 * SECOND]), "t")
    between = max(r["written_at"] for r in store.catalog("commits").collect())
    store.ingest(rows(spark, [20 * SECOND], first=9), "t")
    store.compact("t")
    store.truncate("p", "t", between)
    assert seen(store) == [20]


@pytest.mark.parametrize("step", ["_write", "_append"])
def test_compaction_that_fails_changes_nothing(spark, store, monkeypatch, step):
    two_schemas(spark, store)
    before, calls = seen(store), []

    def fail(*args, original=getattr(LogStore, step)):
        calls.append(args)
        if len(calls) == (2 if step == "_write" else 1):  # after the files of the first schema; before the catalog's
            raise OSError("lost")
        return original(*args)

    with monkeypatch.context() as m:
        m.setattr(LogStore, step, fail)
        with pytest.raises(OSError):
            store.compact("t")
    assert seen(store) == before and store.catalog("rewrites").count() == 0
    store.compact("t")
    assert seen(store) == before


def test_commits_during_a_compaction_stay(spark, store, monkeypatch):
    two_schemas(spark, store)
    before, late = seen(store), []

    def first(self, *args, original=LogStore._write):
        if not late:
            late.append(1)
            store.ingest(rows(spark, [77 * SECOND], first=70), "t")
        return original(self, *args)

    monkeypatch.setattr(LogStore, "_write", first)
    store.compact("t")
    assert seen(store) == sorted([*before, 77])


def test_each_writer_has_versions_of_its_own(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    others = [LogStore(spark, store.base.rpartition("/")[0]) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda s: s._claim(), others))
    assert sorted(found) == list(range(1, 9))


def test_failed_writes_stay_invisible(spark, store):
    play(spark, store, "w(10,50)")
    (hash_, _, _) = store._hashes("t")[0]
    stray = rows(spark, [60 * SECOND]).select("log_time", "producer", F.lit("t").alias("topic"), "sequence", F.col("log_time").alias("publish_time"), F.lit(hash_).alias("schema_hash"), F.lit(None).cast("long").alias("size_bytes"), "data", F.lit(0).alias("bucket"))
    stray.write.partitionBy("bucket").parquet(f"{store._path('t', hash_)}/version=99")  # no commit follows
    assert seen(store) == [10, 50]


def test_streams(spark, store, tmp_path):
    rows(spark, [10 * SECOND, 20 * SECOND]).write.parquet(str(tmp_path / "in"))
    schema = "producer string, sequence long, log_time long, data struct<data:string,count:smallint>"
    for _ in range(2):  # a second run finds nothing new
        tails.ingest_stream(tails.read_messages(spark, str(tmp_path / "in"), schema), store, "t", str(tmp_path / "check")).awaitTermination(120)
    assert seen(store) == [10, 20]
    rows(spark, [15 * SECOND], first=5).write.mode("append").parquet(str(tmp_path / "in"))  # late
    tails.ingest_stream(tails.read_messages(spark, str(tmp_path / "in"), schema), store, "t", str(tmp_path / "check")).awaitTermination(120)
    assert seen(store) == [10, 15, 20]


def test_repeated_rows_of_a_stream(spark, tmp_path):
    frame = spark.createDataFrame([("p", "t", 10, 1), ("p", "t", 10, 1), ("p", "t", 11, 1)], "producer string, topic string, log_time long, sequence long")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("log_time"))
    out = tails.deduplicated(stream, "at", "10 minutes").writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("dedup").count() == 2


def test_merge_with_dedupe_and_mask(spark):
    def pairs(*values):
        return spark.createDataFrame(list(values), "log_time long, sequence long")

    a, b = pairs((1, 1), (2, 2), (3, 3)), pairs((1, 4), (2, 5), (3, 6))
    assert [tuple(r) for r in masked(a.union(b), pairs().limit(0)).collect()] == [(1, 1), (1, 4), (2, 2), (2, 5), (3, 3), (3, 6)]
    assert [tuple(r) for r in masked(pairs((1, 1), (1, 1)), pairs().limit(0)).collect()] == [(1, 1)]
    assert [tuple(r) for r in masked(pairs((1, 1), (1, 1), (2, 2)), pairs((1, 1))).collect()] == [(2, 2)]


def test_repeated_keys_keep_the_first_published(spark):
    batch = spark.createDataFrame([("p", "t", 1, 1, 9, "late"), ("p", "t", 1, 1, 3, "first")], "producer string, topic string, log_time long, sequence long, publish_time long, x string")
    assert [r["x"] for r in deduplicated(batch).collect()] == ["first"]


def test_ranges_without_a_range():
    assert without_range([(0, 10)], 3, 5) == [(0, 3), (5, 10)]
    assert without_range([(0, 10)], 0, 10) == [] and without_range([(0, 10)], 10, 20) == [(0, 10)]
    assert without_range([(0, 4), (6, 9)], 3, 7) == [(0, 3), (7, 9)]


def test_deduplication_of_keys(spark):
    schema = "producer string, topic string, log_time long, sequence long, publish_time long, x string"
    batch = spark.createDataFrame([("p", "/t", 1, 1, 9, "later"), ("p", "/t", 1, 1, 3, "first"), ("p", "/t", 2, 1, 1, "stored"), (None, "/t", 3, None, 2, "null"), (None, "/t", 3, None, 1, "null first"), ("q", "/t", 4, 1, 1, "alone")], schema)
    stored = spark.createDataFrame([("p", "/t", 2, 1), ("p", "/t", 9, 9), ("p", "/t", 9, 9)], "producer string, topic string, log_time long, sequence long")
    assert sorted(r["x"] for r in deduplicated(batch, stored).collect()) == ["alone", "first", "null first"]
    assert sorted(r["x"] for r in deduplicated(batch.where("x in ('stored', 'alone')"), unique=True).collect()) == ["alone", "stored"]
    assert deduplicated(batch.limit(0), stored).count() == 0
