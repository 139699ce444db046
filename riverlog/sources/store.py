"""A versioned log store on Parquet.

    <base>/messages/<topic>/<schema hash>/version=<v>/bucket=<b>/*.parquet
    <base>/catalog/{commits, rewrites, schemas, deletes, truncations}/*.parquet
    <base>/catalog/versions/<v>

Each change is a commit with a version of its own, which is claimed by creating a file that isn't there yet, so that no two writers have the
same: files first, then rows in one file of the catalog. Readers see only versions in the catalog, so a write that fails half-way stays
invisible; readers need no lock. Two writers of the same keys at one time may both add them, as neither sees the other. A bucket is
245 760 s of log time; range scans prune by bucket and, in files, by the statistics of log_time, as files are sorted.
"""

from __future__ import annotations

import json
import os
import time
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableNotFoundError
from ..operators.asof import estimated_bytes
from ..operators.visibility import deduplicated, visible
from .base import Between, enveloped, schema_hash

BUCKET_NS = 245_760 * 10**9
#: Bytes, as the optimizer estimates them, that a writing task should have.
TASK_BYTES = 256 << 20
_CATALOG = {
    "commits": "version long, topic string, schema_hash string, written_at long, rows long",
    "rewrites": "version long, topic string, schema_hash string, written_at long, rows long, replaces array<long>",
    "producers": "version long, producer string, topic string",
    "schemas": "hash string, name string, encoding string, definition string, spark_type string",
    "deletes": "producer string, topic string, start_ns long, end_ns long, version long",
    "truncations": "producer string, topic string, version long, truncated_at long, made_at_version long",
}


def databases(spark: SparkSession, base: str) -> list[str]:
    """The names of the databases in the folder ``base``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(unquote(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


class LogStore:
    """A database in the folder ``base``, which any Hadoop file system may hold."""

    def __init__(self, spark: SparkSession, base: str, database: str = "db"):
        self.spark, self.base, self.database = spark, f"{base.rstrip('/')}/{quote(database, safe='')}", database

    # catalog

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def catalog(self, name: str) -> DataFrame:
        """One of ``commits``, ``producers``, ``schemas``, ``deletes``, ``truncations``."""
        path = f"{self.base}/catalog/{name}"
        return self.spark.read.schema(_CATALOG[name]).parquet(path) if self._there(path) else self.spark.createDataFrame([], _CATALOG[name])

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _CATALOG[name]).coalesce(1).write.mode("append").parquet(f"{self.base}/catalog/{name}")

    def version(self) -> int:
        """The highest version in use."""
        columns = (("commits", "version"), ("rewrites", "version"), ("deletes", "version"), ("truncations", "version"), ("truncations", "made_at_version"))
        return max(self.catalog(n).agg(F.max(c)).first()[0] or 0 for n, c in columns)

    def _create(self, path: str) -> bool:
        """Creates an empty file; False if it's there already. Hadoop's local file system looks first and creates then, so local files are
        created by the operating system."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        uri = fs.makeQualified(p).toUri()
        if uri.getScheme() == "file":
            os.makedirs(os.path.dirname(uri.getPath()), exist_ok=True)
            try:
                os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            return fs.createNewFile(p)
        except Py4JJavaError as e:  # another writer was faster between Hadoop's look and its creation
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

    def _claim(self) -> int:
        """The next version, for this writer alone: the file system lets just one create its file."""
        version = self.version() + 1
        while not self._create(f"{self.base}/catalog/versions/{version}"):
            version += 1
        return version

    def topics(self) -> list[str]:
        return sorted(r[0] for r in self.catalog("commits").select("topic").distinct().collect())

    def producers(self, topics: list[str] | None = None) -> DataFrame:
        """(producer, topics): all producers, or those with any of ``topics``."""
        rows = self.catalog("producers")
        rows = rows if topics is None else rows.where(F.col("topic").isin(*topics))
        return rows.groupBy("producer").agg(F.array_sort(F.collect_set("topic")).alias("topics"))

    def tables(self, history: bool = False) -> DataFrame:
        """(producer, topic, version): the last commit of each table, or all of them."""
        rows = self.catalog("producers").select("producer", "topic", "version")
        return rows.distinct() if history else rows.groupBy("producer", "topic").agg(F.max("version").alias("version"))

    def schema(self, hash_: str) -> dict:
        """Name, encoding and definition of a schema by hash."""
        found = self.catalog("schemas").where(F.col("hash") == hash_).limit(1).collect()
        if not found:
            raise TableNotFoundError(f"schema {hash_} not found")
        return found[0].asDict()

    def _hashes(self, topic: str, at_version: int | None = None) -> list[tuple[str, T.StructType, list[int]]]:
        """(hash, payload type, versions whose files count) in the order of the schemas' first commits; as the store was at ``at_version``."""
        then = F.lit(True) if at_version is None else F.col("version") <= at_version
        commits = self.catalog("commits").where((F.col("topic") == topic) & then).select("schema_hash", "version").collect()
        rewrites = self.catalog("rewrites").where((F.col("topic") == topic) & then).select("schema_hash", "version", "replaces").collect()
        gone = {v for r in rewrites for v in r["replaces"]}
        first: dict[str, int] = {}
        live: dict[str, set[int]] = {}
        for r in sorted([*commits, *rewrites], key=lambda r: r["version"]):
            first.setdefault(r["schema_hash"], r["version"])
            if r["version"] not in gone:
                live.setdefault(r["schema_hash"], set()).add(r["version"])
        kinds = {r["hash"]: r["kind"] for r in self.catalog("schemas").where(F.col("hash").isin(*first)).groupBy("hash").agg(F.first("spark_type").alias("kind")).collect()} if first else {}
        return [(h, T.StructType.fromJson(json.loads(kinds[h])), sorted(live.get(h, ()))) for h in sorted(first, key=first.get) if h in kinds]

    # reading

    def _path(self, topic: str, hash_: str) -> str:
        return f"{self.base}/messages/{quote(topic, safe='')}/{hash_}"

    def stored(self, topic: str, between: Between = None, hashes: list[str] | None = None, at_version: int | None = None, live: list | None = None) -> list[DataFrame]:
        """Committed rows, one frame for each schema in the order of their first commit, whether visible or not. A rewritten row keeps
        the version that it had."""
        out = []
        for hash_, kind, versions in self._hashes(topic, at_version) if live is None else live:
            if hashes is not None and hash_ not in hashes:
                continue
            schema = T.StructType.fromDDL("log_time long, producer string, topic string, sequence long, publish_time long, schema_hash string, size_bytes long").add("data", kind).add("row_version", T.LongType()).add("version", T.LongType()).add("bucket", T.LongType())
            rows = self.spark.read.schema(schema).parquet(self._path(topic, hash_)).where(F.col("version").isin(*versions) if versions else F.lit(False))
            if between is not None:
                start, end = between
                rows = rows.where((F.col("bucket") >= start // BUCKET_NS) & (F.col("bucket") <= (max(end, start + 1) - 1) // BUCKET_NS) & (F.col("log_time") >= F.lit(start)) & (F.col("log_time") < F.lit(end)))
            out.append(rows.select("log_time", "producer", "topic", "sequence", "publish_time", "schema_hash", "size_bytes", F.coalesce("row_version", "version").alias("version"), "data"))
        return out

    def frames(self, topic: str, between: Between = None, min_version: int | None = None, at_version: int | None = None, live: list | None = None) -> list[DataFrame]:
        """Visible rows. min_version: only newer ones; at_version: as the store was then; live: of these versions (as ``_hashes`` gives them)."""
        deletes, cuts = (self.catalog(n).where(F.col("topic") == topic) for n in ("deletes", "truncations"))
        if at_version is not None:
            deletes, cuts = deletes.where(F.col("version") <= at_version), cuts.where(F.coalesce("made_at_version", "version") <= at_version)
        counts = (deletes.count(), cuts.count())
        out = []
        for rows in self.stored(topic, between, at_version=at_version, live=live):
            out.append(visible(rows, deletes if counts[0] else None, cuts if counts[1] else None, min_version, counts))
        return out

    def missing(self, topic: str, producers: tuple[str, ...]) -> list[str]:
        known = {r[0] for r in self.catalog("producers").where((F.col("topic") == topic) & F.col("producer").isin(*producers)).select("producer").distinct().collect()}
        return [p for p in producers if p not in known]

    # writing

    def _write(self, new: DataFrame, topic: str, hash_: str, version: int) -> DataFrame:
        """Writes the files of a version, and returns what they hold. A bucket is spread over tasks by producer and time, so that one of them
        may be large; there are more tasks where there are more bytes."""
        new = new.withColumn("bucket", F.expr(f"log_time div {BUCKET_NS}L"))
        path = f"{self._path(topic, hash_)}/version={version}"
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, estimated_bytes(new) // TASK_BYTES))
        spread = new.repartitionByRange(n, "bucket", "producer", "log_time", "sequence").sortWithinPartitions("bucket", "producer", "log_time", "sequence")
        spread.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(new.schema).parquet(path)

    def ingest(self, rows: DataFrame, topic: str, name: str = "", encoding: str = "", definition: str | None = None, between: Between = None, unique: bool = False) -> int:
        """Adds rows (producer, sequence, log_time, data, optionally publish_time and size_bytes) that aren't there yet, and
        returns the version. A visible row with the same (producer, log_time, sequence) keeps a new one out; late rows are welcome.
        between: a range of ns that has all rows, where it is known; else the rows are read for it. unique: no key is repeated in ``rows``."""
        batch = enveloped(rows.drop("version", "topic", "schema_hash"), topic, definition)
        hash_, version = schema_hash(batch.schema["data"].dataType, definition), self._claim()
        # stored rows that can be the same lie in the batch's range of time: the buckets of other times aren't read
        if between is None:
            low, high = batch.agg(F.min("log_time"), F.max("log_time")).first()
            between = (0, 0) if low is None else (low, high + 1)
        old = [f.select("producer", "topic", "log_time", "sequence") for f in self.frames(topic, between)]
        stored = old[0] if old else None
        for f in old[1:]:
            stored = stored.union(f)
        written = self._write(deduplicated(batch, stored, unique=unique).drop("version"), topic, hash_, version)
        producers = [(version, r[0], topic) for r in written.select("producer").distinct().toLocalIterator()]
        if hash_ not in {h for h, _, _ in self._hashes(topic)}:
            self._append("schemas", [(hash_, name, encoding, definition or batch.schema["data"].dataType.simpleString(), batch.schema["data"].dataType.json())])
        if producers:
            self._append("producers", producers)
        self._append("commits", [(version, topic, hash_, time.time_ns(), written.count())])
        return version

    def delete(self, producer: str, topic: str, start_ns: int, end_ns: int) -> int:
        """Hides what is stored now with a log time in [start_ns, end_ns)."""
        version = self._claim()
        self._append("deletes", [(producer, topic, start_ns, end_ns, version)])
        return version

    def truncate(self, producer: str, topic: str, time_ns: int | None = None) -> int:
        """Hides what was written at or before ``time_ns`` (wall clock), by default all that is stored now, and returns the last version that
        it hides. The truncation has a later version of its own, before which readers don't see it."""
        commits = self.catalog("commits").where(F.col("topic") == topic)
        commits = commits if time_ns is None else commits.where(F.col("written_at") <= time_ns)
        version, made = commits.agg(F.max("version")).first()[0] or 0, self._claim()
        self._append("truncations", [(producer, topic, version, time.time_ns() if time_ns is None else time_ns, made)])
        return version

    def export(self, topics: dict[str, int], start_ns: int, end_ns: int, producers: list[str] | None = None) -> tuple[DataFrame | None, dict[str, int]]:
        """Visible rows of topics newer than the given version each, in time order, and the versions to ask from next time.
        The payload is JSON, as topics differ. None: there is nothing new."""
        versions = {r["topic"]: r["v"] for r in self.catalog("commits").where(F.col("topic").isin(*topics)).groupBy("topic").agg(F.max("version").alias("v")).collect()}
        parts = []
        for branch, (topic, least) in enumerate(topics.items()):
            if versions.get(topic, 0) <= least:
                continue
            for f in self.frames(topic, (start_ns, end_ns), least):
                f = f if producers is None else f.where(F.col("producer").isin(*producers))
                parts.append(f.withColumn("data", F.to_json("data")).withColumn("branch", F.lit(branch)))
        upto = {t: max(v, versions.get(t, 0)) for t, v in topics.items()}
        if not parts:
            return None, upto
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy("log_time", "branch", "producer", "sequence").drop("branch"), upto

    def compact(self, topic: str) -> int | None:
        """Rewrites the visible rows of a topic, of all its schemas, as one version, and returns it (None: there is nothing).

        Nothing changes for readers: rows keep their versions, so that tails don't see them as new, and later deletes and truncations by time
        hide what they would have hidden. The new files and the versions that they replace enter the catalog together, in one file; what fails before
        leaves everything as it was. A commit that comes meanwhile isn't among the replaced ones. Readers at an older version still have the old
        files, until ``vacuum`` removes them.
        """
        before = self._hashes(topic)
        replaces = sorted({v for _, _, versions in before for v in versions})
        if not replaces:
            return None
        version, found = self._claim(), []
        for (hash_, _, _), rows in zip(before, self.frames(topic, at_version=version, live=before), strict=True):
            written = self._write(rows.withColumnRenamed("version", "row_version"), topic, hash_, version)
            found.append((version, topic, hash_, time.time_ns(), written.count(), replaces))
        self._append("rewrites", found)
        return version

    def vacuum(self, topic: str) -> list[str]:
        """Removes the files that rewrites have replaced, and returns their folders. Readers at a version before the last rewrite lose them."""
        rewrites = self.catalog("rewrites").where(F.col("topic") == topic).select("replaces").collect()
        gone, jvm, out = {v for r in rewrites for v in r["replaces"]}, self.spark.sparkContext._jvm, []
        for hash_, _, _ in self._hashes(topic):
            for v in sorted(gone):
                path = f"{self._path(topic, hash_)}/version={v}"
                if self._there(path):
                    p = jvm.org.apache.hadoop.fs.Path(path)
                    p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
                    out.append(path)
        return out

    def files(self, topic: str) -> DataFrame:
        """What a topic's tables are made of: (schema_hash, version, bucket, rows, files, low, high) of the files that count."""
        parts = []
        for hash_, kind, versions in self._hashes(topic):
            schema = T.StructType.fromDDL("log_time long, version long, bucket long")
            rows = self.spark.read.schema(schema).parquet(self._path(topic, hash_)).where(F.col("version").isin(*versions) if versions else F.lit(False))
            rows = rows.withColumn("file", F.input_file_name())
            parts.append(rows.groupBy(F.lit(hash_).alias("schema_hash"), "version", "bucket").agg(F.count("*").alias("rows"), F.count_distinct("file").alias("files"), F.min("log_time").alias("low"), F.max("log_time").alias("high")))
        if not parts:
            return self.spark.createDataFrame([], "schema_hash string, version long, bucket long, rows long, files long, low long, high long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
