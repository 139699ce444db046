"""Reading and writing MCAP files (the public format for timestamped messages), uncompressed or with zstd or lz4 chunks.

``read`` gives the messages of files as rows by the ``binaryFile`` reader, one file a task; ``messages`` is the parser, and ``Writer``
makes files.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RiverlogError
from ..functions.rosmsg import Decoder, encode, parse, spark_type

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, DATA_END = 1, 2, 3, 4, 5, 6, 15


class Message(NamedTuple):
    topic: str
    sequence: int
    log_time: int
    publish_time: int
    schema_name: str
    schema_encoding: str
    definition: bytes
    message_encoding: str
    metadata: dict
    data: bytes


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, code: str):
        values = struct.unpack_from("<" + code, self.raw, self.at)
        self.at += struct.calcsize("<" + code)
        return values[0] if len(values) == 1 else values

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise RiverlogError("the file ends within a record")
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self) -> str:
        return self.bytes(self.take("I")).decode()


def _records(raw: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at < len(raw):
        if at + 9 > len(raw):
            raise RiverlogError("the file ends within a record")
        op, n = struct.unpack_from("<BQ", raw, at)
        if at + 9 + n > len(raw):
            raise RiverlogError("the file ends within a record")
        yield op, raw[at + 9 : at + 9 + n]
        at += 9 + n
        if op == FOOTER:
            return


def messages(raw: bytes) -> Iterator[Message]:
    """All messages of a file in file order. Unknown records are skipped."""
    if raw[:8] != MAGIC:
        raise RiverlogError("not an MCAP file")
    schemas: dict[int, tuple] = {0: ("", "", b"")}
    channels: dict[int, tuple] = {}

    def walk(records):
        for op, body in records:
            c = _Cursor(body)
            if op == SCHEMA:
                number = c.take("H")
                schemas[number] = (c.text(), c.text(), c.bytes(c.take("I")))
            elif op == CHANNEL:
                number, schema, topic, encoding = c.take("H"), c.take("H"), c.text(), c.text()
                end, metadata = c.take("I") + c.at, {}
                while c.at < end:
                    key = c.text()
                    metadata[key] = c.text()
                channels[number] = (topic, encoding, metadata, schema)
            elif op == MESSAGE:
                number, sequence, log_time, publish_time = c.take("HIQQ")
                if number not in channels:
                    raise RiverlogError(f"a message of channel {number}, which isn't declared")
                topic, encoding, metadata, schema = channels[number]
                yield Message(topic, sequence, log_time, publish_time, *schemas[schema], encoding, metadata, body[c.at :])
            elif op == CHUNK:
                _, _, size, crc, how = c.take("Q"), c.take("Q"), c.take("Q"), c.take("I"), c.text()
                data = c.bytes(c.take("Q"))
                if how == "zstd":
                    import zstandard

                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                elif how == "lz4":
                    data = pa.decompress(data, size, "lz4", asbytes=True)
                elif how:
                    raise RiverlogError(f"chunks compressed with {how} can't be read")
                if len(data) != size or crc and zlib.crc32(data) != crc:
                    raise RiverlogError("a chunk is damaged")
                yield from walk(_records(data))

    yield from walk(_records(raw, 8))


class Writer:
    """Writes messages to ``sink`` (anything with ``write``) chunk by chunk; without one, ``close`` returns the bytes of the file. Equal schemas
    and channels are written once. compression: "zstd", "lz4" or "" for none."""

    def __init__(self, profile: str = "ros1", chunk_bytes: int = 4 << 20, compression: str = "zstd", sink=None):
        self.sink = io.BytesIO() if sink is None else sink
        self.kept = sink is None
        self.sink.write(MAGIC + self._record(HEADER, self._text(profile) + self._text("riverlog")))
        self.chunk, self.size, self.times = [], 0, []
        self.chunk_bytes, self.compression = chunk_bytes, compression
        self.schemas: dict[tuple, int] = {}
        self.channels: dict[tuple, int] = {}

    @staticmethod
    def _text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<I", len(raw)) + raw

    @staticmethod
    def _record(op: int, body: bytes) -> bytes:
        return struct.pack("<BQ", op, len(body)) + body

    def add(self, topic: str, sequence: int, log_time: int, data: bytes, publish_time: int | None = None, schema: tuple[str, str, bytes] = ("", "", b""), encoding: str = "ros1", metadata: dict | None = None) -> None:
        if schema not in self.schemas:
            self.schemas[schema] = len(self.schemas) + 1
            name, kind, definition = schema
            self.chunk.append(self._record(SCHEMA, struct.pack("<H", self.schemas[schema]) + self._text(name) + self._text(kind) + struct.pack("<I", len(definition)) + definition))
        key = (topic, schema, encoding, tuple(sorted((metadata or {}).items())))
        if key not in self.channels:
            self.channels[key] = len(self.channels)
            pairs = b"".join(self._text(k) + self._text(v) for k, v in key[3])
            self.chunk.append(self._record(CHANNEL, struct.pack("<HH", self.channels[key], self.schemas[schema]) + self._text(topic) + self._text(encoding) + struct.pack("<I", len(pairs)) + pairs))
        self.chunk.append(self._record(MESSAGE, struct.pack("<HIQQ", self.channels[key], sequence, log_time, log_time if publish_time is None else publish_time) + data))
        self.size += len(self.chunk[-1])
        self.times.append(log_time)
        if self.size >= self.chunk_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.chunk:
            return
        raw = b"".join(self.chunk)
        packed = raw
        if self.compression == "zstd":
            import zstandard

            packed = zstandard.compress(raw)
        elif self.compression == "lz4":
            packed = pa.compress(raw, "lz4", asbytes=True)
        times = self.times or [0]
        self.sink.write(self._record(CHUNK, struct.pack("<QQQI", min(times), max(times), len(raw), zlib.crc32(raw)) + self._text(self.compression) + struct.pack("<Q", len(packed)) + packed))
        self.chunk, self.size, self.times = [], 0, []

    def close(self) -> bytes | None:
        self._flush()
        self.sink.write(self._record(DATA_END, struct.pack("<I", 0)) + self._record(FOOTER, struct.pack("<QQI", 0, 0, 0)) + MAGIC)
        return self.sink.getvalue() if self.kept else None


SCHEMA_DDL = "topic string, sequence long, log_time long, publish_time long, schema_name string, schema_encoding string, definition string, message_encoding string, metadata map<string,string>, raw binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The messages of all MCAP files in ``path``, undecoded. A file is read by one task."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows = []
                for m in messages(raw.as_py()):
                    rows.append({"topic": m.topic, "sequence": m.sequence, "log_time": m.log_time, "publish_time": m.publish_time, "schema_name": m.schema_name, "schema_encoding": m.schema_encoding, "definition": m.definition.decode("utf-8", "replace"), "message_encoding": m.message_encoding, "metadata": list(m.metadata.items()), "raw": m.data})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA_DDL)


_ARROW = pa.schema([("topic", pa.string()), ("sequence", pa.int64()), ("log_time", pa.int64()), ("publish_time", pa.int64()), ("schema_name", pa.string()), ("schema_encoding", pa.string()), ("definition", pa.string()), ("message_encoding", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("raw", pa.binary())])


def decoded(rows: DataFrame, topic: str, definition: str, producer: str, wanted: list[str] | None = None) -> DataFrame:
    """The messages of one topic and definition with their payload: rows that ``LogStore.ingest`` takes. wanted: dotted names of
    fields to decode, at any depth; others are null."""
    fields = parse(definition)
    kind = spark_type(fields)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        decode = Decoder(fields, set(wanted) if wanted is not None else None)
        for b in batches:
            data = pa.array([_named(kind, decode(x.as_py())) for x in b.column(3)], arrow)
            size = pa.array([len(x.as_py()) for x in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), size, data], ["sequence", "log_time", "publish_time", "size_bytes", "data"])

    chosen = rows.where((F.col("topic") == topic) & (F.col("definition") == definition)).select("sequence", "log_time", "publish_time", "raw")
    schema = T.StructType.fromDDL("sequence long, log_time long, publish_time long, size_bytes long").add("data", kind)
    return chosen.mapInArrow(run, schema).withColumn("producer", F.lit(producer))


def _named(kind: T.DataType, value):
    """Tuples of structs as dicts."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _named(f.dataType, v) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [_named(kind.elementType, v) for v in value]
    return value


def _payload(kind: T.DataType, value):
    """Rows of structs as tuples, as ``rosmsg.encode`` takes them."""
    if isinstance(kind, T.StructType):
        return tuple(_payload(f.dataType, value[f.name]) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_payload(kind.elementType, v) for v in value]
    return value


def import_file(store, path: str, producer: str, skip_others: bool = False) -> dict[str, int]:
    """Ingests all ros1 messages of the MCAP files in ``path`` into a ``LogStore``; returns the last version of each topic.

    Files are parsed once, for all topics; the undecoded messages wait in a folder of the store, which is removed at the end.
    Messages of other encodings can't be decoded: an error names them, unless ``skip_others``."""
    spark = store.spark
    staging = f"{store.base}/staging/{uuid.uuid4().hex}"
    read(spark, path).withColumn("kind", F.xxhash64("topic", "definition", "message_encoding")).write.option("compression", "zstd").partitionBy("kind").parquet(staging)
    try:
        rows = spark.read.parquet(staging)
        kinds = rows.groupBy("kind", "topic", "definition", "message_encoding").agg(F.max("schema_name").alias("name"), F.min("log_time").alias("low"), F.max("log_time").alias("high"), F.count("*").alias("n"), F.count_distinct("log_time", "sequence").alias("keys")).collect()
        others = sorted((r["topic"], r["message_encoding"], r["n"]) for r in kinds if not r["message_encoding"].startswith("ros1"))
        if others and not skip_others:
            raise RiverlogError("messages that can't be decoded: " + ", ".join(f"{n} of topic {t} in {e or 'an unnamed encoding'}" for t, e, n in others))
        out = {}
        for r in sorted(kinds, key=lambda r: (r["topic"], r["definition"])):
            if r["message_encoding"].startswith("ros1"):
                mine = decoded(rows.where(F.col("kind") == r["kind"]), r["topic"], r["definition"], producer)
                out[r["topic"]] = store.ingest(mine, r["topic"], r["name"], "ros1msg", r["definition"], (r["low"], r["high"] + 1), unique=r["keys"] == r["n"])
        return out
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _stream(uri: str):
    """Writes to a local path or the URI of any file system that pyarrow knows."""
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path) as sink:
        yield sink


def write(frame: DataFrame, path: str, definition: str, schema_name: str = "", topic_data: str = "data") -> None:
    """Writes a frame of one topic (topic, sequence, log_time, publish_time, payload) in its order to one MCAP file.

    The rows stream through the driver, a chunk of the file at a time. ``write_files`` writes many files from the executors."""
    fields = parse(definition)
    kind = frame.schema[topic_data].dataType
    with _stream(path) as sink:
        out = Writer(sink=sink)
        for r in frame.toLocalIterator():
            out.add(r["topic"], r["sequence"], r["log_time"], encode(fields, _payload(kind, r[topic_data])), r["publish_time"], (schema_name, "ros1msg", definition.encode()))
        out.close()


def write_files(frame: DataFrame, folder: str, definition: str, schema_name: str = "", topic_data: str = "data") -> DataFrame:
    """Writes a frame of one topic in the order of log_time to MCAP files below the URI ``folder``, one for each range of time, from the
    executors; returns (part, path, messages) of the files. A task that runs again writes a file of another name, which isn't among them:
    what counts is the stored table, which is written once."""
    spark, fields, kind = frame.sparkSession, parse(definition), frame.schema[topic_data].dataType
    rows = frame.select("topic", "sequence", "log_time", "publish_time", F.col(topic_data).alias("data"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "log_time", "sequence").sortWithinPartitions("log_time", "sequence")

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.mcap"
        with _stream(path) as sink:
            out = Writer(sink=sink)
            for b in batches:
                for r in b.to_pylist():
                    out.add(r["topic"], r["sequence"], r["log_time"], encode(fields, _payload(kind, r["data"])), r["publish_time"], (schema_name, "ros1msg", definition.encode()))
                count += b.num_rows
            out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "messages": pa.array([count], pa.int64())})

    done = f"{folder}/_files"
    rows.mapInArrow(run, "part int, path string, messages long").write.parquet(done)
    return spark.read.parquet(done)


def write_result(result: DataFrame, path: str, schemas: dict[str, tuple[str, str]]) -> None:
    """Writes the result of a query, with all its topics and schemas, in its order to one MCAP file.

    schemas: (name, definition) by schema hash, see ``schemas_of``. Equal schemas and channels are written once. A result without
    payloads gives messages without data, and schemas without definitions. As with ``write``, the rows stream through the driver."""
    kinds = {f.name: f.dataType for f in result.schema.fields if f.name.startswith("data_")}
    fields = {h: parse(d) for h, (_, d) in schemas.items()} if kinds else {}
    with _stream(path) as sink:
        out = Writer(sink=sink)
        for r in result.toLocalIterator():
            name, definition = schemas.get(r["schema_hash"], ("", ""))
            data = next((encode(fields[r["schema_hash"]], _payload(kinds[c], r[c])) for c in kinds if r[c] is not None), b"")
            out.add(r["topic"], r["sequence"], r["log_time"], data, r["publish_time"], (name, "ros1msg", definition.encode() if kinds else b""))
        out.close()


def schemas_of(store) -> dict[str, tuple[str, str]]:
    """(name, definition) of all ros1 schemas of a ``LogStore`` by hash."""
    return {r["hash"]: (r["name"], r["definition"]) for r in store.catalog("schemas").where("encoding = 'ros1msg'").collect()}
