"""Token files: a wavelet matrix for each shard.

Texts are encoded where they are read, their ids go to shards in the order of documents (range partitions), and each shard becomes one file:

    b"RLWM0001" | blocks | footer (zstd-compressed JSON) | footer's length (8 bytes) | b"RLWM0001"

A block holds up to ``BLOCK`` consecutive tokens of the shard, whatever documents they belong to, as a wavelet matrix: one bit plane
for each bit of the ids, the highest first, each followed by the stable partition of the tokens by that bit. Planes are
zstd-compressed; numbers of ones before every 512th bit are stored with them for rank and select. The footer has the
places of blocks, and documents with their lengths. One file answers access to tokens, counts of a token in any range, and
where its k-th occurrence is, reading only the blocks concerned.

Files are written under names of their own for each attempt; a table of the attempts that succeeded says which count. So a
lost executor or a second attempt leaves at most a file that nothing reads.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encode_texts
from .store import column, dealt, narrowed, new_dir, pieces, tune, written
from .textbytes import U

MAGIC = b"RLWM0001"
BLOCK = 1 << 18
#: Tokens of a shard that its ranges aim at, unless there are fewer shards than shuffle partitions.
SHARD = 1 << 25
_SAMPLE = 512


class WaveletMatrix:
    """A sequence of ids below 2**bits: ``planes`` as uint64 words, ``zeros`` by level, ``before``: ones before each word."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], sampled: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.before = []
        for k, p in enumerate(planes):
            ones = np.bitwise_count(p).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(ones)])
            if sampled is not None and not (total[:: _SAMPLE // 64][: len(sampled[k])] == sampled[k]).all():
                raise ValueError("the file is damaged: its counts of ones don't fit its planes")
            self.before.append(total)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a, planes, zeros = ids, [], []
        for k in range(bits - 1, -1, -1):
            bit = (a & a.dtype.type(1 << k)) != 0
            room = np.zeros(len(a) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            room.view(np.uint8)[: len(packed)] = packed
            planes.append(room)
            zero = np.compress(~bit, a)  # much faster than indexing by a mask
            zeros.append(len(zero))
            a = np.concatenate([zero, np.compress(bit, a)])
        return cls(len(ids), planes, zeros)

    @property
    def sampled(self) -> list[np.ndarray]:
        return [b[:: _SAMPLE // 64] for b in self.before]

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return ((self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & U(1)).astype(bool)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        word = self.planes[level][at >> 6] & ((U(1) << (at & 63).astype(np.uint64)) - U(1))
        return self.before[level][at >> 6] + np.bitwise_count(word)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for k, zero in enumerate(self.zeros):
            bit, ones = self._bit(k, at), self._ones(k, at)
            at = np.where(bit, zero + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """How often ``token`` occurs before each place."""
        lo, hi = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        if token >> len(self.planes):
            return lo
        for k, zero in enumerate(self.zeros):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (zero + a, zero + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``token``, or -1."""
        if k < 0 or k >= int(self.rank(token, np.array([self.n]))[0]):
            return -1
        lo = np.zeros(1, np.int64)
        for level, zero in enumerate(self.zeros):
            ones = self._ones(level, lo)
            lo = zero + ones if token >> (len(self.planes) - 1 - level) & 1 else lo - ones
        at = int(lo[0]) + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            count = self.before[level] if one else 64 * np.arange(len(self.before[level])) - self.before[level]
            word = int(np.searchsorted(count, want, side="right")) - 1
            bits = np.unpackbits(self.planes[level][word : word + 1].view(np.uint8), bitorder="little") == one
            at = 64 * word + int(np.flatnonzero(bits)[want - int(count[word])])
        return at

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions are undone from the lowest plane up."""
        a = np.zeros(self.n, np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~bit)], up[np.flatnonzero(bit)] = a[: self.zeros[k]], a[self.zeros[k] :] | np.uint32(1 << (len(self.planes) - 1 - k))
            a = up
        return a


class Writer:
    """Writes one shard file: ``add`` documents, then ``close``."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.size = stream, bits, len(MAGIC)
        self.press = zstandard.ZstdCompressor(level=1)
        self.wait, self.waiting, self.blocks, self.ids, self.lengths, self.n = [], 0, [], [], [], 0
        stream.write(MAGIC)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths += lengths.tolist()
        self.wait.append(ids.astype(np.uint16 if self.bits <= 16 else np.uint32))
        self.waiting += len(ids)
        while self.waiting >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint16)
        matrix = WaveletMatrix.of(every[:n], self.bits)
        self.wait, self.waiting = [every[n:]], len(every) - n
        raw = b"".join(p.tobytes() for p in matrix.planes) + b"".join(s.astype("<u4").tobytes() for s in matrix.sampled)
        data = self.press.compress(raw)
        self.blocks.append({"at": self.size, "size": len(data), "first": self.n, "n": min(n, len(every)), "zeros": matrix.zeros})
        self.n += min(n, len(every))
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> int:
        if self.waiting:
            self._flush(self.waiting)
        footer = self.press.compress(json.dumps({"bits": self.bits, "n": self.n, "blocks": self.blocks, "ids": self.ids, "lengths": self.lengths}).encode())
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        return self.n


class Shard:
    """Reads a shard file; ``ids`` and ``lengths`` of its documents in order."""

    def __init__(self, stream):
        self.stream, size = stream, stream.size()
        stream.seek(size - 16)
        tail = stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or an unfinished one")
        n = int.from_bytes(tail[:8], "little")
        stream.seek(size - 16 - n)
        got = json.loads(zstandard.decompress(stream.read(n)))
        self.bits, self.n, self.blocks, self.ids, self.lengths = (got[k] for k in ("bits", "n", "blocks", "ids", "lengths"))
        self.first = np.array([b["first"] for b in self.blocks] + [self.n], np.int64)
        self._last = (-1, None)

    def block(self, k: int) -> WaveletMatrix:
        if self._last[0] != k:
            b = self.blocks[k]
            self.stream.seek(b["at"])
            raw = zstandard.decompress(self.stream.read(b["size"]))
            words = b["n"] // 64 + 1
            planes = np.frombuffer(raw, "<u8", words * self.bits).reshape(self.bits, words)
            sampled = np.frombuffer(raw, "<u4", offset=8 * words * self.bits).reshape(self.bits, -1)
            self._last = (k, WaveletMatrix(b["n"], list(planes), b["zeros"], list(sampled)))
        return self._last[1]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids at start, ..., stop - 1."""
        out = [np.zeros(0, np.uint32)]
        while start < stop:
            k = int(np.searchsorted(self.first, start, side="right")) - 1
            end = min(stop, int(self.first[k + 1]))
            out.append(self.block(k).access(np.arange(start, end) - self.first[k]))
            start = end
        return np.concatenate(out)

    def count(self, token: int, start: int, stop: int) -> int:
        """How often ``token`` occurs at start, ..., stop - 1."""
        total = 0
        for k, b in enumerate(self.blocks):
            lo, hi = max(0, start - b["first"]), min(b["n"], stop - b["first"])
            if lo < hi:
                total += int(np.diff(self.block(k).rank(token, np.array([lo, hi])))[0])
        return total

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of ``token``, or -1."""
        for j, b in enumerate(self.blocks):
            n = int(self.block(j).rank(token, np.array([b["n"]]))[0])
            if 0 <= k < n:
                return b["first"] + self.block(j).select(token, k)
            k -= n
        return -1

    def documents(self):
        """(id, ids) of all documents in order; blocks are decoded one by one."""
        k, have, at = 0, np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.ids, self.lengths, strict=True):
            parts, need = [], n
            while need:
                if at == len(have):
                    have, at, k = self.block(k).decode(), 0, k + 1
                m = min(need, len(have) - at)
                parts.append(have[at : at + m])
                at, need = at + m, need - m
            yield doc_id, parts[0] if len(parts) == 1 else np.concatenate(parts or [have[:0]])


def open_shard(uri: str) -> Shard:
    where, path = fs.FileSystem.from_uri(uri)
    return Shard(where.open_input_file(path))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, bits: int = 16) -> DataFrame:
    """The stored (id, row, n, ids) of all rows: ids, with the end, are little-endian of 16 or 32 bits. Texts are encoded where they are
    read; only ids are shuffled later. The row number makes the order total and is the same on each attempt."""
    tune(docs.sparkSession)
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches):
        for b in pieces(batches, "text"):
            ids, off = encode_texts(path, column(b, "text"))
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"the tokenizer has ids of over {bits} bits")
            every, end = np.insert(ids, off[1:], end_id).astype(kind), off + np.arange(len(off))
            raw = pa.array([every[x:y].tobytes() for x, y in zip(end, end[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "row"), pa.array(np.diff(end)), raw], ["id", "row", "n", "ids"])

    chosen = narrowed(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return written(chosen.mapInArrow(run, "id long, row long, n long, ids binary"), "ids")


def write_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, bits: int = 16) -> DataFrame:
    """Writes all rows of ``docs`` in ascending order of id to shard files below the URI ``folder``, and returns the table of shards
    (shard, path, n_docs, n_tokens), in whose order the documents are. Ids are integers; null ids come first. Rows of one id
    follow each other in the order of the input, so that a frequent id can be spread over shards. Null texts are empty.
    Without rows there are no shards or empty ones. The number of shards grows with the tokens: about ``SHARD`` each at most."""
    spark = docs.sparkSession
    ids, kind = encoded(docs, path, id_col, text_col, end_id, bits), "<u2" if bits <= 16 else "<u4"
    total = ids.agg(F.sum("n")).first()[0] or 0
    n = dealt(spark, total, SHARD)
    ids = ids.repartitionByRange(n, F.col("id").asc_nulls_first(), "row").sortWithinPartitions(F.col("id").asc_nulls_first(), "row")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}.rlwm"
        n_docs = 0
        with where.open_output_stream(f"{base}/{name}") as stream:
            out = Writer(stream, bits)
            for b in pieces(batches, "ids"):
                raw = np.frombuffer(b"".join(x.as_buffer() for x in column(b, "ids")), kind)
                out.add(column(b, "id").to_pylist(), column(b, "n").to_numpy(), raw)
                n_docs += b.num_rows
            n_tokens = out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return written(ids.select("id", "n", "ids").mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "shards")


def read_files(spark, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of all documents in the files: start counts the ids of all documents before it; ids are
    little-endian uint32. The table of shards has a row for each file, so it may go to the driver."""
    rows = sorted(shards.collect(), key=lambda r: r["shard"])
    starts = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])]).tolist()
    plan = [(r["path"], s) for r, s in zip(rows, starts, strict=False) if r["n_docs"]]

    def run(batches):
        for b in batches:
            for path, start in zip(*(column(b, c).to_pylist() for c in ("path", "start")), strict=True):
                out, held = {"id": [], "start": [], "n": [], "ids": []}, 0
                for doc_id, ids in open_shard(path).documents():
                    for c, v in zip(out.values(), (doc_id, start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                        c.append(v)
                    start, held = start + len(ids), held + len(ids)
                    if held > 1 << 20:
                        yield _batch(out)
                        out, held = {c: [] for c in out}, 0
                if out["id"]:
                    yield _batch(out)

    table = spark.createDataFrame(plan, "path string, start long").repartition(max(1, len(plan)))
    return table.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")


def _batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.binary())], ["id", "start", "n", "ids"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Writes files to the shared folder and reads them back, see ``write_files`` and ``read_files``. Without rows there are none."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, path, new_dir(spark, "tokens"), id_col, text_col, end_id), id_col)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
