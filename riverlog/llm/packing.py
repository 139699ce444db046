"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

1. One pass encodes the texts and writes ids, length and the document's rank among those of the same remainder (length modulo
   the sequence length) in its input partition. Nothing is shuffled.
2. Counts by (partition, remainder) give each partition's first rank for each remainder, and the histogram: as many numbers
   as a sequence has tokens, which is all that the driver sees of the corpus.
3. The driver places remainders, longest first, into the emptiest packs that have room. Packs of one pattern stay together as a
   range of numbers, so that a placement is (length, range of ranks) -> (range of packs, offset).
4. The emptiest packs are then dissolved and their documents cut to fill the gaps of the others; what is left over
   makes full sequences and, at the very end, sequences of powers of two. So no padding remains.
5. A second pass over the written ids joins patterns back to documents by rank and cuts the pieces.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encode_texts
from .store import column, narrowed, pieces, releasing, tune, written

#: Rows of (partition, remainder) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Plan:
    """Where each remainder goes. ``runs[l]``: (first rank, first pack, offset, first place in the stream of cut documents or -1)."""

    def __init__(self, histogram: dict[int, int], size: int):
        self.size = size
        groups: dict[int, list[list]] = {}  # by room: [first pack, packs, placements]; a placement is (length, first rank)
        self.packs = 0
        for length in sorted((x for x, n in histogram.items() if n and 0 < x < size), reverse=True):
            left, rank = histogram[length], 0
            while left:
                room = max(groups, default=0)
                if room < length:
                    groups.setdefault(size - length, []).append([self.packs, left, [(length, rank)]])
                    self.packs += left
                    break
                first, n, placed = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                m = min(n, left)
                groups.setdefault(room - length, []).append([first, m, [*placed, (length, rank)]])
                if n > m:
                    groups.setdefault(room, []).append([first + m, n - m, [(x, r + m) for x, r in placed]])
                left, rank = left - m, rank + m
        packs = sorted(([first, n, placed, size - room] for room, g in groups.items() for first, n, placed in g), key=lambda g: (g[3], g[0]))
        power = lambda x: x & (x - 1) == 0
        gaps = [0 if power(g[3]) else size - g[3] for g in packs]
        need, have, cut = sum(g * p[1] for g, p in zip(gaps, packs, strict=True)), 0, []
        for k, (gap, pack) in enumerate(zip(gaps, packs, strict=True)):
            if have >= need:
                break
            if not gap:
                continue
            first, n, placed, fill = pack
            m = min(n, -(-(need - have) // (fill + gap)))
            cut.append((m, placed, fill))
            have, need = have + m * fill, need - m * gap
            packs[k] = [first + m, n - m, [(x, r + m) for x, r in placed], fill]
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        at = 0
        for m, placed, _ in cut:
            for length, rank in placed:
                self.runs.setdefault(length, []).append((rank, -1, 0, at))
                at += m * length
        self.cut_tokens = at
        self.sinks: list[tuple[int, int, int, int]] = []  # (first place in the stream, gap, first pack, offset)
        place = 0
        for (first, n, placed, fill), gap in zip(packs, gaps, strict=True):
            if not n:
                continue
            offset = 0
            for length, rank in placed:
                self.runs.setdefault(length, []).append((rank, first, offset, -1))
                offset += length
            if gap and place < at:
                self.sinks.append((place, gap, first, fill))
                place += gap * n
        rest = at - place
        if rest > 0:
            if rest >= size:
                self.sinks.append((place, size, self.packs, 0))
                self.packs, place, rest = self.packs + rest // size, place + rest // size * size, rest % size
            while rest:
                part = 1 << (rest.bit_length() - 1)
                self.sinks.append((place, part, self.packs, 0))
                self.packs, place, rest = self.packs + 1, place + part, rest - part
        for runs in self.runs.values():
            runs.sort()
        self.first = {length: [r[0] for r in runs] for length, runs in self.runs.items()}
        self.sink_at = [s[0] for s in self.sinks]

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(pack, offset, tokens) of the pieces of the document with this rank among those of this remainder."""
        start, pack, offset, at = self.runs[length][bisect_right(self.first[length], rank) - 1]
        if at < 0:
            return [(pack + rank - start, offset, length)]
        at += (rank - start) * length
        out, end = [], at + length
        while at < end:
            k = bisect_right(self.sink_at, at) - 1
            place, gap, pack, offset = self.sinks[k]
            n, inside = divmod(at - place, gap)
            m = min(end - at, gap - inside)
            out.append((pack + n, offset + inside, m))
            at += m
        return out


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, size: int) -> DataFrame:
    """The stored ids (little-endian uint32, with the end id) of all rows, with n, part, rem, rank and the number of full pieces before."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, seen, full = TaskContext.get().partitionId(), {}, 0
        for b in pieces(batches, "text"):
            ids, off = encode_texts(path, column(b, "text"))
            data, ranks, before = [], [], []
            n = np.diff(off) + 1
            rem = n % size
            for a, z, r, k in zip(off[:-1].tolist(), off[1:].tolist(), rem.tolist(), (n // size).tolist(), strict=True):
                data.append(ids[a:z].astype("<u4").tobytes() + end_id.to_bytes(4, "little"))
                ranks.append(seen.get(r, 0))
                seen[r] = ranks[-1] + 1
                before.append(full)
                full += k
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(data, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(rem.astype(np.int32)), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())], ["id", "ids", "n", "part", "rem", "rank", "full"])

    chosen = narrowed(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(chosen.mapInArrow(releasing(run), f"id {kind}, ids binary, n long, part int, rem int, rank long, full long"), "ids")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, size: int = 1024) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of ``docs`` in sequences of at most ``size`` ids.

    ids are little-endian uint32. Each id of each document, its end id included, lies in one piece; pieces of a sequence follow
    each other from offset 0. Sequences have ``size`` ids or a power of two of them. A null text is an empty one (its end id
    alone). Repeated rows are packed each; other columns don't matter; without rows there are no pieces.
    """
    if size < 1:
        raise ValueError("a sequence has one token at least")
    tune(docs.sparkSession)
    table = encoded(docs, path, id_col, text_col, end_id, size)
    counts = table.groupBy("part", "rem").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / size)).alias("full"))
    counts = written(counts, "lengths")
    plan = Plan({r["rem"]: r["docs"] for r in counts.groupBy("rem").agg(F.sum("docs").alias("docs")).collect()}, size)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # both windows are over (partitions x remainders) or partitions, not over documents
    ranks = counts.select("part", "rem", F.coalesce(F.sum("docs").over(before.partitionBy("rem").orderBy("part")), F.lit(0)).alias("rank0"))
    fulls = counts.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(before.orderBy("part")), F.lit(0)).alias("full0"))
    bases = written(ranks.join(fulls, "part"), "bases")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for b in batches:
            plan, cols = shared.value, {c: [] for c in ("at", "start", "length", "ids", "sequence", "offset")}
            values = zip(column(b, "ids"), *(column(b, c).to_pylist() for c in ("n", "rem", "rank", "full")), strict=True)
            for k, (ids, n, rem, rank, full) in enumerate(values):
                raw, start = ids.as_buffer(), 0
                places = [(plan.packs + full + j, 0, size) for j in range(n // size)] + (plan.places(rem, rank) if rem else [])
                for sequence, offset, length in places:
                    for c, v in zip(cols.values(), (k, start, length, raw.slice(4 * start, 4 * length).to_pybytes(), sequence, offset), strict=True):
                        c.append(v)
                    start += length
            at = pa.array(cols["at"], pa.int64())
            yield pa.RecordBatch.from_arrays([column(b, "id").take(at), pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int64()), pa.array(cols["ids"], pa.binary()), column(b, "n").take(at), pa.array(cols["sequence"], pa.int64()), pa.array(cols["offset"], pa.int64())], ["id", "start", "length", "ids", "n", "sequence", "offset"])

    ready = table.join(bases, ["part", "rem"]).select("id", "ids", "n", "rem", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("full") + F.col("full0")).alias("full"))
    return ready.mapInArrow(releasing(run), f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the result of ``pack``: the pieces of each sequence joined in order. A group has at most
    as many pieces as a sequence has tokens."""
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
