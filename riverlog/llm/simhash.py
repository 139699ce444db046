"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has the bit that over half of its shingles' hashes have. Texts whose fingerprints differ in at
most ``radius`` bits are linked, and linked texts form components. The plan:

1. Fingerprints come from one pass over the texts (no shuffle) and are written with the ids only.
2. Equal fingerprints collapse by a map-side combined ``min(id)``: copies never meet in pairs.
3. The 64 bits are cut into ``radius + 2`` parts. Two fingerprints within the radius agree in two parts at least, so each
   fingerprint goes to one bucket for each pair of parts (6 buckets of a 32-bit key at radius 2).
4. Buckets are compared bit-sliced: 64 fingerprints make a block of 64 vertical bit planes; the differences of one
   fingerprint to all 64 are summed in carry-save bit counters, and a block is given up once all exceed the radius.
   A bucket gives one link for each fingerprint (a spanning star), not its pairs.
5. Buckets of more than ``HOT`` fingerprints take an exact way without comparisons: two fingerprints within radius 2 share a
   neighbour at distance 1 or less, and all that share such a neighbour are within 2. Each is sent to its 65 neighbours; 65
   meet at one at most.
6. Components of the links are found by distributed star operations (``graph``).

Links of 64-bit fingerprints within two bits join texts that differ in very little. ``near_groups``, which removal of near-duplicates
uses, adds links by a shingle similarity, which is exact. Fingerprints of ``WIDE`` x 64 bits over distinct five-word shingles differ in a
share of bits that follows from the similarity; they only find candidates. They are compared, bit-sliced as before, where texts agree in
the least shingles of one of ``BANDS`` sets of orders; buckets of many texts are cut into chunks, of which each two are compared. The
shingles of candidates are then read again, and all texts of a component of candidates are compared by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .joins import lookup
from .store import column, dealt, narrowed, pieces, tune, written
from .textbytes import NOT_SPACE, Block, U, mix, xxh64

#: Fingerprints in a bucket that are compared with each other in one task.
HOT = 1024
#: Rows of whole buckets that are compared at once.
ROWS = 8192
#: Words of 64 bits in a wide fingerprint; buckets of a text, and the least shingles that a bucket's key has.
WIDE, BANDS, LEAST = 8, 14, 3
#: Texts of a bucket that are compared with each other in one task.
CHUNK = 2048
#: Shingles of texts that are compared with each other exactly in one task.
SHINGLES = 1 << 20
#: Hot buckets that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view("<u8").ravel()


def _spaced(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with one space between; starts and ends of the words in them."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[end] = False
    keep = np.zeros(len(words.data) + 1, np.int8)
    keep[words.start] += 1
    keep[words.end] -= 1
    out[np.flatnonzero(inside)] = np.compress(np.cumsum(keep[:-1], dtype=np.int8) > 0, words.data)
    return out, start, end


def shingle_hashes(block: Block, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all shingles, and the first shingle of each text and their number.

    Shingles are runs of ``size`` words joined by spaces; a text of fewer words has its whole sequence, one of none has none.
    """
    words = block.words(NOT_SPACE)
    count = words.count
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(words.off[:-1] - off[:-1], n) + np.arange(off[-1])
    last = first + np.repeat(np.minimum(count, size), n) - 1
    data, start, end = _spaced(words)
    return xxh64(data, start[first], end[last] - start[first], 42), off


def fingerprints(block: Block, size: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text; zero for a text without words."""
    return majority(*shingle_hashes(block, size))


def majority(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bits that over half of each text's hashes have, as one unsigned long; zero for a text without hashes."""
    n, out = np.diff(off), np.zeros(len(off) - 1, np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    runs = -(-n[full] // 255)  # of 255 shingles at most, whose bits are counted in bytes
    run_off = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(off[full] - 255 * run_off[:-1], runs) + 255 * np.arange(run_off[-1])
    counts = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], at, axis=0).view(np.uint8).astype(np.int64)
    counts = np.add.reduceat(counts, run_off[:-1], axis=0)
    out[full] = np.packbits(counts * 2 > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints as 64 bit planes: bit j of planes[k, b] is bit b of values[64 * k + j]."""
    room = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    room[: len(values)] = values
    bits = np.unpackbits(room.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8").reshape(-1, 64)


def near_pairs(values: np.ndarray, end: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j < end[i], of which values[i] and values[j] differ in ``radius`` bits at most (radius 0 to 3).

    All (row, block of 64 rows) items advance together, three bit planes at a time. Two counter bits and an overflow bit
    hold 64 distances; an item is dropped when none of its rows can be within the radius any more.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius has to be 0 to 3")
    row = np.flatnonzero(end > np.arange(len(values)) + 1)
    if not len(row):
        return row, row
    store, first, last = planes(values), (row + 1) // 64, (end[row] - 1) // 64
    n = last - first + 1
    off = np.cumsum(n) - n
    item, block = np.repeat(row, n), np.repeat(first - off, n) + np.arange(n.sum())
    low, high = np.maximum(item + 1 - 64 * block, 0), np.minimum(end[item] - 64 * block, 64)
    ones = U(0xFFFFFFFFFFFFFFFF)
    live = (ones >> (64 - high).astype(np.uint64)) & (ones << low.astype(np.uint64))
    c0, c1, over = (np.zeros(len(item), np.uint64) for _ in range(3))
    mine, zero = values[item], np.zeros(1, np.uint64)
    for b in range(0, 64, 3):
        x, y, z = ((store[block, k] ^ (zero - ((mine >> U(k)) & U(1)))) if k < 64 else zero for k in (b, b + 1, b + 2))
        s, carry = x ^ y ^ z, (x & y) | (z & (x ^ y))
        up = c0 & s
        c0 = c0 ^ s
        over = over | (c1 & carry) | (up & (c1 ^ carry))
        c1 = c1 ^ carry ^ up
        beyond = over | (zero if radius == 3 else c0 & c1 if radius == 2 else c1 if radius == 1 else c0 | c1)
        live = live & ~beyond
        if b % 6 == 3 or b == 63:
            if not (keep := live != 0).all():
                item, block, live, c0, c1, over, mine = (a[keep] for a in (item, block, live, c0, c1, over, mine))
            if not len(item):
                break
    bits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(live) else np.zeros((0, 64), np.uint8)
    at, j = np.nonzero(bits)
    return item[at], 64 * block[at] + j


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index for each of n."""
    root = np.arange(n)
    while len(a):
        m = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, m)
        np.minimum.at(root, b, m)
        root = root[root]
        if (before == root).all():
            break
    return root


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From rows (part, key, fp) in the order of (part, key, fp): links (0, fp, root) and, of large buckets, (1, fp, fp)."""

    def done(part, key, fp, tail: bool):
        """Handles whole buckets; returns what has to wait for more rows."""
        new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [len(fp)]])
        size = ends - starts
        cut = len(fp) if tail else starts[-1]
        hot = size > HOT
        wait = (part[cut:], key[cut:], fp[cut:])
        use = ~hot & (ends <= cut)
        out = []
        rows = np.repeat(use & (size > 1), size)
        if rows.any():
            values, n = fp[rows], size[use & (size > 1)]
            stop = np.repeat(np.cumsum(n), n)
            root = _roots(len(values), *near_pairs(values.view(np.uint64), stop, radius))
            if len(linked := np.flatnonzero(root != np.arange(len(values)))):
                out.append((0, values[linked], values[root[linked]]))
        if hot.any() and len(members := fp[:cut][np.repeat(hot, size)[:cut]]):
            out.append((1, members, members))
        return wait, out

    def rows(out):
        for kind, a, b in out:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    held: tuple | None = None
    hot_key = None  # a bucket that is known as large: its rows pass on at once
    for batch in batches:
        got = tuple(column(batch, c).to_numpy(zero_copy_only=False) for c in ("part", "key", "fp"))
        if hot_key is not None:
            same = (got[0] == hot_key[0]) & (got[1] == hot_key[1])
            n = int(same.sum())  # they come first
            yield from rows([(1, got[2][:n], got[2][:n])] if n else [])
            got = tuple(x[n:] for x in got)
            if not len(got[0]):
                continue
            hot_key = None
        held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
        if len(held[0]) < ROWS:
            continue
        held, out = done(*held, tail=False)
        yield from rows(out)
        if len(held[0]) > HOT:
            hot_key = (held[0][0], held[1][0])
            yield from rows([(1, held[2], held[2])])
            held = None
    if held is not None and len(held[0]):
        yield from rows(done(*held, tail=True)[1])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) among the distinct long values of column fp: a star in each bucket, which joins just what is reachable
    within the bucket over differences of ``radius`` bits or fewer."""
    parts = radius + 2
    edges = [64 * k // parts for k in range(parts + 1)]
    fields = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = F.array(*(fields[x] * F.lit(1 << (edges[y + 1] - edges[y])) + fields[y] for x, y in combinations(range(parts), 2)))
    buckets = distinct.select("fp", F.posexplode(keys).alias("part", "key"))
    n = dealt(distinct.sparkSession, distinct.count() * math.comb(parts, 2), 1 << 22)
    buckets = buckets.repartition(n, "part", "key").sortWithinPartitions("part", "key", "fp")
    found = written(buckets.mapInArrow(lambda it: _compare(it, radius), "kind int, a long, b long"), "buckets")
    hot = found.where("kind = 1").select(F.col("a").alias("fp")).distinct()
    return found.where("kind = 0").select("a", "b").union(shared_neighbours(hot, radius))


def shared_neighbours(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """The same links without buckets, for any number of values that are close together.

    At radius 2 each value is sent to itself and its 64 neighbours: values that meet are within 2 bits, and values within 2 bits meet.
    """
    if radius > 2:
        raise ValueError("buckets of that size are handled up to radius 2")
    reach = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64))) if radius else F.array(F.lit(0).cast("long"))
    met = distinct.select("fp", F.explode(F.transform(reach, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    if radius == 1:
        # sharing a neighbour would reach 2 bits: keep those that are themselves the neighbour's centre
        return met.join(distinct.select(F.col("fp").alias("at")), "at").select(F.col("fp").alias("a"), F.col("at").alias("b")).where("a <> b")
    group = met.groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return group.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long. Null texts have no words."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(fingerprints(Block(column(b, "text")), size).view(np.int64))], ["id", "fp"])

    return narrowed(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links. Null and empty texts have fingerprint zero and are linked like
    any others. A null id is kept; it is never a component's id unless all its ids are null. Rows that repeat an id stay as
    they are. Other columns of ``docs`` are not looked at, whatever they are called. No rows give no rows.
    """
    tune(docs.sparkSession)
    table = written(with_fingerprints(docs, id_col, text_col, size), "fingerprints")
    reps = table.groupBy("fp").agg(F.min("id").alias("rep"))
    nodes = connected_components(links(reps.select("fp"), radius))
    of = reps.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    of = written(of, "components")
    least = written(of.groupBy("root").agg(F.min("rep").alias("component_id")), "least")  # stored, so that Spark can split a large component
    label = written(of.join(least, "root").select("fp", "component_id"), "labels")
    return lookup(table, label, "fp", how="inner").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_shingles(block: Block, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, and their offsets by text; a shorter text is one shingle."""
    words = block.words(NOT_SPACE)
    count = words.count
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(block.n), n)
    first = np.repeat(words.off[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    length = np.repeat(np.minimum(count, size), n)
    h = np.zeros(len(first), np.uint64)
    for k in range(size):
        has = length > k
        h[has] = mix(h[has] * U(3) + words.hash[first[has] + k])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(block.n + 1))


def wide_fingerprints(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, WIDE) unsigned longs: fingerprints by as many hash functions."""
    return np.stack([majority(mix(hashes + U(k * 0x9E3779B97F4A7C15 % (1 << 64))), off) for k in range(1, WIDE + 1)], axis=1) if len(off) > 1 else np.zeros((0, WIDE), np.uint64)


def band_keys(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts with shingles, BANDS) bucket keys: each of the least shingles in ``LEAST`` orders."""
    start = off[:-1][np.diff(off) > 0]
    factors = np.random.default_rng(99).integers(1, 1 << 62, BANDS * LEAST, dtype=np.uint64) * U(2) + U(1)
    out = np.zeros((len(start), BANDS), np.uint64)
    if len(start):
        for k, f in enumerate(factors):
            out[:, k // LEAST] = mix(out[:, k // LEAST] * U(5) + np.minimum.reduceat(hashes * f, start))
    return out


def _differ(a: int, b: int, both: int) -> float:
    """The chance that a bit differs in the fingerprints of sets of a and b shingles, of which ``both`` are common."""
    tail = lambda n, least: sum(math.comb(n, k) for k in range(max(least, 0), n + 1)) / 2**n
    out = 0.0
    for k in range(both + 1):
        x, y = tail(a - both, a // 2 + 1 - k), tail(b - both, b // 2 + 1 - k)
        out += math.comb(both, k) / 2**both * (x + y - 2 * x * y)
    return out


@cache
def wide_radius(similarity: float) -> int:
    """The number of bits beyond which wide fingerprints of texts with that share of common shingles hardly ever differ: that of the sizes
    of sets at which most bits differ (small ones, as ties count as zero), and three standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi  # large sets of equal size
    for a in range(1, 41):
        for b in range(a, int(a / similarity + 1e-9) + 1):
            p = max(p, _differ(a, b, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)))
    return int(64 * WIDE * p + 3 * math.sqrt(64 * WIDE * p * (1 - p)))


def near_rows(values: np.ndarray, end: np.ndarray, radius: int, most: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j < end[i], of which the rows of ``values`` differ in ``radius`` bits at most, for any width and radius; some at a time.

    As ``near_pairs``, with counters of as many bits as the radius needs. They start so high that a count over the radius overflows.
    ``most``: (row, block of 64 rows) items at a time.
    """
    row = np.flatnonzero(end > np.arange(len(values)) + 1)
    if not len(row):
        return
    store = np.ascontiguousarray(np.concatenate([planes(values[:, w]) for w in range(values.shape[1])], axis=1).T)
    ones, zero, levels = U(0xFFFFFFFFFFFFFFFF), U(0), max(2, int(radius).bit_length())
    preset = (1 << levels) - 1 - radius
    first, last = (row + 1) // 64, (end[row] - 1) // 64
    total = np.cumsum(last - first + 1)
    cuts = [0, *(np.searchsorted(total, np.arange(most, total[-1], most)) + 1).tolist(), len(row)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi <= lo:
            continue
        n = last[lo:hi] - first[lo:hi] + 1
        item, block = np.repeat(row[lo:hi], n), np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
        low, high = np.maximum(item + 1 - 64 * block, 0), np.minimum(end[item] - 64 * block, 64)
        live = (ones >> (64 - high).astype(np.uint64)) & (ones << low.astype(np.uint64))
        c = [np.full(len(item), ones if preset >> k & 1 else zero) for k in range(levels)]
        over, b = np.zeros(len(item), np.uint64), 0
        while b < len(store) and len(item):
            x, y, z = ((store[k][block] ^ (zero - ((values[item, k // 64] >> U(k % 64)) & U(1)))) if k < len(store) else np.zeros(len(item), np.uint64) for k in (b, b + 1, b + 2))
            s, carry = x ^ y ^ z, (x & y) | (z & (x ^ y))
            up = c[0] & s
            c[0] = c[0] ^ s
            c[1], up = c[1] ^ carry ^ up, (c[1] & carry) | (up & (c[1] ^ carry))
            for k in range(2, levels):
                c[k], up = c[k] ^ up, c[k] & up
            over |= up
            b += 3
            if b % 24 == 0 or b >= len(store):
                live = live & ~over
                if not (keep := live != 0).all():
                    item, block, live, over = (a[keep] for a in (item, block, live, over))
                    c = [a[keep] for a in c]
        if len(item):
            at, j = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield item[at], 64 * block[at] + j


def _compare_wide(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From rows (band, key, salt, node, wide) in the order of (band, key, salt): links (a, root) within buckets, or blocks of them."""

    def done(rows):
        band, key, salt, node, wide = rows
        values = np.frombuffer(b"".join(wide), "<u8").reshape(-1, WIDE)
        new = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(node)]])
        root = np.arange(len(node))
        for i, j in near_rows(values, np.repeat(ends, ends - starts), radius):  # what is known is kept as stars, not as pairs
            star = np.flatnonzero(root != np.arange(len(node)))
            root = _roots(len(node), np.concatenate([i, star]), np.concatenate([j, root[star]]))
        if len(linked := np.flatnonzero(root != np.arange(len(node)))):
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    held = None
    for batch in batches:
        got = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("band", "key", "salt", "node")] + [np.array([*column(batch, "wide").to_pylist(), None], object)[:-1]]
        held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
        if len(held[3]) < ROWS:
            continue
        same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from done([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[3]):
        yield from done(held)


def in_blocks(rows: DataFrame, by: list[str], hot: DataFrame, most: int) -> DataFrame:
    """``rows`` (with a column node) with a salt: -1, but for keys of ``hot`` (by, n: their sizes, over ``most``), whose rows are cut
    into chunks of half of ``most``. Each two chunks of a key are one salt, so any two of its rows meet in one at least."""
    if not (keys := hot.count()):
        return rows.withColumn("salt", F.lit(-1).cast("long"))
    chunks = F.ceil(2 * F.col("n") / most)
    rest = F.array(F.lit(-1).cast("long"))
    other = F.explode(F.when(F.col("n").isNotNull(), F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(rest))
    salted = rows.join(F.broadcast(hot) if keys <= BROADCAST_ROWS else hot, by, "left")
    salted = salted.select(*rows.columns, chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).alias("own"), other.alias("other"))
    salt = F.coalesce(F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"), F.lit(-1))
    return salted.where(F.coalesce(F.col("own") != F.col("other"), F.lit(True))).select(*rows.columns, salt.cast("long").alias("salt"))


def similar_links(texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Candidates (a, b) among distinct texts (node: long, wide: binary, bands: array of long), as stars within each bucket or block of
    one: their components hold all pairs of a bucket that are within the radius."""
    radius = wide_radius(similarity)
    keys = texts.select("node", F.posexplode("bands").alias("band", "key"))
    hot = written(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "hot")
    by = ["band", "key", "salt"]
    rows = in_blocks(texts.select("node", "wide", F.posexplode("bands").alias("band", "key")), by[:2], hot, CHUNK)
    again = hot.agg(F.sum(F.col("n") * F.ceil(2 * F.col("n") / CHUNK))).first()[0] or 0  # rows of large buckets come once for each chunk
    n = dealt(texts.sparkSession, texts.count() * BANDS + again, 1 << 20)
    return written(rows.repartition(n, *by).sortWithinPartitions(*by, "node").mapInArrow(lambda it: _compare_wide(it, radius), "a long, b long"), "similar")


def similar_roots(ids: np.ndarray, off: np.ndarray, similarity: float, mark: np.ndarray) -> np.ndarray:
    """For each of the sets ids[off[k] : off[k + 1]], none empty, the first one reachable over pairs that share ``similarity`` or more.

    Each set is compared only with those that nothing has reached yet. ``mark`` has a false for each id, and is left so.
    """
    size, root = np.diff(off), np.arange(len(off) - 1)
    rest, rest_ids, rest_off = root[1:].copy(), ids[off[1] :], off[1:] - off[1]
    wait, first = [0], 0
    while len(rest):
        if not wait:
            first = int(rest[0])
            wait, rest, rest_ids, rest_off = [first], rest[1:], rest_ids[rest_off[1] :], rest_off[1:] - rest_off[1]
            continue
        k = wait.pop()
        mine = ids[off[k] : off[k + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[rest_ids], rest_off[:-1], dtype=np.int64)
        mark[mine] = False
        near = both / (len(mine) + size[rest] - both) >= similarity
        if near.any():
            root[rest[near]] = first
            wait += rest[near].tolist()
            rest_ids, rest = rest_ids[np.repeat(~near, size[rest])], rest[~near]
            rest_off = np.concatenate([[0], np.cumsum(size[rest])])
    return root


def _confirm(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """From rows (group, salt, node, shingles) in the order of (group, salt, node): links (a, root) of texts of a group, or block of one, by
    their shingles."""

    def done(group, salt, node, raw):
        new = np.ones(len(node), bool)
        new[1:] = (group[1:] != group[:-1]) | (salt[1:] != salt[:-1])
        once = new.copy()
        once[1:] |= node[1:] != node[:-1]  # rows that repeat a text
        starts = np.append(np.flatnonzero(new[once]), once.sum())
        node, raw = node[once], raw[once]
        off = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
        every, ids = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_inverse=True)
        root, mark = np.arange(len(node)), np.zeros(len(every), bool)
        for lo, hi in zip(starts, starts[1:], strict=False):
            if hi - lo > 1:
                root[lo:hi] = lo + similar_roots(ids[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], similarity, mark)
        if len(linked := np.flatnonzero(root != np.arange(len(node)))):
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    held, total = None, 0
    for batch in batches:
        got = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("group", "salt", "node")] + [np.array([*column(batch, "shingles").to_pylist(), None], object)[:-1]]
        total += sum(map(len, got[3]))
        held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
        if total < 8 * SHINGLES:
            continue
        same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        if not same.all():
            cut = int(np.flatnonzero(~same)[-1]) + 1
            yield from done(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
            total = sum(map(len, held[3]))
    if held is not None and len(held[2]):
        yield from done(*held)


#: What tells texts apart: the short fingerprint and two sums over the set of shingles.
TEXT = ["fp", "own", "more"]


def _shingled(block: Block, size: int, words: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Distinct shingles of ``words`` words with offsets; the columns ``TEXT``."""
    hashes, off = distinct_shingles(block, words)

    def total(h):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        return pa.array((sums[off[1:]] - sums[off[:-1]]).view(np.int64))

    return hashes, off, [pa.array(fingerprints(block, size).view(np.int64)), total(mix(hashes)), total(mix(hashes * U(5) + U(1)))]


def confirmed(rows: DataFrame, texts: DataFrame, candidates: DataFrame, similarity: float, size: int, words: int) -> DataFrame:
    """Links (a, b) of texts (node, rep and ``TEXT``) that share ``similarity`` or more of their distinct shingles, among those that
    ``candidates`` (a, b) put in one component. The shingles of these are made anew from ``rows`` (id, text)."""

    def run(batches):
        for b in pieces(batches, "text"):
            hashes, off, key = _shingled(Block(column(b, "text")), size, words)
            raw = hashes.astype("<u8")
            sets = pa.array([raw[x:y].tobytes() for x, y in zip(off, off[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*key, pa.array(np.diff(off).astype(np.int64)), sets], [*TEXT, "len", "shingles"])

    linked = connected_components(candidates).withColumnRenamed("root", "group")
    linked = written(texts.select("node", "rep", *TEXT).join(linked, "node"), "candidates")
    ids = written(linked.select(F.col("rep").alias("__id")).distinct(), "ids")
    some = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, rows["id"].eqNullSafe(ids["__id"]), "left_semi")
    sets = some.select("text").mapInArrow(run, "fp long, own long, more long, len long, shingles binary")
    sets = written(sets.join(linked, TEXT).select("group", "node", "len", "shingles"), "sets")
    hot = written(sets.groupBy("group").agg(F.sum("len").alias("n")).where(F.col("n") > SHINGLES), "hot")
    by = ["group", "salt"]
    blocks = in_blocks(sets.select("group", "node", "shingles"), by[:1], hot, SHINGLES)
    again = hot.agg(F.sum(F.col("n") * F.ceil(2 * F.col("n") / SHINGLES))).first()[0] or 0
    n = dealt(rows.sparkSession, (sets.agg(F.sum("len")).first()[0] or 0) + again, 1 << 24)
    blocks = blocks.repartition(n, *by).sortWithinPartitions(*by, "node")
    return written(blocks.mapInArrow(lambda it: _confirm(it, similarity), "a long, b long"), "confirmed")


def _roots_of_rows(rows: DataFrame, extra: list[str], size: int, radius: int, similarity: float, words: int) -> DataFrame:
    """(id, *extra, root) of all ``rows`` (id, text, *extra), stored. Rows with an equal root are of one group.

    A node is a number for each distinct text, so no two texts meet by chance. Texts of one short fingerprint are linked to the first
    of them; links between fingerprints are links between those.
    """

    def run(batches):
        for b in pieces(batches, "text"):
            block = Block(column(b, "text"))
            hashes, off, key = _shingled(block, size, words)
            wide = wide_fingerprints(hashes, off).astype("<u8")
            full = np.diff(off) > 0
            sizes = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(sizes), pa.array(band_keys(hashes, off).view(np.int64).ravel()))
            mine = [column(b, c) for c in ("id", *extra)]
            yield pa.RecordBatch.from_arrays([*mine, *key, pa.array([x.tobytes() for x in wide], pa.binary()), bands], ["id", *extra, *TEXT, "wide", "bands"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *extra))
    table = written(rows.select("id", "text", *extra).mapInArrow(run, f"{kinds}, fp long, own long, more long, wide binary, bands array<long>"), "fingerprints")
    texts = table.groupBy(*TEXT).agg(F.min("id").alias("rep"), F.first("wide").alias("wide"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    lead = written(texts.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    near = links(lead.select("fp"), radius)
    near = near.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = lookup(texts.select("fp", "node"), lead, "fp", how="inner").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    similar = confirmed(rows, texts, similar_links(texts.where(F.size("bands") > 0), similarity), similarity, size, words)
    nodes = connected_components(near.union(same).union(similar))
    of = written(texts.select(*TEXT, "node").join(nodes, "node", "left").select(*TEXT, F.coalesce("root", "node").alias("root")), "components")
    return written(lookup(table.select("id", *extra, *TEXT), of, TEXT, how="inner").select("id", *extra, "root"), "roots")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(id, component_id) of each row of ``docs``: groups by the links of ``near_duplicates`` and those of texts that share
    ``similarity`` or more of their distinct shingles of ``words`` words. Nulls, empty texts and repeated rows are as there."""
    tune(docs.sparkSession)
    rows = narrowed(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of = _roots_of_rows(rows, [], size, radius, similarity, words)
    least = written(of.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return lookup(of, least, "root", how="inner").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` without near-duplicates (``near_groups``): one row of each component stays, that with the smallest id.

    Rows are known by their id and text, not by the id alone: rows of one id, or of none, with texts that aren't near-duplicates all stay.
    A null id comes last; of equal ids the text with the smaller hash stays, and of rows that repeat an id and a text
    the first by its other columns. Other columns of ``docs`` may have any names. Texts are shuffled only if more than
    ``BROADCAST_ROWS`` rows go. No rows give no rows.
    """
    tune(docs.sparkSession)
    names = docs.columns
    at = docs.toDF(*(f"_{k}" for k in range(len(names))))
    the_id, text = (F.col(f"_{names.index(c)}") for c in (id_col, text_col))
    # two hashes: 128 bits tell texts apart
    keyed = at.select("*", the_id.alias("__id"), F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(1), text, F.length(text)).alias("__i"))
    rows = keyed.select(F.col("__id").alias("id"), text.alias("text"), F.col("__h").alias("h"), F.col("__i").alias("i"))
    of = _roots_of_rows(rows, ["h", "i"], size, radius, similarity, words)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h", "i")
    lead = of.groupBy("root").agg(F.min(first).alias("k")).select("k.id", "k.h", "k.i")
    every = written(of.groupBy("id", "h", "i").agg(F.count("*").alias("n")), "keys")
    lead = written(lead, "leads")
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["h"] == y["h"]) & (x["i"] == y["i"])
    gone = written(every.join(lead, same(every, lead), "left_anti"), "gone")
    repeated = written(every.where("n > 1").join(lead, same(every.where("n > 1"), lead), "left_semi"), "repeated")

    def among(which: DataFrame, how: str, of: DataFrame) -> DataFrame:
        which = which.select("id", "h", "i")
        match = of["__id"].eqNullSafe(which["id"]) & (of["__h"] == which["h"]) & (of["__i"] == which["i"])
        return of.join(F.broadcast(which) if which.count() <= BROADCAST_ROWS else which, match, how)

    kept = among(gone, "left_anti", keyed)
    if not repeated.isEmpty():
        once = among(repeated, "left_anti", kept)
        many = among(repeated, "left_semi", kept).groupBy("__id", "__h", "__i").agg(F.min_by(F.struct(*at.columns), F.to_json(F.struct(*at.columns))).alias("__row")).select("__row.*")
        kept = once.select(*at.columns).unionByName(many)
    return kept.select(*at.columns).toDF(*names)
