"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document: each row of the index table holds a block of documents with the postings of all its
words (term, ascending positions), so that lists meet without a shuffle and a block is a bounded piece of work. Phrase queries
take the offset-adjusted posting list of their rarest term in the block and intersect it with those of the next rarer terms,
all queries of a block at once; proximity queries look for a posting of each term in the same span of words.

Terms are identified by 64-bit hashes. Benchmark items go to the tasks as their words, 8 bytes each; windows are places among these, and in
each block only those whose words all occur there become queries. Batches of items have a bounded size, so a benchmark
of any size works; the index is built once for all batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import column, narrowed, pieces, releasing, tune, written
from .textbytes import ALNUM, Block, U, covered, mix, run_sums

#: Bytes of text in a block of the index; bytes of benchmark text that are matched in one pass: at most 2 million words, so about 60 MB, and
#: 700,000 of ordinary length. Windows that are matched at a time.
BLOCK, BATCH, WINDOWS = 3 << 20, 4 << 20, 1 << 16


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all rows of ``docs``: a row for each block.

    Columns: ids and n_words by document of the block; terms (ascending 64-bit hashes), ends (of their posting lists) and gaps
    (differences of positions in the block). Null and empty texts are documents without words.
    """
    tune(docs.sparkSession)
    chosen = narrowed(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("n_words", "terms", "ends", "gaps"))])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(pieces(batches, "text", BLOCK)):
            count, hashes = block_words(b)
            terms, ends, pos = postings(hashes)
            gaps = np.diff(pos, prepend=np.uint32(0))
            ids = column(b, "id")
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in (count.astype("<u4"), terms, ends.astype("<u4"), gaps))], schema.names)

    return written(chosen.mapInArrow(releasing(run), schema), "postings")


def block_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and all words' hashes. Texts are hashed some at a time, as that takes many times their size."""
    count, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b in pieces([batch], "text"):
        words = Block(column(b, "text")).words(ALNUM)
        count.append(words.count)
        hashes.append(words.hash)
    return np.concatenate(count), np.concatenate(hashes)


def postings(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in ascending order, ends of their lists, and all positions, by term and ascending."""
    order = np.argsort(hashes)
    h = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(h)) if len(h) else new
    key = (np.repeat(np.arange(len(new), dtype=np.uint64), ends - new) << U(32)) | order.astype(np.uint64)
    key.sort()
    return h[new], ends, key.astype(np.uint32)


class Segment:
    """A block of the index in memory."""

    def __init__(self, n_words: bytes, terms: bytes, ends: bytes, gaps: bytes):
        self.n_words = np.frombuffer(n_words, "<u4").astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.n_words)])
        self.terms, self.ends = np.frombuffer(terms, "<u8"), np.frombuffer(ends, "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.pos = np.cumsum(np.frombuffer(gaps, "<u4"), dtype=np.uint32).astype(np.int64)
        self.key = (np.repeat(np.arange(len(self.terms)), self.ends - self.starts) << 32) | self.pos

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this block's list of terms, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def doc(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, side="right") - 1

    def _rarest_first(self, terms: np.ndarray, size: np.ndarray):
        """Queries whose terms all occur, their terms' numbers and offsets by rising frequency, and that of the rarest."""
        real = np.arange(terms.shape[1]) < size[:, None]
        number = self.find(terms)
        use = np.flatnonzero(((number >= 0) | ~real).all(axis=1) & (size > 0))
        number, real = number[use], real[use]
        many = np.where(real, self.ends[number] - self.starts[number], 1 << 60) if len(self.terms) else np.zeros(number.shape)
        order = np.argsort(many, axis=1, kind="stable")
        return use, np.take_along_axis(number, order, 1), order, (many.min(axis=1) if len(use) else np.zeros(0)).astype(np.int64)

    def _groups(self, rare: np.ndarray, most: int = 1 << 20):
        """Runs of queries whose rarest lists have about ``most`` postings together."""
        total = np.cumsum(rare)
        cuts = np.searchsorted(total, np.arange(most, total[-1] + most, most)) + 1 if len(rare) else []
        first = 0
        for last in [*cuts, len(rare)]:
            if (last := min(last, len(rare))) > first:
                yield first, last
                first = last

    def phrases(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of all occurrences within one document. terms: a row of hashes for each query; size: how many count."""
        use, number, offset, rare = self._rarest_first(terms, size)
        out = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in self._groups(rare):
            n = rare[lo:hi]
            q = np.repeat(np.arange(lo, hi), n)
            at = self.pos[np.repeat(self.starts[number[lo:hi, 0]] - np.cumsum(n) + n, n) + np.arange(n.sum())] - offset[q, 0]
            for k in range(1, terms.shape[1]):
                rest = size[use[q]] <= k
                want = (number[q, k] << 32) | np.maximum(at + offset[q, k], 0)
                place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                ok = rest | ((self.key[place] == want) & (at >= 0))
                q, at = q[ok], at[ok]
                if not len(q):
                    break
            ok = (at >= 0) & (at + size[use[q]] <= self.off[-1])
            q, at = q[ok], at[ok]
            ok = self.doc(at) == self.doc(at + size[use[q]] - 1)
            out.append((use[q[ok]], at[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def near(self, terms: np.ndarray, size: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) where ``span`` words from the position, within one document, hold all terms in any order."""
        use, number, _, rare = self._rarest_first(terms, size)
        out = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in self._groups(rare, (1 << 20) // span + 1):
            n = rare[lo:hi]
            q = np.repeat(np.arange(lo, hi), n)
            at = self.pos[np.repeat(self.starts[number[lo:hi, 0]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            q, at = np.repeat(q, span), (at[:, None] - np.arange(span)).ravel()
            ok = at >= 0
            q, at = q[ok], at[ok]
            doc = self.doc(at)
            end = np.minimum(at + span, self.off[doc + 1])
            for k in range(terms.shape[1]):
                rest = size[use[q]] <= k
                place = np.minimum(np.searchsorted(self.key, (number[q, k] << 32) | at), len(self.key) - 1)
                ok = rest | ((self.key[place] >> 32 == number[q, k]) & ((self.key[place] & 0xFFFFFFFF) < end))
                q, at, end = q[ok], at[ok], end[ok]
            found = np.unique(np.stack([use[q], at]), axis=1) if len(q) else np.zeros((2, 0), np.int64)
            out.append((found[0], found[1]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Queries:
    """The words of items and their distinct windows: ``words`` (hashes), ``first`` and ``size`` of window k in them; ``item_of``: the items (in
    ``names``) of window k at off[k]:off[k + 1]."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        words = Block.of([t for _, t in items]).words(ALNUM)
        n = words.count
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        first = np.repeat(words.off[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
        size = np.repeat(size, many)
        self.words, self.window = words.hash, window
        key = size.astype(np.uint64)
        for k in range(window):
            has = size > k
            key[has] = mix(key[has] * U(3) + self.words[first[has] + k])
        item = np.repeat(np.array([number[i] for i, _ in items], np.int64), many)
        _, once, of = np.unique(key, return_index=True, return_inverse=True)
        pair = np.unique(of.ravel() * max(1, len(self.names)) + item)
        self.first, self.size = first[once].astype(np.int32), size[once].astype(np.int8 if window < 128 else np.int32)
        self.off = np.searchsorted(pair // max(1, len(self.names)), np.arange(len(once) + 1)).astype(np.int32)
        self.item_of = (pair % max(1, len(self.names))).astype(np.int32)

    def occurrences(self, segment: Segment):
        """(window, position) arrays of all occurrences, some windows at a time."""
        there = np.concatenate([[0], np.cumsum(segment.find(self.words) >= 0, dtype=np.int32)])
        use = np.flatnonzero(there[self.first + self.size] - there[self.first] == self.size)
        for lo in range(0, len(use), WINDOWS):
            some = use[lo : lo + WINDOWS]
            size = self.size[some].astype(np.int64)
            terms = np.zeros((len(some), self.window), np.uint64)
            for k in range(self.window):
                has = size > k
                terms[has, k] = self.words[self.first[some[has]] + k]
            q, at = segment.phrases(terms, size)
            yield some[q], at

    def matched(self, segment: Segment) -> tuple[np.ndarray, list[list[str]]]:
        """Which words of the block are inside an occurrence, and the items of each document in string order."""
        hit, pairs = np.zeros(int(segment.off[-1]), bool), [np.zeros(0, np.int64)]
        for q, at in self.occurrences(segment):
            hit |= covered(at, self.size[q].astype(np.int64), len(hit))
            n = (self.off[q + 1] - self.off[q]).astype(np.int64)
            items = self.item_of[np.repeat(self.off[q] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs.append(np.unique(np.repeat(segment.doc(at), n) * max(1, len(self.names)) + items))
        found: list[list[str]] = [[] for _ in segment.n_words]
        for x in np.unique(np.concatenate(pairs)).tolist():
            found[x // len(self.names)].append(self.names[x % len(self.names)])
        return hit, found


def _batches(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (id, text) with about ``BATCH`` bytes each, by a hash of the id; items without id or text are left out."""
    items = narrowed(benchmark, item_col, text_col).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BATCH) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield n, sorted((r["item"], r["text"]) for r in part.collect())


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a word of a document is hit if it lies in
    an occurrence of a window. Items of one id are one item; items without id or text and those without words never match.
    Null and empty texts have no words and are clean; without documents there are no rows. Repeated documents stay.

    The index is read once for each ``BATCH`` bytes of items. With several, only documents that a batch hits are shuffled.
    """
    tune(docs.sparkSession)
    index = build_index(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    parts = []
    for n, items in _batches(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Queries(items, window))  # at most BATCH bytes of items

        def run(batches, shared=shared, n=n):
            for b in batches:
                for r in range(b.num_rows):
                    segment = Segment(*(column(b, c)[r].as_buffer() for c in ("n_words", "terms", "ends", "gaps")))
                    hit, found = shared.value.matched(segment)
                    if n == 1:
                        n_hit = run_sums(hit, segment.off)
                        yield pa.RecordBatch.from_arrays([column(b, "ids")[r].values, pa.array(segment.n_words), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array([sha256_of(x) for x in found]), pa.array(n_hit > 0)], names)
                    else:
                        some = [k for k, x in enumerate(found) if x]
                        mark = [np.packbits(hit[segment.off[k] : segment.off[k + 1]]).tobytes() for k in some]
                        key = column(b, "block")[r].as_py()
                        yield pa.RecordBatch.from_arrays([pa.array([f"{key}-{k}" for k in some], pa.string()), pa.array(mark, pa.binary()), pa.array([found[k] for k in some], pa.list_(pa.string()))], ["row", "mark", "items"])

        out = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if n == 1 else "row string, mark binary, items array<string>"
        parts.append(index.mapInArrow(releasing(run), out))
    if len(parts) == 1:
        return parts[0].withColumnRenamed("id", id_col)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    met = every.groupBy("row").agg(F.collect_list("mark").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def joined(batches):
        for b in batches:
            n_hit = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in marks])).sum()) for marks in column(b, "marks").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array(n_hit, pa.int64()), column(b, "items")], ["row", "n_hit", "items"])

    def every_row(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, key = column(b, "ids")[r].values, column(b, "block")[r].as_py()
                n_words = np.frombuffer(column(b, "n_words")[r].as_buffer(), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f"{key}-{k}" for k in range(len(ids))], pa.string()), ids, pa.array(n_words)], ["row", "id", "n_words"])

    hits = written(met.mapInArrow(joined, "row string, n_hit long, items array<string>"), "hits")
    out = index.select("block", "ids", "n_words").mapInArrow(every_row, f"row string, id {kind}, n_words long").join(hits, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def find(index: DataFrame, queries: list[str], span: int | None = None) -> DataFrame:
    """Matches (query, id, position) in an index of ``build_index``: of exact phrases or, with ``span``, of spans of that many
    words that hold all words of the query in any order (a word that a query repeats counts once). Position is the first word's
    in its document. Queries without words match nothing."""
    size_of = Block.of(queries).words(ALNUM)
    n = size_of.count
    terms = np.zeros((len(queries), int(n.max()) if len(n) else 0), np.uint64)
    for k, (a, z) in enumerate(zip(size_of.off, size_of.off[1:], strict=False)):
        mine = size_of.hash[a:z] if span is None else np.unique(size_of.hash[a:z])
        terms[k, : len(mine)], n[k] = mine, len(mine)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                segment = Segment(*(column(b, c)[r].as_buffer() for c in ("n_words", "terms", "ends", "gaps")))
                q, at = segment.phrases(terms, n) if span is None else segment.near(terms, n, span)
                doc = segment.doc(at)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), column(b, "ids")[r].values.take(pa.array(doc)), pa.array(at - segment.off[doc])], ["query", "id", "position"])

    return index.mapInArrow(run, f"query int, id {kind}, position long")
