"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3- and 4-grams within words (hashed to ``BUCKETS``), followed by a linear
layer and softmax. Both layers are trained together by stochastic gradient descent in numpy on the driver, on a bounded
sample of labelled rows. Temperature scaling on rows that training left out calibrates the probabilities, and the rejection
threshold is the least one at which accepted rows reach the wanted precision there.

For prediction, embeddings times weights fold into one table of ``BUCKETS`` rows, so that a text's logits are a mean of table
rows: one vectorised pass over the bytes, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import choose, place, sampled, stored_places
from .store import column, narrowed, pieces, tune
from .textbytes import ALPHA, LOWER, Block, U

BUCKETS = 1 << 14
#: At most that many rows of each language are learned from.
ROWS_EACH = 1500
_ASCII_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
_letter = regex.compile(r"\p{L}")
_K = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def subwords(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and the offsets of each text's. Words are runs of letters (A-Z lower-cased) and bytes over
    127, with a mark at each end; a subword may begin or end with a mark, but doesn't span words."""
    n = len(block.data)
    room = np.zeros(n + 2 * block.n + 1, np.uint8)  # one mark before and one after each text
    at = np.arange(n) + np.repeat(2 * np.arange(block.n) + 1, np.diff(block.off))
    folded = LOWER[block.data]
    room[at] = np.where(ALPHA[folded], folded, 0)
    off = block.off + 2 * np.arange(block.n + 1)
    wide, solid = room.astype(np.uint64), room != 0
    h3 = wide[:-2] * _K[0] + wide[1:-1] * _K[1] + wide[2:] * _K[2] if len(room) > 2 else np.zeros(0, np.uint64)
    first3 = np.flatnonzero(solid[1:-1]) if len(room) > 2 else np.zeros(0, np.int64)
    first4 = np.flatnonzero(solid[1:-2] & solid[2:-1]) if len(room) > 3 else np.zeros(0, np.int64)
    shift = U(64 - BUCKETS.bit_length() + 1)
    mixed = U(0xD6E8FEB86659FD93)
    b3 = ((h3[first3] * mixed) >> shift).astype(np.int32)
    b4 = (((h3[first4] + wide[first4 + 3] * _K[3]) * mixed) >> shift).astype(np.int32)
    out_off = np.searchsorted(first3, off) + np.searchsorted(first4, off)
    order = np.argsort(np.concatenate([first3, first4]), kind="stable") if len(first4) else np.arange(len(first3))
    return np.concatenate([b3, b4])[order], out_off


def _table_sums(table: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The sum of table rows over each text's subwords, and their number; the order of subwords doesn't matter."""
    ids, off = subwords(block)
    rows = np.zeros((len(ids) + 1, table.shape[1]))
    np.cumsum(table[ids], axis=0, out=rows[1:])
    return rows[off[1:]] - rows[off[:-1]], np.diff(off)


def bags(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the buckets that occur and how often."""
    ids, off = subwords(block)
    return [np.unique(ids[a:b], return_counts=True) for a, b in zip(off, off[1:], strict=False)]


class LanguageModel:
    """``table``: logits by bucket; ``bias``; ``langs``; ``temperature``; ``reject``: texts with a lower score are rejected."""

    def __init__(self, table, bias, langs, temperature, reject):
        self.table, self.bias, self.langs, self.temperature, self.reject = table, bias, langs, temperature, reject

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected for each text. A null text and one without a letter is ``und``, 1.0."""
        block = Block(texts)
        known = block.sums(_ASCII_LETTER[block.data]) > 0
        for k in np.flatnonzero(~known & (block.sums(block.data > 127) > 0)):  # letters beyond ASCII only
            known[k] = _letter.search(texts[int(k)].as_py()) is not None
        if not self.langs:
            return ["und"] * block.n, np.where(known, 0.0, 1.0), known
        sums, n = _table_sums(self.table, block)
        p = softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(block.n), best] if block.n else 0.0, 1.0)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)], score, known & (score < self.reject)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return x / x.sum(axis=1, keepdims=True)


def train(bag: list[tuple[np.ndarray, np.ndarray]], y: list[str], dim: int = 16, epochs: int = 5, rate: float = 0.5, precision: float = 0.995, seed: int = 7) -> LanguageModel:
    """Trains on four fifths of the rows and calibrates on the rest. Without rows the model knows no language."""
    langs = sorted(set(y))
    if not langs:
        return LanguageModel(np.zeros((BUCKETS, 1)), np.zeros(1), [], 1.0, 0.0)
    rng = np.random.default_rng(seed)
    label = np.array([langs.index(v) for v in y])
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    rows = rng.permutation(len(y))
    aside, used = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    share = [(ids, (n / n.sum()).astype(np.float64) if len(n) else n.astype(np.float64)) for ids, n in bag]
    one = np.eye(len(langs))
    total, done = epochs * len(used), 0
    for _ in range(epochs):
        for k in rng.permutation(used):
            ids, w = share[k]
            mean = w @ emb[ids] if len(ids) else np.zeros(dim)
            g = softmax((mean @ out + bias)[None])[0] - one[label[k]]
            step = rate * (1 - done / total)
            back = out @ g
            out -= step * np.outer(mean, g)
            bias -= step * 0.1 * g
            emb[ids] -= step * len(ids) ** 0.5 * np.outer(w, back)
            done += 1
    table = emb @ out
    if not len(aside):
        return LanguageModel(table, bias, langs, 1.0, 0.0)
    logits = np.array([(w @ table[ids] if len(ids) else np.zeros(len(langs))) + bias for ids, w in (share[k] for k in aside)])
    grid = np.geomspace(0.05, 10, 60)
    temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(aside)), label[aside]] + 1e-12).mean()))
    p = softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == label[aside]
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    reject = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 0.0
    return LanguageModel(table, bias, langs, temperature, reject)


def learn(docs: DataFrame, learn_if, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = ROWS_EACH) -> LanguageModel:
    """Learns from rows of ``docs`` where ``learn_if`` (a Column) holds and text and language aren't null.

    The sample has at most ``rows_each`` rows of each language and ``sample.ROOM`` of features (by a hash of language and text, so it is
    the same on each run, and copies count once), all of them where there are fewer; what goes to the driver are the subword
    counts of those rows, at most ``BUCKETS`` each. Without rows to learn from the model knows no language. ``learn_if`` may use ``id_col``.
    """
    tune(docs.sparkSession)
    labelled = narrowed(docs, id_col, text_col, lang_col).where(learn_if & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    labelled = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), place(lang_col, text_col).alias("place"))
    cost = F.least(F.octet_length("text") * 2, F.lit(BUCKETS)) * 8
    chosen = choose(stored_places(labelled.select(F.col("lang").alias("group"), "place", cost.cast("long").alias("cost"))), rows_each)
    if not chosen:
        return train([], [])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in pieces(batches, "text"):
            found = bags(Block(column(b, "text")))
            yield pa.RecordBatch.from_arrays([column(b, "place"), column(b, "lang"), pa.array([x.astype("<i4").tobytes() for x, _ in found]), pa.array([n.astype("<i4").tobytes() for _, n in found])], ["place", "lang", "ids", "n"])

    sample = sampled(labelled, chosen).select("text", "lang", "place").mapInArrow(run, "place long, lang string, ids binary, n binary").dropDuplicates(["place", "lang"])
    rows = sorted(sample.collect(), key=lambda r: (r["lang"], r["place"]))
    return train([(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score (calibrated, 0 to 1) and rejected.

    Null texts and those without a letter are ``und`` with score 1. Rows stay as they are, repeated or not; other columns of
    ``docs`` don't matter. With no language learned every text is ``und``. No rows give no rows.
    """
    tune(docs.sparkSession)
    chosen = narrowed(docs, *keep, text_col).select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        for b in pieces(batches, "__text"):
            lang, score, rejected = model.predict(column(b, "__text"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, schema)
