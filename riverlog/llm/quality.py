"""Quality rules: exact counts, and a linear-chain CRF that marks each line as content or boilerplate.

The CRF has two states, weights for the features of a line and for transitions. It learns from documents with a quality label:
each line starts with its document's label, and after a first training the lines of poor documents that the model is sure to be
content are taken as such (one round of self-training). Viterbi decoding marks the lines; a document is kept if enough of its
characters are in content lines. The wanted share is fitted on the same sample so that good documents stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup
from .sample import choose, place, sampled, stored_places
from .store import column, narrowed, pieces, tune
from .textbytes import NOT_SPACE, SAME, Block, U, covered, mix, run_sums, spans_hash

#: At most that many documents of either quality are learned from; longer ones than this many lines are not.
DOCS_EACH, MOST_LINES = 1200, 1500
#: Texts of more lines are decoded one by one.
LONG = 256
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
FEATURES = ("bias", "symbols", "has_symbols", "upper", "digits", "pipes", "marks", "short", "long_words", "dup", "repeat", "stop")


class Lines:
    """The exact counts of texts, and their lines with words: ``off`` by text, ``chars`` and ``x`` (features) by line."""

    def __init__(self, block: Block, window: int = WINDOW):
        data = block.data
        words = block.words(NOT_SPACE, SAME)
        self.n_words = words.count.astype(np.int64)
        point = (data & 0xC0) != 0x80
        solid = NOT_SPACE[data]
        self.word_chars = block.sums(solid & point)
        symbol = _SYMBOL[data]
        self.n_symbols = block.sums(symbol)
        text = words.text
        first = words.windows(window)
        repeated = np.zeros(words.n, bool)
        if len(first):
            key = mix(words.window_hash(first, window) ^ mix(text[first].astype(np.uint64) + U(1)))
            _, of, n = np.unique(key, return_inverse=True, return_counts=True)
            repeated = covered(first[n[of] > 1], window, words.n)
        self.n_repeat_words = run_sums(repeated, words.off)
        breaks = np.flatnonzero(data == 10)
        place = np.searchsorted(breaks, words.start)
        begins = np.empty(words.n, bool)
        if words.n:
            begins[0], begins[1:] = True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(begins)
        of_text, at = text[head], place[head]
        low, high = block.off[:-1][of_text], block.off[1:][of_text]
        edge = np.concatenate([[-1], breaks, [len(data)]])
        start, end = np.maximum(edge[at] + 1, low), np.minimum(edge[at + 1], high)
        key = mix(spans_hash(data, start, end) ^ mix(of_text.astype(np.uint64) + U(1)))
        self.dup = np.ones(len(head), bool)
        self.dup[np.unique(key, return_index=True)[1]] = False
        self.off = np.searchsorted(of_text, np.arange(block.n + 1))
        self.n_dup_lines = run_sums(self.dup, self.off)

        def inside(values):
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return (total[end] - total[start]).astype(np.float64)

        self.chars = np.maximum(inside(solid & point), 1)
        word_off = np.append(head, words.n)
        n = np.diff(word_off).astype(np.float64)
        letters = np.maximum(inside(_UPPER[data] | _LOWER[data]), 1)
        symbols = inside(symbol)
        last = data[words.end[word_off[1:] - 1] - 1] if len(head) else data[:0]
        self.x = np.stack([
            np.ones(len(head)), np.minimum(symbols / n, 3), symbols > 0, inside(_UPPER[data]) / letters, inside(_DIGIT[data]) / self.chars,
            np.minimum(inside(data == 124) / n, 1), np.minimum(inside(data == 33) / n, 2), n < 4, self.chars / n > 12, self.dup, run_sums(repeated, word_off) / np.maximum(n, 1), np.isin(last, (46, 33, 63)),
        ], axis=1) if len(head) else np.zeros((0, len(FEATURES)))


def _steps(off: np.ndarray):
    """For t = 0, 1, ...: the texts with more than t lines and their t-th lines."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    live, t = int((n > 0).sum()), 0
    while live:
        who = order[:live]
        yield who, off[who] + t
        t += 1
        live = np.searchsorted(-n[order], -t)


class LineModel:
    """``w``: features by state (0 content, 1 boilerplate); ``trans``: from state to state; ``share``: of content that a kept text has."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, share: float):
        self.w, self.trans, self.share = w, trans, share

    def viterbi(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The likeliest states of all lines. Texts advance line by line together; those of over ``LONG`` lines go one by one, as few
        texts would be alive at a time."""
        emit, state, n = x @ self.w, np.zeros(len(x), np.int8), np.diff(off)
        for k in np.flatnonzero(n > LONG):
            state[off[k] : off[k + 1]] = self._one(emit[off[k] : off[k + 1]])
        few = np.repeat(n <= LONG, n)
        emit, n = emit[few], np.where(n <= LONG, n, 0)
        state[few] = self._together(emit, np.concatenate([[0], np.cumsum(n)]))
        return state

    def _one(self, emit: np.ndarray) -> list[int]:
        (t00, t01), (t10, t11) = self.trans.tolist()
        rows = iter(emit.tolist())
        a, b = next(rows)
        back = []
        for x, y in rows:
            p, q = a + t00, b + t10
            r, s = a + t01, b + t11
            back.append((int(q > p), int(s > r)))
            a, b = max(p, q) + x, max(r, s) + y
        now = int(b > a)
        out = [now]
        for pair in reversed(back):
            now = pair[now]
            out.append(now)
        return out[::-1]

    def _together(self, emit: np.ndarray, off: np.ndarray) -> np.ndarray:
        best, back, state = np.zeros((len(off) - 1, 2)), np.zeros((len(emit), 2), np.int8), np.zeros(len(emit), np.int8)
        for t, (who, line) in enumerate(_steps(off)):
            if t:
                via = best[who][:, :, None] + self.trans
                back[line] = via.argmax(axis=1)
                best[who] = via.max(axis=1)
            best[who] += emit[line]
        if len(emit):
            n = np.diff(off)
            at = best.argmax(axis=1)
            full = np.flatnonzero(n)
            line = off[1:][full] - 1
            now = at[full]
            while len(full):
                state[line] = now
                now = back[line, now]
                go = line > off[full]
                full, line, now = full[go], line[go] - 1, now[go]
        return state

    def posterior(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(state) by line, expected transitions, log partition, by forward and backward sums."""
        emit = x @ self.w
        a, b = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        steps = list(_steps(off))
        for t, (_, line) in enumerate(steps):
            a[line] = emit[line] + (np.logaddexp(*np.moveaxis(a[line - 1][:, :, None] + self.trans, 1, 0)) if t else 0)
        for t in range(len(steps) - 2, -1, -1):
            line = steps[t + 1][1] - 1
            b[line] = np.logaddexp(*np.moveaxis(self.trans + (emit[line + 1] + b[line + 1])[:, None, :], 2, 0))
        full = np.flatnonzero(np.diff(off))
        end = off[1:][full] - 1
        z = np.zeros(len(off) - 1)
        z[full] = np.logaddexp(a[end, 0], a[end, 1])
        of = np.repeat(np.arange(len(off) - 1), np.diff(off))
        p = np.exp(a + b - z[of][:, None])
        later = np.flatnonzero(np.concatenate([[False], of[1:] == of[:-1]])) if len(x) else np.zeros(0, int)
        pair = np.exp(a[later - 1][:, :, None] + self.trans + (emit[later] + b[later])[:, None, :] - z[of[later]][:, None, None])
        return p, pair.sum(axis=0), float(z.sum())

    def content_share(self, lines: Lines) -> np.ndarray:
        """Content characters by all characters of lines with words; 0 without such lines."""
        content = run_sums(np.where(self.viterbi(lines.x, lines.off) == 0, lines.chars, 0.0), lines.off)
        return content / np.maximum(run_sums(lines.chars, lines.off), 1)


#: Where there are no labels to learn from: symbols, bars, capitals and repetition speak for boilerplate.
DEFAULT = LineModel(np.stack([np.zeros(len(FEATURES)), np.array([-2.5, 4, 1, 3, 2, 4, 3, 0.2, 0.2, 1.5, 1.5, -0.5])], axis=1), np.array([[0.5, -0.5], [-0.5, 0.5]]), 0.3)


def fit(x: np.ndarray, off: np.ndarray, state: np.ndarray, rounds: int = 80, rate: float = 0.15) -> LineModel:
    """Maximises the conditional likelihood of ``state`` with an L2 penalty by Adam steps."""
    model = LineModel(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), 0.5)
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    later = np.flatnonzero(of[1:] == of[:-1]) + 1
    one = np.eye(2)[state]
    seen_w, seen_t = x.T @ one, np.zeros((2, 2))
    np.add.at(seen_t, (state[later - 1], state[later]), 1)
    theta = np.zeros(x.shape[1] * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, pairs, _ = model.posterior(x, off)
        g = np.concatenate([(x.T @ p - seen_w).ravel(), (pairs - seen_t).ravel()]) / len(x) + 1e-3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)
        model = LineModel(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2), 0.5)
    return model


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> LineModel:
    """rows: (features, characters) of the lines of each document; good: its quality label. Both labels have to occur, else DEFAULT."""
    if not len(good) or good.all() or not good.any():
        return DEFAULT
    off = np.concatenate([[0], np.cumsum([len(x) for x, _ in rows])])
    x, chars = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    if not len(x):
        return DEFAULT
    label = np.repeat(~good, np.diff(off)).astype(int)
    model = fit(x, off, label)
    p, _, _ = model.posterior(x, off)
    model = fit(x, off, np.where((label == 1) & (p[:, 0] > 0.8), 0, label))
    content = run_sums(np.where(model.viterbi(x, off) == 0, chars, 0.0), off) / np.maximum(run_sums(chars, off), 1)
    grid = np.linspace(0.02, 0.98, 49)
    right = [np.mean((content >= t) == good) if np.mean(content[good] >= t) >= 0.99 else -1 for t in grid]
    model.share = float(grid[int(np.argmax(right))]) if max(right) > 0 else 0.02
    return model


def learn(docs: DataFrame, labels: DataFrame, learn_if=None, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", docs_each: int = DOCS_EACH) -> LineModel:
    """Learns from labelled rows of ``docs`` where ``learn_if`` (a Column; default: all) holds: at most ``docs_each`` texts of either quality
    and ``sample.ROOM`` of their lines' features, by a hash of the text, so that copies count once (all where fewer).

    Rows with more than ``MOST_LINES`` lines or none aren't learned from; the driver gets the line features of the others.
    An id with several labels is good only if all are 1; null labels don't count. Without labels, or with one kind only, DEFAULT is used.
    """
    tune(docs.sparkSession)
    label = narrowed(labels, id_col, quality_col).where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(quality_col).cast("int").alias("good"))
    text = narrowed(docs, id_col, text_col).where(F.lit(True) if learn_if is None else learn_if).where(F.col(text_col).isNotNull())
    text = text.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), place(text_col).alias("place"))
    lines = F.least(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(MOST_LINES))
    every = stored_places(text.select("id", "place", (lines * 4 * (len(FEATURES) + 1)).cast("long").alias("cost")))
    known = lookup(every, stored_places(label), "id", how="inner").where("good in (0, 1)")
    chosen = choose(stored_places(known.select(F.when(F.col("good") == 1, "good").otherwise("poor").alias("group"), "place", "cost")), docs_each)

    def run(batches):
        for b in pieces(batches, "text"):
            lines = Lines(Block(column(b, "text")))
            got = [(k, a, c) for k, (a, c) in enumerate(zip(lines.off, lines.off[1:], strict=False)) if 0 < c - a <= MOST_LINES]
            at = pa.array([k for k, _, _ in got], pa.int32())
            yield pa.RecordBatch.from_arrays([column(b, "place").take(at), column(b, "group").take(at), pa.array([lines.x[a:c].astype("<f4").tobytes() for _, a, c in got], pa.binary()), pa.array([lines.chars[a:c].astype("<f4").tobytes() for _, a, c in got], pa.binary())], ["place", "group", "x", "chars"])

    sample = sampled(text.select("text", "place"), chosen).select("text", "place", "group").mapInArrow(run, "place long, group string, x binary, chars binary").dropDuplicates(["place", "group"])
    got = sorted(sample.collect(), key=lambda r: (r["place"], r["group"]))
    return train([(np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64), np.frombuffer(r["chars"], "<f4").astype(np.float64)) for r in got], np.array([r["group"] == "good" for r in got], bool))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: LineModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the counts, base_failed, content_share and kept.

    base_failed: under 10 words, or over 20 % of the words in 5-word windows that occur twice or more. kept: base_failed is false
    and the content share reaches the model's. Null and empty texts have counts of 0 and are base_failed. Rows stay as they are;
    other columns don't matter. No rows give no rows.
    """
    tune(docs.sparkSession)
    chosen = narrowed(docs, *keep, text_col).select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "content_share double"])

    def run(batches):
        for b in pieces(batches, "__text"):
            lines = Lines(Block(column(b, "__text")))
            failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > REPEAT_PERCENT * lines.n_words)
            share = model.content_share(lines)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(getattr(lines, c)) for c in COUNTS), pa.array(failed), pa.array(~failed & (share >= model.share)), pa.array(share)], [*b.schema.names[:-1], *COUNTS, "base_failed", "kept", "content_share"])

    return chosen.mapInArrow(run, schema)
