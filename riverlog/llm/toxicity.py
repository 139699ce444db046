"""Toxicity by non-negative positive-unlabelled learning.

Features are hashed words (letters; A-Z lower-cased) and word beginnings, by the logarithm of how often they occur in a text, and the
logarithm of its length, as long texts hold more by chance. Those that positive texts have clearly more often than unlabelled ones are kept
(a likelihood-ratio test, in which copies of a text count once). Linear classifiers are trained in numpy with the non-negative estimator of the risk: pi * E_pos[l(+)] + max(0, E_unl[l(-)] - pi * E_pos[l(-)]), where pi is the class prior,
from confirmed toxic texts and from texts whose label isn't looked at. When the bracket falls below zero, the step goes back up
its gradient instead. Classifiers with other seeds are averaged. Others leave a part
of the texts out each: there, the share of positive by unlabelled texts, times the prior, makes probabilities of the sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup
from .sample import choose, place, sampled, stored_places
from .store import column, narrowed, pieces, tune
from .textbytes import ALPHA, Block, U, mix, spans_hash

BITS = 20
POSITIVE, PLAIN = "positive", "unlabelled"
#: At most that many toxic texts and that many of any label are learned from, and that many words.
POSITIVES, UNLABELLED, FEATURES = 3000, 6000, 2048
#: Bytes of a word's beginning that are features too.
PREFIXES = (5, 6, 7, 8)
#: The likelihood ratio that a feature needs, and the levels of log2(1 + count) that are told apart.
CLEAR, LEVELS = 20.0, 3


def _features(block: Block):
    """(text, bucket) arrays of all words and of their beginnings, which stand for stems in languages that compound."""
    words = block.words(ALPHA)
    text, size = words.text, words.end - words.start
    yield text, (words.hash >> U(64 - BITS)).astype(np.int32)
    for k in PREFIXES:
        of = np.flatnonzero(size > k)
        h = spans_hash(words.data, words.start[of], words.start[of] + k)
        yield text[of], (mix(h + U(k)) >> U(64 - BITS)).astype(np.int32)


def word_buckets(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of each text in ascending order, their counts, offsets by text, and words by text."""
    found = [(text.astype(np.uint64) << U(BITS)) | ids.astype(np.uint64) for text, ids in _features(block)]
    key, n = np.unique(np.concatenate(found), return_counts=True)
    words = np.bincount((found[0] >> U(BITS)).astype(np.int64), minlength=block.n)
    return (key & U((1 << BITS) - 1)).astype(np.int32), n, np.searchsorted(key, np.arange(block.n + 1).astype(np.uint64) << U(BITS)), words


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1.0 + counts), LEVELS)


def length(words: np.ndarray) -> np.ndarray:
    """The feature for the length of texts, about 0 to 2."""
    return np.log10(1.0 + words / 10.0) / 2


class ToxicityModel:
    """``weights``: by feature in ``buckets``, and at last that of the length; a text's margin is their sum and ``bias``. Scores lie between
    the ``values`` at the margins ``at``, with a small share of a sigmoid, so that a higher margin always has a higher score."""

    def __init__(self, buckets, weights, bias, at, values):
        self.buckets, self.weights, self.bias, self.at, self.values = buckets, weights, bias, at, values

    def margins(self, block: Block) -> np.ndarray:
        n = len(self.buckets)
        if not n:
            return np.full(block.n, self.bias)
        place = np.full(1 << BITS, -1, np.int32)
        place[self.buckets] = np.arange(n)
        hits, words = [], None
        for text, ids in _features(block):  # few words are features: only those are counted
            words = np.bincount(text, minlength=block.n) if words is None else words
            at = place[ids]
            found = np.flatnonzero(at >= 0)
            hits.append(text[found] * n + at[found])
        hits, counts = np.unique(np.concatenate(hits), return_counts=True)
        return np.bincount(hits // n, self.weights[hits % n] * levels(counts), minlength=block.n)[: block.n] + self.weights[n] * length(words) + self.bias

    def scores(self, block: Block) -> np.ndarray:
        margin = self.margins(block)
        return 0.98 * np.interp(margin, self.at, self.values) + 0.02 * sigmoid(margin)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sign(features: np.ndarray, counts: np.ndarray) -> tuple:
    """Four min-hashes of (feature, count), which likely copies have in common."""
    h = mix((features.astype(np.uint64) << U(32)) | counts.astype(np.uint64))
    return tuple(int(mix(h * U(2) + U(2 * j + 1)).min()) for j in range(4)) if len(h) else ()


def _alone(signs: list[tuple], rows: np.ndarray) -> np.ndarray:
    """``rows`` without all but the first of texts that are likely copies."""
    seen, out = set(), []
    for k in rows.tolist():
        if signs[k] not in seen:
            seen.add(signs[k])
            out.append(k)
    return np.array(out, np.int64)


def _clear(docs: list[np.ndarray], signs: list[tuple], pos: np.ndarray, unl: np.ndarray) -> np.ndarray:
    """The features that stand out in positive texts by the likelihood-ratio statistic, at most ``FEATURES``, ascending."""

    def often(rows):
        return np.bincount(np.concatenate([docs[k] for k in rows] + [np.zeros(0, np.int32)]), minlength=1 << BITS).astype(np.float64)

    pos, unl = _alone(signs, pos), _alone(signs, unl)
    a, b = often(pos), often(unl)
    p, u, every = a / len(pos), b / len(unl), (a + b) / (len(pos) + len(unl))

    def part(k, n, share):  # k of n texts, by their own share and by the common one
        log = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(y, 1e-12)), 0.0)
        return log(k, n * share) + log(n - k, n * (1 - share))

    g = 2 * (part(a, len(pos), every) + part(b, len(unl), every))
    g[(a < 3) | (p <= u)] = 0
    top = np.argsort(-g, kind="stable")[:FEATURES]
    return np.sort(top[g[top] > CLEAR]).astype(np.int32)


def _matrix(docs: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    n = len(buckets)
    x = np.zeros((len(docs), n + 1), np.float32)
    for k, ids in enumerate(docs):
        at = np.searchsorted(buckets, ids)
        ok = at < n
        ok[ok] = buckets[at[ok]] == ids[ok]
        x[k, at[ok]] = levels(counts[k][ok])
    x[:, n] = length(words)
    return x


def _descend(x: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float, rng: np.random.Generator, epochs: int, rate: float) -> tuple[np.ndarray, float]:
    """One classifier by steps down the non-negative risk."""
    n = x.shape[1]
    w, b = rng.normal(0, 0.01, n), 0.0
    gw, gb = np.full(n, 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(pos), max(1, len(pos) // 256)):
            some = rng.choice(unl, min(len(unl), 3 * len(part) + 64), replace=False)
            xp, xu = x[part], x[some]
            sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
            # logistic loss: d l(+)/dm = s - 1, d l(-)/dm = s
            neg_risk = np.mean(-np.log(1 - su + 1e-9)) - prior * np.mean(-np.log(1 - sp + 1e-9))
            dp, du = prior * (sp - 1) / len(part), su / len(some)
            dn = -prior * sp / len(part)
            if neg_risk >= 0:
                dp = dp + dn
            else:
                dp, du = -dn, -du
            g = xp.T @ dp + xu.T @ du + 1e-4 * w
            h = dp.sum() + du.sum()
            gw += g * g
            gb += h * h
            w -= rate * g / np.sqrt(gw)
            b -= rate * h / np.sqrt(gb)
    return w, b


def train(docs: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, toxic: np.ndarray, unlabelled: np.ndarray, prior: float, folds: int = 4, models: int = 2, epochs: int = 60, rate: float = 0.1, seed: int = 11) -> ToxicityModel:
    """docs: distinct features by row, with counts; words: their number by row; toxic: rows confirmed; unlabelled: rows taken as
    unlabelled. ``models`` classifiers are averaged. For each of ``folds`` parts of the rows one more is trained without
    it, whose margins there scale the scores."""
    pos, unl = np.flatnonzero(toxic), np.flatnonzero(unlabelled)
    prior = float(np.clip(prior, 0.001, 0.9))
    if not len(pos) or not len(unl):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(1), 0.0, np.zeros(1), np.full(1, prior))
    rng, signs = np.random.default_rng(seed), [_sign(x, n) for x, n in zip(docs, counts, strict=True)]
    part_of, seen = [rng.permutation(len(r)) % folds for r in (pos, unl)], [np.zeros(len(r)) for r in (pos, unl)]
    for m in range(folds):
        used = [r[p != m] if (p != m).any() else r for r, p in zip((pos, unl), part_of, strict=True)]
        x = _matrix(docs, counts, words, _clear(docs, signs, *used))
        w, b = _descend(x, *used, prior, np.random.default_rng(seed + 1 + m), epochs, rate)
        for r, p, out in zip((pos, unl), part_of, seen, strict=True):
            out[p == m] = x[r[p == m]] @ w + b
    buckets = _clear(docs, signs, pos, unl)
    x = _matrix(docs, counts, words, buckets)
    found = [_descend(x, pos, unl, prior, np.random.default_rng(seed - m), epochs, rate) for m in range(models)]
    at, values = scale(*seen, prior)
    return ToxicityModel(buckets, np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found])), at, values)


def scale(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the probabilities at them, without negatives.

    P(toxic | margin) is prior * density among positives / density among unlabelled texts. The rising step function with the least
    squared risk, E_unl[s * s] - 2 * prior * E_pos[s], has that ratio on each step (adjacent violators are pooled); scores go
    straight from the middle of a step to that of the next.
    """
    margin = np.concatenate([pos, unl])
    order = np.argsort(margin, kind="stable")
    p = np.concatenate([np.full(len(pos), prior / len(pos)), np.zeros(len(unl))])[order]
    u = np.concatenate([np.zeros(len(pos)), np.full(len(unl), 1 / len(unl))])[order]
    steps: list[list[float]] = []  # of (positive mass, unlabelled mass, sum of margins, rows)
    for m, a, b in zip(margin[order].tolist(), p.tolist(), u.tolist(), strict=True):
        steps.append([a, b, m, 1])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            top = steps.pop()
            steps[-1] = [x + y for x, y in zip(steps[-1], top, strict=True)]
    at = np.array([m / n for _, _, m, n in steps])
    values = np.array([min(1.0, a / b) if b else 1.0 for a, b, _, _ in steps])
    return at, values


def learn(docs: DataFrame, labels: DataFrame, learn_if, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Learns from rows of ``docs`` where ``learn_if`` holds. ``labels`` has ids and 0 or 1.

    At most ``positives`` confirmed toxic texts and ``unlabelled`` texts whatever their label are taken, by a hash of the text, so that
    copies count once; to the driver go the hashed words of those, ``sample.ROOM`` bytes of either group at most. The prior is the share of
    toxic among the labelled learning rows; of labels equal to 0 nothing else is used. Repeated and null labels: an id is toxic if any of its labels
    is 1, and null labels don't count. Without positive or unlabelled rows every text gets the prior.
    """
    tune(docs.sparkSession)
    label = narrowed(labels, id_col, toxic_col).where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    text = narrowed(docs, id_col, text_col).where(learn_if).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), place(F.coalesce(F.col(text_col), F.lit(""))).alias("place"))
    cost = F.least(F.octet_length("text"), F.lit(1 << BITS)) * 8
    every = stored_places(text.select("id", "place", cost.cast("long").alias("cost")))
    known = stored_places(lookup(every, stored_places(label), "id", how="inner"))
    seen = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    groups = known.where("toxic = 1").select(F.lit(POSITIVE).alias("group"), "place", "cost")
    chosen = choose(groups, positives) + choose(every.select(F.lit(PLAIN).alias("group"), "place", "cost"), unlabelled)

    def run(batches):
        for b in pieces(batches, "text"):
            ids, n, off, words = word_buckets(Block(column(b, "text")))
            packed = [pa.array([v[a:c].astype("<i4").tobytes() for a, c in zip(off, off[1:], strict=False)], pa.binary()) for v in (ids, n)]
            yield pa.RecordBatch.from_arrays([column(b, "place"), column(b, "group"), *packed, pa.array(words)], ["place", "group", "ids", "n", "words"])

    sample = sampled(text.select("text", "place"), chosen).select("text", "place", "group").mapInArrow(run, "place long, group string, ids binary, n binary, words long").dropDuplicates(["place", "group"])
    got = sorted(sample.collect(), key=lambda r: (r["group"], r["place"]))
    toxic = np.array([r["group"] == POSITIVE for r in got], bool)
    prior = seen.get(1, 0) / max(1, sum(seen.values()))
    return train([np.frombuffer(r["ids"], "<i4") for r in got], [np.frombuffer(r["n"], "<i4") for r in got], np.array([r["words"] for r in got], np.int64), toxic, ~toxic, prior)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without words. Rows stay as they are; other columns don't matter. No rows give no rows.
    """
    tune(docs.sparkSession)
    chosen = narrowed(docs, *keep, text_col).select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", score double, predicted int"

    def run(batches):
        for b in pieces(batches, "__text"):
            s = model.scores(Block(column(b, "__text")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    return chosen.mapInArrow(run, schema)
