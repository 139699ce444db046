"""URL filters: rules, then host word segmentation and multinomial naive Bayes.

Names in hosts are split into words by unigram Viterbi; word counts come from the visible text of all pages. Naive Bayes scores
the words of hosts and the tokens of paths. It learns from the pages that the rules decide, and gives a verdict on the others: what
is near to blocked hosts and paths is blocked. No list of words is given.

Distinct names, hosts and paths are what is segmented and scored, so frequent ones cost no more than rare ones. All
joins back to rows go through ``joins.lookup``, which doesn't shuffle rows of hot keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup
from .store import column, narrowed, pieces, tune, written
from .textbytes import ALPHA, Block, spans_hash

#: Bytes of the longest word that a segmentation knows, and letters of a name that are segmented at once (labels of real hosts have 63).
LONGEST, NAME = 24, 512
_names = regex.compile(r"[a-z\x80-\U0010ffff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c):
    return F.translate(c, _UPPER, _LOWER)


def parts(url):
    """(host, path) columns: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path then goes up to ``?``, ``#`` or the end. Null and a URL without ``://`` have two empty ones."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit((1 << 31) - 1))), F.lit(""))
    return lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Rules:
    """(verdict, rule) pairs; a rule is a host, and from its first ``/`` on the beginning of a path."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict; of equally long ones the first given."""
        found, name = (None, None), host
        while name:
            for start, rule, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and (found[0] is None or len(rule) > len(found[0])):
                    found = (rule, verdict)
            _, _, name = name.partition(".")
        return found


#: What isn't visible text: bodies of scripts and styles, and comments; without an end they go on to that of the page.
_HIDDEN = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)"


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, c): 64-bit hashes and counts of all words in the visible text of all pages; stored. Brackets count within a page only."""

    def run(batches):
        for b in pieces(batches, "html"):
            block = Block(column(b, "html"))
            words = block.words(ALPHA)
            depth = np.concatenate([[0], np.cumsum((words.data == 60).astype(np.int32) - (words.data == 62))])
            before = np.repeat(depth[block.off[:-1]], words.count)  # of the pages before
            size = words.end - words.start
            seen = np.flatnonzero((size >= 2) & (size <= LONGEST) & (depth[words.start] <= before))
            word, c = np.unique(words.hash[seen], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], ["word", "c"])

    rows = pages.select(F.regexp_replace(html_col, _HIDDEN, "<>").alias("html")).mapInArrow(run, "word long, c long")
    return written(rows.groupBy("word").agg(F.sum("c").alias("c")), "words")


def viterbi(name: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest split of ``name``. known: (start, end, count) of parts that are words; any other part has the chance
    10 / (total * 10 ** length), so that unknown names stay whole rather than fall apart. Of equal ones, the first word is shorter.

    Time and space grow with the length and the number of known parts: an unknown part is carried on letter by letter.
    """
    n = len(name)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for a, b, c in known:
        ends[b].append((a, math.log(c / total)))
    letter, enter = -math.log(10), math.log(10 / total)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    run, start = -math.inf, 0  # the best split that ends in an unknown part here, and where that starts
    for b in range(1, n + 1):
        if best[b - 1] + enter > run:
            run, start = best[b - 1] + enter, b - 1
        run += letter
        best[b], back[b] = run, start
        for a, p in ends[b]:
            if best[a] + p > best[b]:
                best[b], back[b] = best[a] + p, a
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end) of all parts of 2 to ``LONGEST`` bytes."""
    size = np.diff(off)
    of, n = np.repeat(np.arange(len(size)), size), int(off[-1])
    start = np.arange(n) - np.repeat(off[:-1], size)
    many = np.maximum(np.minimum(size[of] - start, LONGEST) - 1, 0)
    at = np.repeat(np.arange(n), many)
    length = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 2
    return of[at], start[at], start[at] + length


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for each distinct name (a..z and letters beyond ASCII): every part of up to ``LONGEST`` bytes is looked up in the counts."""
    total = int(words.agg(F.sum("c")).first()[0] or 1)
    names = written(names.select("name", F.monotonically_increasing_id().alias("key")), "names")

    def cut(batches):
        for b in pieces(batches, "name", 1 << 15):
            block = Block(column(b, "name"))
            of, a, z = _spans(block.data, block.off)
            lo = block.off[:-1][of]
            word = spans_hash(block.data, lo + a, lo + z).view(np.int64)
            key = column(b, "key").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(z), pa.array(word)], ["key", "a", "b", "word"])

    parts = written(names.mapInArrow(cut, "key long, a long, b long, word long"), "parts")
    found = lookup(parts, words, "word", how="inner").groupBy("key").agg(F.collect_list(F.struct("a", "b", "c")).alias("known"))  # LONGEST for each of NAME letters at most
    both = names.join(found, "key", "left").select("name", "known")

    def split(batches):
        for b in batches:
            out = []
            for name, known in zip(column(b, "name").to_pylist(), column(b, "known").to_pylist(), strict=True):
                raw = name.encode()  # positions are those of bytes
                spans = sorted((r["a"], r["b"], r["c"]) for r in known or ())
                if len(raw) != len(name):
                    place = {len(name[:k].encode()): k for k in range(len(name) + 1)}
                    spans = [(place[a], place[z], c) for a, z, c in spans if a in place and z in place]
                out.append(viterbi(name, spans, total))
            yield pa.RecordBatch.from_arrays([column(b, "name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return written(both.mapInArrow(split, "name string, words array<string>"), "segmented")


def host_names(host: str | None) -> list[str]:
    """The names of a host in order: runs of letters, cut after every ``NAME`` letters."""
    return [m[k : k + NAME] for m in _names.findall(host or "") for k in range(0, len(m), NAME)]


def path_tokens(path):
    """Tokens of a path: letters, A-Z lower-cased; each run of digits is one ``#``."""
    return F.filter(F.split(F.regexp_replace(lowered(path), "[0-9]+", "/#/"), r"[^a-z#\u0080-\x{10FFFF}]+"), lambda x: x != "")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", learn_if=None, alpha: float = 0.5) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, score (probability of block by naive Bayes).

    The longest fitting rule decides; without one, block is what naive Bayes finds likelier. It learns from the pages that rules decide and where
    ``learn_if`` (a Column of ``pages``; default: all) holds, each with the tokens of its host and of its path, which are told apart. Tokens
    that none of those has say nothing. Without such pages, or with those of one kind only, the prior decides; it is even without any, and allows.
    A null URL or one without ``://`` has an empty host and path, no rule, and the verdict of a page without tokens. Null html adds no words. Without pages there
    are no rows; repeated rows stay; other columns don't matter.
    """
    tune(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    table = Rules(rules)

    def match(batches):
        for b in batches:
            found = [table.best(h, p) for h, p in zip(column(b, "host").to_pylist(), column(b, "path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], [*b.schema.names, "rule", "ruled"])

    host, path = parts(F.col(url_col))
    learns = F.lit(True) if learn_if is None else F.coalesce(learn_if, F.lit(False))
    pages = narrowed(pages, id_col, url_col, html_col)
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.array_join(path_tokens(path), " ").alias("key"), learns.alias("learn"))
    judged = written(judged.mapInArrow(match, f"id {kind}, host string, path string, key string, learn boolean, rule string, ruled string"), "urls")
    words = page_words(pages, html_col)

    bad, good = (F.count(F.when(F.col("learn") & (F.col("ruled") == v), 1)) for v in ("block", "allow"))
    hosts = written(judged.groupBy("host").agg(bad.alias("bad"), good.alias("good")), "hosts")
    paths = written(judged.groupBy("key").agg(bad.alias("bad"), good.alias("good")), "paths")

    def named(batches):
        for b in batches:
            found = [host_names(h) for h in column(b, "host").to_pylist()]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([column(b, "host").take(at), pa.array([n for x in found for n in x], pa.string()), column(b, "bad").take(at), column(b, "good").take(at)], ["host", "name", "bad", "good"])

    in_hosts = written(hosts.mapInArrow(named, "host string, name string, bad long, good long"), "in_hosts")
    names = written(in_hosts.groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "names")
    split = segmented(names.select("name"), words)
    in_names = written(names.join(split, "name").select("name", F.explode("words").alias("token"), "bad", "good"), "in_names")
    in_paths = written(paths.select("key", F.explode(F.filter(F.split("key", " "), lambda x: x != "")).alias("token"), "bad", "good").withColumn("token", F.concat(F.lit("/"), "token")), "in_paths")

    counts = in_names.select("token", "bad", "good").union(in_paths.select("token", "bad", "good")).groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = written(counts.where("bad + good > 0"), "tokens")
    t = counts.agg(F.count("*").alias("v"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    r = paths.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    n_bad, n_good = r["bad"] or 0, r["good"] or 0
    prior = math.log((n_bad + alpha) / (n_good + alpha))
    if n_bad and n_good:
        of = lambda c, n: F.log((F.col(c) + alpha) / (n + alpha * t["v"]))
        weights = counts.select("token", (of("bad", t["bad"]) - of("good", t["good"])).alias("w"))
    else:
        weights = counts.select("token", F.lit(0.0).alias("w"))
    weights = written(weights, "weights")

    def added(rows: DataFrame, by: DataFrame, on: str, key: str, name: str) -> DataFrame:
        return written(lookup(rows, by, on, how="inner").groupBy(key).agg(F.sum("w").alias(name)), name)

    by_name = added(in_names.select("name", "token"), weights, "token", "name", "by_name").withColumnRenamed("by_name", "w")
    by_host = added(in_hosts.select("host", "name"), by_name, "name", "host", "by_host")
    by_path = added(in_paths.select("key", "token"), weights, "token", "key", "by_path")
    out = lookup(lookup(judged.drop("learn"), by_host, "host"), by_path, "key")
    odds = F.lit(prior) + F.coalesce("by_host", F.lit(0.0)) + F.coalesce("by_path", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(F.round(odds, 9) > 0, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), (1 / (1 + F.exp(-odds))).alias("score"))
