"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without building pieces: a trie of the vocabulary gets failure links and, for each
node, the number of pieces that leaving it by its link pops (the published linear-time maximal matching). A word then costs one
step for each byte and one for each link, however long it is. The automaton runs over all distinct words of a block in lockstep.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column, narrowed, pieces, tune
from .textbytes import NOT_SPACE, SAME, Block, U, run_sums


def byte_level_vocabulary(path: str) -> list[bytes]:
    """The tokens of a byte-level tokenizer file as bytes; tokens that start a word begin with a space. Special tokens are left out."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    special = {t["content"] for t in got.get("added_tokens", ()) if t.get("special")}
    return [bytes(byte[c] for c in t) for t in got["model"]["vocab"] if t not in special]


class Automaton:
    """``link`` and ``pops`` by node; children in an open-addressed table of (node, byte). Node 0 is the root, -1 is nothing."""

    def __init__(self, vocabulary: Iterable[bytes]):
        kids: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            at = 0
            for b in token:
                nxt = kids[at].get(b)
                if nxt is None:
                    nxt = kids[at][b] = len(kids)
                    kids.append({})
                    final.append(False)
                at = nxt
            final[at] = at != 0
        link, pops = [-1] * len(kids), [0] * len(kids)
        queue = [0]
        for u in queue:
            for b, v in kids[u].items():
                queue.append(v)
                if final[v]:
                    link[v], pops[v] = 0, 1
                    continue
                z, n = link[u], pops[u]
                while z >= 0 and b not in kids[z]:
                    n += pops[z]
                    z = link[z]
                if z >= 0:
                    link[v], pops[v] = kids[z][b], n
        self.link, self.pops = np.array(link, np.int32), np.array(pops, np.int32)
        keys = np.array([u << 8 | b for u, d in enumerate(kids) for b in d], np.int64)
        values = np.array([v for d in kids for v in d.values()], np.int32)
        self.shift = 64 - max(4, int(len(keys) * 4 + 1).bit_length())
        self.keys, self.values = np.full(1 << (64 - self.shift), -1, np.int64), np.full(1 << (64 - self.shift), -1, np.int32)
        slot, wait = self._slot(keys), np.arange(len(keys))
        while len(wait):
            free = self.keys[slot[wait]] < 0
            put = wait[free]
            self.keys[slot[put]] = keys[put]  # of several for one slot, the last stays
            mine = self.keys[slot[wait]] == keys[wait]
            self.values[slot[wait[mine]]] = values[wait[mine]]
            wait = wait[~mine]
            slot[wait] = (slot[wait] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(self.shift)).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by each byte, or -1."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        wait = np.arange(len(key))
        while len(wait):
            seen = self.keys[slot[wait]]
            hit = seen == key[wait]
            out[wait[hit]] = self.values[slot[wait[hit]]]
            wait = wait[~hit & (seen >= 0)]
            slot[wait] = (slot[wait] + 1) & (len(self.keys) - 1)
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: bytes = b" ") -> np.ndarray:
        """The number of greedy pieces of ``lead`` + data[start:end] for each span; 1 if a span can't be made of pieces."""
        n = len(start)
        node, count, dead = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        size = end - start

        def feed(who, byte):
            while len(who):
                nxt = self.child(node[who], byte)
                ok = nxt >= 0
                node[who[ok]] = nxt[ok]
                who, byte = who[~ok], byte[~ok]
                lost = self.link[node[who]] < 0
                dead[who[lost]] = True
                who, byte = who[~lost], byte[~lost]
                count[who] += self.pops[node[who]]
                node[who] = self.link[node[who]]

        for b in lead:
            feed(np.flatnonzero(~dead), np.full(int((~dead).sum()), b, np.int64))
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], 0)
        k = 0
        while live:
            who = order[:live]
            who = who[~dead[who]]
            feed(who, data[start[who] + k].astype(np.int64))
            k += 1
            live = np.searchsorted(-size[order], -k)
        who = np.flatnonzero(~dead & (node > 0))
        while len(who):
            lost = self.link[node[who]] < 0
            dead[who[lost]] = True
            who = who[~lost]
            count[who] += self.pops[node[who]]
            node[who] = self.link[node[who]]
            who = who[node[who] > 0]
        count[dead] = 1
        return count


def text_counts(automaton: Automaton, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text; the automaton sees each distinct word of the block once."""
    words = block.words(NOT_SPACE, SAME)
    _, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
    each = automaton.counts(words.data, words.start[first], words.end[first])
    return words.count, run_sums(each[of], words.off)


def count_tokens(docs: DataFrame, vocabulary: list[bytes], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words and n_tokens (long).

    Words are runs of anything but ASCII white space; a word's pieces are the greedy longest matches in a space and the word.
    A word with a part that no piece matches counts as one (unknown) token. Null and empty texts have 0 and 0. Rows stay as
    they are. The automaton is broadcast; its size is bounded by the vocabulary file.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))
    chosen = narrowed(docs, *keep, text_col).select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", n_words long, n_tokens long"

    def run(batches):
        for b in pieces(batches, "__text", 4 << 20):  # larger blocks: words repeat more
            n, tokens = text_counts(shared.value, Block(column(b, "__text")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n.astype(np.int64)), pa.array(tokens)], [*b.schema.names[:-1], "n_words", "n_tokens"])

    return chosen.mapInArrow(run, schema)
