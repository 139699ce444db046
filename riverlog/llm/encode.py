"""Ids of whole texts by the tokenizers library, with an exact cache of what stands between certain characters.

A byte-level tokenizer splits text by a pattern before it merges. Some places are ends of the pattern's pieces in any context:
before a space that other text follows, around a line break that stands alone, and between an ASCII letter or digit and ASCII
punctuation other than an apostrophe. Texts are cut into units there, which repeat much more often than texts do. Each worker keeps the
ids of units it has met in a table by 64-bit hash; the library's model sees the others. Texts in which such a cut might be
wrong (runs of white space, rare white space, special tokens) are split by the pattern itself, or left to the library as a whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .textbytes import Block, U, spans_hash

#: Units that a worker's table holds at most; then it starts anew.
UNITS = 1_500_000

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_every = np.arange(256)
_PUNCT = (((_every >= 33) & (_every <= 47)) | ((_every >= 58) & (_every <= 64)) | ((_every >= 91) & (_every <= 96)) | ((_every >= 123) & (_every <= 126))) & (_every != 39)
_PLAIN = ((_every >= 48) & (_every <= 57)) | ((_every >= 65) & (_every <= 90)) | ((_every >= 97) & (_every <= 122))
_KIND = (_PUNCT * 1 + _PLAIN * 2 + (_every == 10) * 4 + (_every == 32) * 8).astype(np.uint8)
_WHITE = np.isin(_every, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
#: White space beyond ASCII, as UTF-8.
_rare = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Table:
    """Arrays of ids by 64-bit key, in open-addressed numpy arrays."""

    def __init__(self, bits: int = 22):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.off, self.ids = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> U(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key (not 0), or -1."""
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.entry[slot], -1)
        wait = np.flatnonzero((seen != key) & (seen != 0))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[wait]]
            hit = seen == key[wait]
            out[wait[hit]] = self.entry[slot[wait[hit]]]
            wait = wait[~hit & (seen != 0)]
        return out

    def add(self, key: np.ndarray, values: list[np.ndarray]) -> None:
        """New distinct keys with their ids."""
        n, size = len(key), np.array([len(v) for v in values], np.int64)
        first = int(self.off[self.n])
        while self.n + n + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while first + size.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first : first + size.sum()] = np.concatenate(values) if n else []
        self.off[self.n + 1 : self.n + n + 1] = first + np.cumsum(size)
        slot, wait = self._slot(key), np.arange(n)
        while len(wait):
            free = self.keys[slot[wait]] == 0
            self.keys[slot[wait[free]]] = key[wait[free]]  # of several for one slot, the last stays
            mine = self.keys[slot[wait]] == key[wait]
            self.entry[slot[wait[mine]]] = self.n + wait[mine]
            wait = wait[~mine]
            slot[wait] = (slot[wait] + 1) & ((1 << self.bits) - 1)
        self.n += n


class Encoder:
    """Encodes with the tokenizer of a file, without adding special tokens; null is an empty text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.split = regex.compile(_PATTERN).findall
        self.table = Table()

    def _piece(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def unit(self, text: str) -> np.ndarray:
        """Ids of a text, by the pattern and the model; as a whole where a special token stands in it."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return np.array(self._piece(text), np.uint32)
        return np.array([k for p in self.split(text) for k in self._piece(p)], np.uint32)

    def _cuts(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Where units start, and which texts can't be cut so (their units are whole texts)."""
        data, n = block.data, len(block.data)
        kind = _KIND[data]
        start = kind >= 4
        pair = kind[1:] | kind[:-1] if n else kind
        start[1:] |= (pair == 3) | (kind[:-1] == 4)
        start[block.off[:-1][np.diff(block.off) > 0]] = True
        whole = np.zeros(block.n, bool)
        white = _WHITE[data]
        bad = np.flatnonzero(white[1:] & white[:-1]) + 1 if n else np.zeros(0, np.int64)
        if len(bad):
            of = np.searchsorted(block.off, bad, side="right") - 1
            whole[of[block.off[of] < bad]] = True  # both bytes in one text
        ends = block.off[1:][np.diff(block.off) > 0] - 1
        whole[np.flatnonzero(np.diff(block.off) > 0)[data[ends] == 32]] = True
        raw = data.tobytes()
        marks = [m.start() for m in _rare.finditer(raw)]
        for s in self.special:
            marks += [m.start() for m in re.finditer(re.escape(s.encode()), raw)]
        whole[np.searchsorted(block.off, np.array(marks, np.int64), side="right") - 1] = True
        if whole.any():
            inside = np.repeat(whole, np.diff(block.off))
            start[inside] = False
            start[block.off[:-1][whole & (np.diff(block.off) > 0)]] = True
        return np.flatnonzero(start), whole

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's."""
        first, whole = self._cuts(block)
        last = np.append(first[1:], len(block.data)) if len(first) else first
        key = spans_hash(block.data, first, last) | U(1)
        if self.table.n > UNITS:
            self.table.clear()
        entry = self.table.find(key)
        if len(new := np.flatnonzero(entry < 0)):
            _, once = np.unique(key[new], return_index=True)
            once = new[once]
            raw = block.data.tobytes()
            self.table.add(key[once], [self.unit(raw[a:b].decode("utf-8", "replace")) for a, b in zip(first[once].tolist(), last[once].tolist(), strict=True)])
            entry[new] = self.table.find(key[new])
        at = self.table.off[entry].astype(np.int64)
        n = self.table.off[entry + 1] - at
        off = np.concatenate([[0], np.cumsum(n)])
        ids = self.table.ids[np.repeat(at - off[:-1], n) + np.arange(off[-1])]
        return ids, off[np.searchsorted(first, block.off)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; workers keep it over tasks."""
    return Encoder(path)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return encoder(path).encode(Block(texts))
