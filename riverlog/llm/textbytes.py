"""Vectorised work on the UTF-8 bytes of many texts at once: words, 64-bit hashes, sums per text.

A ``Block`` holds the texts of one Arrow array as one byte array with offsets, as Arrow stores them; null is
an empty text. All functions look at whole texts. Hashes have 64 bits and are used as identities of words
and lines within a corpus: two different ones meet with a probability of about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

_every = np.arange(256)
#: Lower-cases A-Z only.
LOWER = np.where((_every >= 65) & (_every <= 90), _every + 32, _every).astype(np.uint8)
SAME = _every.astype(np.uint8)
#: Bytes of words, for three kinds of words.
NOT_SPACE = ~((_every == 32) | ((_every >= 9) & (_every <= 13)))
ALNUM = ((_every >= 48) & (_every <= 57)) | ((_every >= 97) & (_every <= 122)) | (_every >= 128)
ALPHA = ((_every >= 97) & (_every <= 122)) | (_every >= 128)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 21), _P if kind == "up" else _P_INV)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 8 << 20:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The final steps of a well-known 64-bit mixer: every bit in depends on every bit out."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each pair, the same wherever the bytes stand."""
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power("up", n), out=total[1:])
    h = (total[end] - total[start]) * _power("down", n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hash(word: bytes) -> int:
    """The hash that ``Block.words`` gives this word."""
    data = np.frombuffer(word, np.uint8)
    return int(spans_hash(data, np.array([0]), np.array([len(data)]))[0])


class Block:
    """Texts as bytes: ``data``, ``off`` (n + 1 offsets)."""

    def __init__(self, array: pa.Array):
        array = pc.fill_null(array.cast(pa.large_string()), "")
        self.n = len(array)
        off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        base = array.buffers()[2]
        self.data = np.frombuffer(base, np.uint8)[off[0] : off[-1]] if base is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        return cls(pa.array(texts, pa.string()))

    def edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of ``inside``; runs end with their text."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], before[0] = inside[:-1], False
        before[self.off[:-1][self.off[:-1] < n]] = False
        after[:-1], after[-1] = inside[1:], False
        after[self.off[1:][self.off[1:] > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, kind: np.ndarray, fold: np.ndarray = LOWER) -> Words:
        data = fold[self.data]
        start, end = self.edges(kind[data])
        return Words(data, start, end, np.searchsorted(start, self.off))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte, by text."""
        return run_sums(values, self.off)


class Words:
    """``data``: folded bytes; ``start``, ``end`` of words in it; ``off``: the first word of each text, and their number."""

    def __init__(self, data, start, end, off):
        self.data, self.start, self.end, self.off = data, start, end, off
        self.n = len(start)
        self._hash = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def text(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.off) - 1), self.count)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = spans_hash(self.data, self.start, self.end)
        return self._hash

    def windows(self, size: int) -> np.ndarray:
        """Indices of the first words of all windows of ``size`` words that lie in one text."""
        if self.n < size:
            return np.zeros(0, np.int64)
        text = self.text
        return np.flatnonzero(text[: self.n - size + 1] == text[size - 1 :])

    def window_hash(self, first: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each of ``first``."""
        h, total = self.hash, np.zeros(len(first), np.uint64)
        for k in range(size):
            total = mix(total * U(3) + h[first + k])
        return total


def run_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the runs values[off[k]:off[k + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def covered(first: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n items lie in any of the spans [first, first + size)."""
    change = np.bincount(first, minlength=n + 1).astype(np.int64) - np.bincount(first + size, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


_X1, _X2, _X3, _X4, _X5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:start + size] for each pair, by the published algorithm, over all spans at once."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    lanes = np.empty(len(data) + 1, "<u8")
    for k in range(8):
        part = room[k : k + (len(room) - k) // 8 * 8].view("<u8")
        target = lanes[k::8]
        target[:] = part[: len(target)]
    s, out, at = U(seed), np.empty(len(start), np.uint64), start.astype(np.int64).copy()
    left = size.astype(np.int64).copy()
    out[:] = s + _X5

    def step(acc, lane):
        return _rotl(acc + lane * _X2, 31) * _X1

    if len(long := np.flatnonzero(left >= 32)):
        acc = [np.full(len(long), x) for x in ((int(s) + int(_X1) + int(_X2)) % (1 << 64), (int(s) + int(_X2)) % (1 << 64), int(s), (int(s) - int(_X1)) % (1 << 64))]
        acc = [a.astype(np.uint64) for a in acc]
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                acc[k][live] = step(acc[k][live], lanes[at[long[live]] + 8 * k])
            at[long[live]] += 32
            left[long[live]] -= 32
            live = live[left[long[live]] >= 32]
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for k in range(4):
            h = (h ^ step(np.zeros_like(h), acc[k])) * _X1 + _X4
        out[long] = h
    out += size.astype(np.uint64)
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        if not len(live):
            break
        k = step(np.zeros(len(live), np.uint64), lanes[at[live]])
        out[live] = _rotl(out[live] ^ k, 27) * _X1 + _X4
        at[live] += 8
        left[live] -= 8
    if len(live := np.flatnonzero(left >= 4)):
        out[live] = _rotl(out[live] ^ ((lanes[at[live]] & U(0xFFFFFFFF)) * _X1), 23) * _X2 + _X3
        at[live] += 4
        left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        out[live] = _rotl(out[live] ^ ((lanes[at[live]] & U(0xFF)) * _X5), 11) * _X1
        at[live] += 1
        left[live] -= 1
    out = (out ^ (out >> U(33))) * _X2
    out = (out ^ (out >> U(29))) * _X3
    return out ^ (out >> U(32))
