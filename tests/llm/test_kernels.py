"""The vectorised kernels against plain Python."""

import itertools
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from riverlog.llm import brown, decontaminate, encode, packing, quality, simhash, tokenfiles, wordpiece
from riverlog.llm.textbytes import ALNUM, NOT_SPACE, SAME, Block, U, run_sums, word_hash, xxh64

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(seed, pool, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, most))) for _ in range(n)] + [None, "", " \n", "x"]


def test_words_and_hashes():
    ts = texts(1, "aBé \n\txyz,.", 200, 150)
    words = Block.of(ts).words(NOT_SPACE)
    want = [(t or "").encode().lower().split() for t in ts]
    got = [[bytes(words.data[a:b]) for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.off, words.off[1:])]
    assert got == want
    assert [word_hash(w) for x in want for w in x] == [int(h) for h in words.hash]


def test_xxh64_is_the_published_hash():
    rng = random.Random(2)
    data = np.frombuffer(rng.randbytes(3000), np.uint8)
    start = np.array([rng.randint(0, 2800) for _ in range(800)])
    size = np.array([min(3000 - s, rng.randint(0, 150)) for s in start])
    assert [int(h) for h in xxh64(data, start, size, 42)] == [xxhash.xxh64_intdigest(bytes(data[s : s + n]), 42) for s, n in zip(start, size)]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(5)
    ts = [" ".join(rng.choice(["a", "bb", "Ccé", "e" * 40]) for _ in range(rng.choice([0, 1, 2, 3, 4, 300, 800]))) for _ in range(40)] + [None, "", " \n"]
    assert [int(x) for x in simhash.fingerprints(Block.of(ts))] == [fingerprint(t) for t in ts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flip = lambda x: x ^ (U(1) << rng.integers(0, 64, 40, dtype=np.uint64))
    v = np.concatenate([v, flip(v), flip(v), flip(flip(v)), flip(flip(v)), flip(flip(flip(v)))])
    end = np.full(len(v), len(v))
    end[:100] = 100
    got = set(zip(*(x.tolist() for x in simhash.near_pairs(v, end, radius))))
    assert got == {(a, b) for a in range(len(v)) for b in range(a + 1, int(end[a])) if (int(v[a]) ^ int(v[b])).bit_count() <= radius}


def test_encoder_equals_the_library():
    e = encode.Encoder(PATH)
    pool = ["a", "B", " ", "  ", "\n", "é", "1", "23", "'s", "'", ".", "!!", "<|endoftext|>", "ﬁ", "漢", "\t", " \n", " ", "　", "\x1c", "\x85", "😀", "\r\n", "​", "²", "—", "|", "<|"]
    for some in (pool, [p for p in pool if p.strip() and p != "<|endoftext|>"] + [" "] * 6):
        ts = texts(3, some, 3000, 30)
        ids, off = e.encode(Block.of(ts))
        for t, a, b in zip(ts, off, off[1:]):
            assert ids[a:b].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(encode, "UNITS", 50)
    e = encode.Encoder(PATH)
    for seed in range(5):
        ts = texts(seed, "abc def.", 50, 40)
        ids, off = e.encode(Block.of(ts))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in ts]


def test_packing_plans_leave_no_padding():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([8, 16, 64, 1000, 1024])
        histogram = {rng.randint(0, size - 1): rng.randint(0, rng.choice([1, 5, 200])) for _ in range(rng.randint(0, 30))}
        plan, seen = packing.Plan(histogram, size), {}
        for length, n in histogram.items():
            for rank in range(n if length else 0):
                places = plan.places(length, rank)
                assert sum(m for _, _, m in places) == length
                for pack, offset, m in places:
                    assert pack < plan.packs
                    seen.setdefault(pack, []).append((offset, m))
        for spans in seen.values():
            at = 0
            for offset, m in sorted(spans):
                assert offset == at
                at += m
            assert at == size or at & (at - 1) == 0 and at < size


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1500):
        a = (rng.integers(0, 50, n) * rng.integers(0, 1000, n)).astype(np.uint16)
        w = tokenfiles.WaveletMatrix.of(a, 16)
        assert (w.decode() == a).all() and (w.access(np.arange(n)) == a).all()
        for c in {0, 7, 70000, *a[:10].tolist()}:
            at = np.flatnonzero(a == c)
            assert w.rank(c, np.arange(n + 1)).tolist() == [0, *np.cumsum(a == c)]
            assert [w.select(c, k) for k in range(len(at) + 1)] == [*at.tolist(), -1]


def test_token_file_round_trip(monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfiles, "BLOCK", 1000)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (1, 5, 900, 2500, 1, 3000)]
    with open(tmp_path / "x", "wb") as f:
        out = tokenfiles.Writer(f, 16)
        out.add([0, 1, None], np.array([len(d) for d in docs[:3]]), np.concatenate(docs[:3]))
        out.add([3, 4, 4], np.array([len(d) for d in docs[3:]]), np.concatenate(docs[3:]))
        assert out.close() == sum(map(len, docs))
    shard, every = tokenfiles.open_shard(f"file://{tmp_path}/x"), np.concatenate(docs)
    assert [i for i, _ in shard.documents()] == [0, 1, None, 3, 4, 4]
    assert all((a == b).all() for (_, a), b in zip(shard.documents(), docs))
    c = int(every[4000])
    assert (shard.tokens(500, 5000) == every[500:5000]).all()
    assert shard.count(c, 100, len(every)) == (every[100:] == c).sum()
    assert shard.locate(c, 0) == np.flatnonzero(every == c)[0] and shard.locate(c, 10**6) == -1
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-1])
    with pytest.raises(ValueError):
        tokenfiles.open_shard(f"file://{tmp_path}/y")


def bench_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def segment(ts):
    words = Block.of(ts).words(ALNUM)
    terms, ends, pos = decontaminate.postings(words.hash)
    return decontaminate.Segment(words.count.astype("<u4").tobytes(), terms.tobytes(), ends.astype("<u4").tobytes(), np.diff(pos, prepend=np.uint32(0)).tobytes())


def test_blocks_of_the_index_are_hashed_in_bounded_memory():
    ts = [*texts(4, ["ab ", "Cd", "é", " ", "3."], 30_000, 120), "x" * 700_000, None]
    batch = pa.RecordBatch.from_arrays([pa.array(ts, pa.string())], ["text"])
    want = Block.of(ts).words(ALNUM)
    want.hash  # noqa: B018
    tracemalloc.start()
    count, hashes = decontaminate.block_words(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count.tolist() == want.count.tolist() and (hashes == want.hash).all()
    assert sum(len((t or "").encode()) for t in ts) > 3_000_000 and peak < 60e6
    empty = decontaminate.block_words(batch.slice(0, 0))
    assert [len(x) for x in empty] == [0, 0]


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_workers_give_freed_memory_back():
    code = """
import re, sys
import numpy as np
from riverlog.llm.store import releasing

def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

def run(batches):
    for b in batches:
        many = [np.ones(12_000) for _ in range(1500)]  # 96 kB each, 144 MB; the last of all stays, so the heap's end isn't free
        kept.append(np.ones(12_000))
        yield b
        del many

kept = []
at = mb()
assert list((releasing(run) if sys.argv[1] == "releasing" else run)(iter([1, 2]))) == [1, 2]
print(mb() - at)
"""
    plain, released = (int(subprocess.run([sys.executable, "-c", code, how], check=True, capture_output=True, text=True).stdout.split()[-1]) for how in ("plain", "releasing"))
    assert plain > 100 and released < 20


def test_phrases_and_proximity():
    rng = random.Random(4)
    pool = ["a", "b", "C", "dé", "e-f", "9"]
    docs = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 30, 80]))) for _ in range(80)] + [None, ""]
    items = [(str(i), rng.choice([" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 4, 5]))), " ".join(bench_words(rng.choice(docs))[:6])])) for i in range(40)] + [("7", "a b a b")]
    s = segment(docs)
    for window in (3, 4):
        hit, found = decontaminate.Queries(items, window).matched(s)
        n_hit, windows = run_sums(hit, s.off), {}
        for i, t in items:
            x = bench_words(t)
            for k in range(len(x) - min(len(x), window) + 1 if x else 0):
                windows.setdefault(tuple(x[k : k + min(len(x), window)]), set()).add(i)
        for d, t in enumerate(docs):
            x, mark, names = bench_words(t), set(), set()
            for size in range(1, window + 1):
                for k in range(len(x) - size + 1):
                    if got := windows.get(tuple(x[k : k + size])):
                        mark |= set(range(k, k + size))
                        names |= got
            assert (len(mark), sorted(names)) == (n_hit[d], found[d])
    queries = [sorted(set(bench_words(t)[:3])) for _, t in items if bench_words(t)]
    terms = np.zeros((len(queries), 3), np.uint64)
    for k, q in enumerate(queries):
        terms[k, : len(q)] = [word_hash(x.encode()) for x in q]
    got = set(zip(*(x.tolist() for x in s.near(terms, np.array([len(q) for q in queries]), 5))))
    want = {(i, int(s.off[d]) + k) for d, t in enumerate(docs) for k in range(len(bench_words(t))) for i, q in enumerate(queries) if set(q) <= set(bench_words(t)[k : k + 5])}
    assert got == want


def quality_counts(t):
    t = t or ""
    w, seen, dup = re.findall("[^\x20\x09-\x0d]+", t), set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    c, mark = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            mark |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(mark)


def test_quality_counts():
    ts = texts(2, ["a ", "é ", "b\n", "#", "\n", "| ", "ab cd ef gh ij\n"], 150, 150)
    lines = quality.Lines(Block.of(ts))
    assert list(zip(*(getattr(lines, c).tolist() for c in quality.COUNTS))) == [quality_counts(t) for t in ts]


def test_crf_against_all_paths():
    lines = quality.Lines(Block.of(texts(7, ["a b\n", "A# b\n", "c. \n"], 40, 8)))
    model = quality.LineModel(np.random.default_rng(0).normal(size=(12, 2)), np.random.default_rng(1).normal(size=(2, 2)), 0.5)
    state, (p, _, _), emit = model.viterbi(lines.x, lines.off), model.posterior(lines.x, lines.off), lines.x @ model.w
    for a, b in zip(lines.off, lines.off[1:]):
        if a == b:
            continue
        value = lambda s: sum(emit[a + i, k] for i, k in enumerate(s)) + sum(model.trans[i, j] for i, j in zip(s, s[1:]))
        paths = list(itertools.product((0, 1), repeat=int(b - a)))
        assert abs(value(max(paths, key=value)) - value(tuple(state[a:b]))) < 1e-9
        w = np.exp([value(s) for s in paths])
        assert np.allclose([[sum(x for x, s in zip(w, paths) if s[i] == k) / w.sum() for k in (0, 1)] for i in range(b - a)], p[a:b])


def greedy(word, vocabulary):
    word, n = b" " + word, 0
    while word:
        k = max((k for k in range(1, len(word) + 1) if word[:k] in vocabulary), default=0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(3)
    small = [b"a", b"abcd", b"b", b"bc", b" ", b" a", b"cdd"]
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    x = Block.of([w.decode() for w in words]).words(NOT_SPACE, SAME)
    assert wordpiece.Automaton(small).counts(x.data, x.start, x.end).tolist() == [greedy(w, set(small)) for w in words]
    vocabulary = wordpiece.byte_level_vocabulary(PATH)
    ts = texts(9, "abcdefghij é漢 \n.", 60, 120) + ["a" * 3000]
    n, tokens = wordpiece.text_counts(wordpiece.Automaton(vocabulary), Block.of(ts))
    known = set(vocabulary)
    assert tokens.tolist() == [sum(greedy(w, known) for w in (t or "").encode().split()) for t in ts]
    assert n.tolist() == [len((t or "").encode().split()) for t in ts]


def likelihood(bigrams, cls):
    one = np.eye(int(cls.max()) + 1)[cls]
    g, h = one.T @ bigrams @ one, lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return h(g) - h(g.sum(0)) - h(g.sum(1))


def test_exchange_never_lowers_the_likelihood_and_finds_planted_classes():
    rng = np.random.default_rng(0)
    planted = np.array([0, 1, 2] * 10)
    bigrams = np.zeros((33, 33))
    for a in range(30):
        bigrams[a, np.flatnonzero(planted == (planted[a] + 1) % 3)] = rng.integers(5, 30, 10)
        bigrams[a, [a, 30, 32]], bigrams[[30, 31], a] = rng.integers(0, 3, 3), rng.integers(0, 3, 2)
    start = np.append(rng.permutation(np.arange(30) % 3), [3, 4, 5])
    bigrams = bigrams[np.ix_(np.append(rng.permutation(30), [30, 31, 32]), np.arange(33))]
    pair = np.nonzero(bigrams)
    cls = brown.exchange(*pair, bigrams[pair], 33, 3, sweeps=20)
    assert (cls[30:] == [3, 4, 5]).all() and set(cls[:30]) <= {0, 1, 2}
    assert likelihood(bigrams, cls) >= max(likelihood(bigrams, start), likelihood(bigrams, np.append(np.arange(30) % 3, [3, 4, 5])))
    # no single move is better
    for w in range(30):
        for c in range(3):
            moved = cls.copy()
            moved[w] = c
            assert likelihood(bigrams, moved) <= likelihood(bigrams, cls) + 1e-5


def test_bigrams_in_blocks_are_the_same_as_in_one():
    rng = np.random.default_rng(4)
    n, k = 43, 5
    bigrams = rng.integers(0, 4, (n, n)) * rng.integers(0, 2, (n, n))
    bigrams[7], bigrams[:, 7] = 0, 0  # a unit without neighbours
    bigrams[3, 3], bigrams[n - 3, n - 3] = 2, 2**40
    pair = np.nonzero(bigrams)
    cls = brown.exchange(*pair, bigrams[pair], n, k)
    one = np.eye(k + 3)[cls]
    for most in (1, 50, 10**6):
        blocks = brown.Bigrams.of(*pair, bigrams[pair], n, most)
        after, before = np.zeros((n, n)), np.zeros((n, n))
        for first, own, *sides in blocks.sides():
            for j, x in enumerate(own):
                after[first + j, first + j] = before[first + j, first + j] = x
                for (off, to, c), into in zip(sides, (after[first + j], before[:, first + j]), strict=True):
                    into[to[off[j] : off[j + 1]]] += c[off[j] : off[j + 1]]
        assert (after == bigrams).all() and (before == bigrams).all()
        assert (brown.exchanged(blocks, k) == cls).all() and (blocks.by_class(cls, k + 3) == one.T @ bigrams @ one).all()


def test_packed_dictionaries():
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (brown._loosed_hashes(brown._pressed_hashes(h)) == h).all() and len(brown._loosed_hashes(brown._pressed_hashes(h[:0]))) == 0
    n = np.array([0, 1, 255, 256, 2**32 - 1])
    assert (brown._loosed(brown._pressed(n)) == n).all() and len(brown._loosed(brown._pressed(n[:0]))) == 0
