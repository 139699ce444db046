"""Each operator on small tables with nulls, empty and very long texts, ties, repeated rows, no rows, and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riverlog.llm import brown, decontaminate, graph, joins, langid, packing, quality, queries, simhash, store, tokenfiles, toxicity, urlfilter, wordpiece
from riverlog.llm.textbytes import word_hash

from .test_kernels import PATH, bench_words, fingerprint, greedy, quality_counts

rng = random.Random(12)
WORDS = {"en": "the and that thing with from river stone".split(), "de": "der und schule nicht ächtung zeit straße".split()}


def sentence(lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


BASE = [(k, sentence(lang, rng.randint(3, 60)) + ".\nEnd " + str(k), lang) for k, lang in enumerate(["en", "de"] * 20)]
ODD = [(None, "no id here and that", "en"), (100, None, "de"), (101, "", None), (102, " \n\t", "en"), (103, "12 34 !!", "en"), (104, sentence("en", 20_000), "en"), (0, BASE[0][1], "en"), (0, BASE[0][1], "en"), (105, BASE[1][1], "de"), (106, BASE[1][1], "de"), (107, "漢字 😀 don't  stop\r\n", "en")]
ROWS = BASE + ODD
#: Columns that operators use themselves, and one that differs from text in case alone.
EXTRA = ["score", "id", "fingerprint", "component_id", "n", "rank", "part", "__text", "TEXT", "chunk", "held_out", "key", "a"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return plain.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(EXTRA)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 3 and 1, int(k % 5 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


def sets(rows):
    return Counter(map(tuple, rows))


def test_language_id(spark, docs, empty):
    learn_if = F.col("doc_id") % 5 != 0
    model = langid.learn(docs, learn_if)
    assert model.langs == ["de", "en"]
    out = langid.identify(docs, model, ["doc_id"]).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by_id[100] == by_id[101] == by_id[102] == by_id[103] == "und"
    held = [(i, lang) for i, t, lang in BASE if i % 5 == 0]
    assert np.mean([by_id[i] == lang for i, lang in held]) >= 0.9
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    none = langid.learn(empty, learn_if)
    assert {r["lang_pred"] for r in langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}


def test_toxicity(spark, empty, labels):
    bad = ["scum", "moron", "trash"]
    rows = [(k, sentence("en", 30) + (f" {rng.choice(bad)} {sentence('en', 5)}" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "moron"), (9000, None), (9001, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, known, F.col("doc_id") % 7 != 2)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(out) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    held = [(out[i]["predicted"], y) for i, _, y in rows if i % 7 == 2]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert out[9000]["score"] == out[9001]["score"]
    assert toxicity.score(empty, toxicity.learn(empty, labels, F.lit(True)), ["doc_id"]).count() == 0


def brute_components(rows):
    fp = [fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return Counter((i, f"{f:016x}", min(least[find(k)], default=None)) for k, ((i, *_), f) in enumerate(zip(rows, fp)))


def test_simhash(spark, docs, empty):
    out = simhash.near_duplicates(docs)
    assert sets(out.select("doc_id", "fingerprint", "component_id").collect()) == brute_components(ROWS)
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.one_of_each(store.narrowed(docs, "doc_id", "text", "lang"))
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) == len({c for _, _, c in brute_components(ROWS)})
    assert 105 not in ids and 106 not in ids and 1 in ids and ids.count(0) == 1


@pytest.mark.parametrize("hot", [1024, 4])
def test_simhash_links_of_dense_groups(spark, monkeypatch, hot):
    """Values that are close together in large buckets, by comparison and by shared neighbours."""
    monkeypatch.setattr(simhash, "HOT", hot)
    gen = np.random.default_rng(3)
    values = {int(x) for x in gen.integers(-(2**62), 2**62, 30)}
    for v in list(values)[:4]:
        for _ in range(25):
            w = v
            for b in gen.integers(0, 63, gen.integers(1, 5)):
                w ^= 1 << int(b)
            values.add(w)
    values = sorted(values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in graph.connected_components(simhash.links(frame)).collect()}
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)}


def encoded(rows, end):
    t = Tokenizer.from_file(PATH)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("size", [64, 1024])
def test_packing(docs, empty, size):
    out = packing.pack(docs, PATH, size=size).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert Counter(x for _, ids in encoded(ROWS, 0) for x in ids) == Counter(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in out]).tolist())
    want = {(i, len(ids)): Counter() for i, ids in encoded(ROWS, 0)}
    for (i, ids) in encoded(ROWS, 0):
        want[i, len(ids)].update(range(len(ids)))
    for key, parts in pieces.items():
        assert Counter(r["start"] + k for r in parts for k in range(r["length"])) == want[key]
    texts = {i: ids for i, ids in encoded(ROWS, 0)}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in out if r["doc_tokens"] == len(texts[r["doc_id"]]))
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == size or at < size and at & (at - 1) == 0
    assert packing.pack(empty, PATH, size=size).count() == 0


def test_packed_sequences(docs):
    packed = packing.pack(docs, PATH, size=64)
    joined = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in joined) == sum(len(ids) for _, ids in encoded(ROWS, 0))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in joined)


def test_token_files(docs, empty):
    out = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenfiles.round_trip(docs, PATH).collect()]
    out.sort(key=lambda r: r[1])
    assert [r[0] for r in out] == sorted((i for i, *_ in ROWS), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in out] == [sum(r[2] for r in out[:k]) for k in range(len(out))]
    assert Counter((i, tuple(ids)) for i, _, _, ids in out) == Counter((i, tuple(ids)) for i, ids in encoded(ROWS, 2))
    assert tokenfiles.round_trip(empty, PATH).count() == 0


ITEMS = [(1, " ".join(BASE[0][1].split()[:12])), (2, "river"), (3, None), (None, "the"), (4, "!! --"), (5, sentence("en", 30)), (5, "漢字"), (10, "stone")]


def contaminated(rows, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        x = bench_words(t) if i is not None else []
        size = min(len(x), window)
        for k in range(len(x) - size + 1 if x else 0):
            windows[tuple(x[k : k + size])].add(str(i))
    out = []
    for i, t, *_ in rows:
        x, mark, names = bench_words(t), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(x) - size + 1):
                if got := windows.get(tuple(x[k : k + size])):
                    mark |= set(range(k, k + size))
                    names |= got
        out.append((i, len(x), len(mark), len(names), decontaminate.sha256_of(sorted(names)), bool(mark)))
    return Counter(out)


@pytest.mark.parametrize("batch", [32 << 20, 100])
def test_decontamination(spark, docs, empty, monkeypatch, batch):
    monkeypatch.setattr(decontaminate, "BATCH", batch)  # a small one takes several passes
    items = spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit("the").alias("TEXT"))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sets(decontaminate.decontaminate(docs, items).select(*columns).collect()) == contaminated(ROWS, ITEMS)
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert not decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count()


def test_many_windows_take_little_memory():
    """Half a million windows: what goes to the tasks, and what matching takes beside it."""
    import pickle
    import tracemalloc

    gen = np.random.default_rng(1)
    items = [(f"i{k}", " ".join(f"w{x}" for x in gen.integers(0, 50_000, 510))) for k in range(1000)]
    tracemalloc.start()
    asked = decontaminate.Queries(items, 10)
    built = tracemalloc.get_traced_memory()[1]
    assert len(asked.first) == 501_000 and len(pickle.dumps(asked)) < 16 << 20 and built < 300 << 20
    tracemalloc.reset_peak()
    text = " ".join([items[7][1], *(f"w{x}" for x in gen.integers(0, 50_000, 20_000)), items[900][1][:200]])
    words = decontaminate.Block.of([text]).words(decontaminate.ALNUM)
    terms, ends, pos = decontaminate.postings(words.hash)
    segment = decontaminate.Segment(words.count.astype("<u4").tobytes(), terms.tobytes(), ends.astype("<u4").tobytes(), np.diff(pos, prepend=np.uint32(0)).tobytes())
    hit, found = asked.matched(segment)
    assert found == [["i7", "i900"]] and 510 + 20 < hit.sum() < 510 + 60 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_index_answers_phrases_and_proximity(docs):
    index = decontaminate.build_index(docs)
    asked = ["river stone", "Der UND", "nothing there", ""]
    texts = [(i, bench_words(t)) for i, t, *_ in ROWS]
    terms = [(q, bench_words(a)) for q, a in enumerate(asked) if bench_words(a)]
    want = Counter((q, i, k) for q, a in terms for i, t in texts for k in range(len(t)) if t[k : k + len(a)] == a)
    assert sets(decontaminate.find(index, asked).collect()) == want
    near = Counter((q, i, k) for q, a in terms for i, t in texts if i != 104 for k in range(len(t)) if set(a) <= set(t[k : k + 4]))
    assert sets(r for r in decontaminate.find(index, asked, span=4).collect() if r["id"] != 104) == near


RULES = queries.URL_RULES
URLS = ["http://shop.example.com/en/1?x=//y", "https://WWW.Example.COM/en/2#a", "http://a.net/fr/", "ftp://b.net/es", "c.org/nothing", None, "", "http://spamfarm.org/x/1", "http://spam-farm.org/y", "https://riverstone.org/page/2", "https://river.org/page/7", "http://net/es/1", "http://com", "http://xexample.com/en/", "http://spam-farm.org/y", "http://casino.river.org?q", "://"]


def test_url_filters(spark):
    html = "<p>" + sentence("en", 200) + " farm</p>"
    plain = [(100 + k, f"http://{rng.choice(WORDS['en'])}{rng.choice(WORDS['en'])}.com/page/{k}", html) for k in range(300)]
    plain += [(400 + k, f"http://farmthing{k % 7}.net/fr/{k}", html) for k in range(60)]
    pages = spark.createDataFrame([(k, u, html if k % 3 else None) for k, u in enumerate(URLS)] + [(None, URLS[0], ""), *plain], "page_id long, url string, html string").select("*", F.lit("h").alias("host"), F.lit("u").alias("URL"))
    out = {r["page_id"]: r for r in urlfilter.judge(pages, RULES).collect()}
    assert len(out) == len(URLS) + 361
    for k, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(rule), verdict, rule) for verdict, rule in RULES if (host.lower() == rule.split("/")[0] or host.lower().endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == (host.lower(), path, max(fits)[2] if fits else None)
        assert not fits or out[k]["verdict"] == max(fits)[1]
    assert out[7]["score"] > out[9]["score"]  # 9 has words of allowed hosts and paths only
    assert out[9]["verdict"] == out[10]["verdict"] == "allow"
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


def test_segmentation(spark):
    words = spark.createDataFrame([(f"<p>{'river ' * 50}{'stone ' * 50}{'étang ' * 9}</p>",)], "html string")
    counts = urlfilter.page_words(words)
    names = spark.createDataFrame([("riverstone",), ("étangriver",), ("zzqy",), ("spamfarm",)], "name string")
    assert {r["name"]: r["words"] for r in urlfilter.segmented(names, counts).collect()} == {"riverstone": ["river", "stone"], "étangriver": ["étang", "river"], "zzqy": ["zzqy"], "spamfarm": ["spamfarm"]}


def test_page_words_start_anew_with_each_page(spark):
    """A stray < or > in a page changes nothing in the pages after it."""
    pages = ["<p>river</p>", "one < two", "<p class=wide>stone</p>", "over > <b>", "<p class=wide>delta</p>"]
    counts = {r["word"]: r["c"] for r in urlfilter.page_words(spark.createDataFrame([(x,) for x in pages], "html string").coalesce(1)).collect()}
    of = lambda w: counts.get(int(np.uint64(word_hash(w)).astype(np.int64)), 0)
    assert [of(w) for w in (b"river", b"one", b"stone", b"delta", b"over")] == [1] * 5 and [of(w) for w in (b"two", b"class", b"wide")] == [0] * 3


def test_lookup_joins_hot_and_cold_keys(spark):
    left = store.written(spark.range(3000).select(F.when(F.col("id") < 1000, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), "id"), "left")
    right = store.written(spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(1, -1)], "k long, v long")), "right")
    for how in ("left", "inner"):
        assert sets(joins.lookup(left, right, "k", share=0.01, how=how).select("k", "id", "v").collect()) == sets(left.join(right, "k", how).select("k", "id", "v").collect())


def test_lm_scores(spark, docs, empty):
    out = brown.score(docs, F.col("doc_id") % 4 != 1).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), b" "]) for i, t, *_ in ROWS]
    c = Counter(w for i, x in tokens if i is not None and i % 4 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(x), sum(c[w] > 0 for w in x), n, round(float(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)), 6)) for i, x in tokens)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] % 4 == 1 and r["doc_id"] < 40]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in out)
    assert brown.score(empty, F.lit(True)).count() == 0
    nothing = brown.score(docs, F.lit(None).cast("boolean")).collect()
    assert len(nothing) == len(ROWS) and {r["n_known"] for r in nothing} == {0} and {r["base_score"] for r in nothing} == {0.0}


@pytest.fixture(scope="module")
def class_model(spark, docs):
    """The model of all rows, with the count and class of each word as answered, and the texts' tokens."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(brown, "CORE", 2e-3)  # so that there are other words
        stored = brown.chunks(docs, F.lit(True))
        shared = spark.sparkContext.broadcast(brown.cluster(stored, 5))
        answers = brown.answered(brown.asked(stored, shared, 3), shared)
        model = brown.learned(answers, shared.value)
    words, c, cls = {}, {}, {}
    for r in stored.collect():
        words[r["chunk"]] = np.frombuffer(r["words"], "<u8").tolist()
    parts = defaultdict(list)
    for r in answers.where("chunk is not null").collect():
        parts[r["chunk"]].append((r["bucket"], brown._loosed(r["counts"]).tolist(), list(zstandard.decompress(r["classes"]))))
    for chunk, some in parts.items():
        some.sort()
        for w, n, k in zip(words[chunk], (x for p in some for x in p[1]), (x for p in some for x in p[2]), strict=True):
            assert c.setdefault(w, n) == n and cls.setdefault(w, k) == k
    texts = [(i, [word_hash(w) for w in (t or "").encode().lower().split()] + [int(brown.END)]) for i, t, *_ in ROWS]
    return model, c, cls, texts


def test_words_have_their_counts_and_likeliest_classes(class_model):
    model, c, cls, texts = class_model
    assert c == Counter(w for _, x in texts for w in x)
    core = {int(w): int(k) for w, k in zip(model.classes.units.core, model.classes.cls, strict=False)}
    core_class = core | {int(brown.END): model.classes.end}
    assert all(cls[w] == k for w, k in core.items()) and len(core) < len(c)
    fit = defaultdict(lambda: np.zeros(model.classes.other))
    for _, x in texts:
        for before, w, after in zip([None, *x], x, [*x[1:], 0]):
            if w not in core_class:
                left = model.classes.start if before is None else core_class.get(before)
                fit[w] = fit[w] + (0 if left is None else model.classes.fit[left]) + (0 if after not in core_class else model.classes.fit[128 + core_class[after]])
    for w, f in fit.items():
        assert f[cls[w]] >= f.max() - 1e-3 or not f.any()


def test_class_scores_equal_a_plain_model(spark, docs, class_model):
    model, c, cls, texts = class_model
    n, v = sum(c.values()), len(c)
    tokens, kinds, once = Counter(), Counter(), Counter()
    for w, m in c.items():
        tokens[cls[w]] += m
        kinds[cls[w]] += 1
        once[cls[w]] += m == 1
    d = sum(once.values()) / (sum(once.values()) + 2 * sum(m == 2 for m in c.values()))
    assert [tokens[k] for k in range(model.classes.k)] == model.tokens.tolist() and abs(model.discount - d) < 1e-12

    def plain(words):
        total, before = 0.0, model.classes.start
        for w in words:
            now = cls[w]
            total += np.log10(0.95 * model.trans[before, now] * (c[w] - d) / tokens[now] + 0.05 * (c[w] + 0.1) / (n + 0.1 * (v + 1)))
            before = now
        return total

    with pytest.MonkeyPatch.context() as m:
        m.setattr(brown, "CORE", 2e-3)
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 5)) for r in brown.score(docs, F.lit(True), classes=5).collect())
    want = sorted((i if i is not None else -1, round(float(plain(x)), 5)) for i, x in texts)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-4 * max(1, abs(b[1])) for a, b in zip(got, want, strict=True))


def test_class_model_sums_to_one(class_model):
    """Over all known words and what isn't known, the probabilities after any class add up to one."""
    model, c, cls, _ = class_model
    emit = np.zeros(model.unknown)
    for w, m in c.items():
        emit[cls[w]] += (m - model.discount) / model.tokens[cls[w]]
    assert np.allclose(model.trans[:, : model.unknown] @ emit + model.trans[:, model.unknown], 1)


def test_clustering_counts_every_bigram_of_core_words(spark):
    """More than four million bigrams of core words, nearly all of one count, so none of them is frequent."""
    k = 2100
    docs = spark.range(k).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(id, {k - 1}), j -> id || ' ' || j), ' ')").alias("text")).repartition(4)
    stored = brown.chunks(docs, F.lit(True))
    units = brown.Units(brown.core_words(stored))
    assert len(units.core) == k
    classes = brown.cluster(stored, 5)
    at = units.of(np.array([word_hash(str(w).encode()) for w in range(k)], np.uint64))
    plain = np.ones((k, k)) + np.diag(np.arange(k) < k - 1)
    plain[k - 1, : k - 1] = 0  # the last word ends each text
    want = np.zeros((units.n, units.n))
    want[np.ix_(at, at)] = plain
    want[units.start, at], want[at[k - 1], units.end] = 1, k
    one = np.eye(classes.k)[classes.cls]
    assert np.count_nonzero(want) > 4_000_000 and (classes.g == one.T @ want @ one).all()


def test_quality_rules(spark, docs, empty, labels):
    model = quality.learn(docs, labels)
    out = quality.judge(docs, model, ["doc_id"]).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        n, *rest = quality_counts(t)
        want[(i, n, *rest, n < 10 or 100 * rest[-1] > 20 * n)] += 1
    assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert quality.judge(empty, quality.learn(empty, labels), ["doc_id"]).count() == 0
    assert quality.learn(docs, labels.limit(0)) is quality.DEFAULT


def test_quality_learns_boilerplate(spark):
    def poor(k):
        return "\n".join(" | ".join(sentence("en", 1) for _ in range(8)) if k % 2 else " ".join(f"{w}{rng.choice(['***', '$$$'])}" for w in sentence("en", 9).split()) for _ in range(6))

    def good():
        return "\n".join(f"{' '.join(f'{w}{rng.randint(0, 99)}' for w in sentence('en', 9).split())}." for _ in range(6))

    rows = [(k, poor(k) if k % 3 == 0 else good(), int(k % 3 != 0)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    model = quality.learn(docs, spark.createDataFrame([(k, y) for k, _, y in rows if k < 100], "doc_id long, quality int"))
    out = {r["doc_id"]: r for r in quality.judge(docs, model, ["doc_id"]).collect()}
    assert all((out[k]["content_share"] >= model.share) == bool(y) for k, _, y in rows if k >= 100)


def test_token_counts(docs, empty):
    vocabulary = wordpiece.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    known = set(vocabulary)
    out = wordpiece.count_tokens(docs, vocabulary, ["doc_id"])
    short = [(i, t) for i, t, *_ in ROWS if len(t or "") < 5000]
    want = Counter((i, len((t or "").encode().split()), sum(greedy(w, known) for w in (t or "").encode().split())) for i, t in short)
    assert sets(out.where("doc_id is null or doc_id <> 104").collect()) == want
    assert wordpiece.count_tokens(empty, vocabulary, ["doc_id"]).count() == 0


def test_narrowed_takes_exact_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], ["doc_id", "text", "TEXT"])
    assert store.narrowed(df, "TEXT", "doc_id").collect()[0][0] == "b"
    with pytest.raises(ValueError):
        store.narrowed(df, "nothing")
