"""The registered queries over whole tables, and each stage of the pipeline against a plain version on its own input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from riverlog.llm import quality, queries, simhash, toxicity
from riverlog.llm.textbytes import Block

from ..oracle import connect, same
from .test_kernels import fingerprint, quality_counts
from .test_operators import contaminated, encoded

TABLE = {"op7_url_filters": ("pages", "page_id")}
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op8_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_quality_rules": ["doc_id", "n_words", *quality.COUNTS[1:], "base_failed", "kept"],
    "op10_token_counts": ["doc_id", "n_words", "n_tokens"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_cover_whole_tables(spark, data, name):
    table, key = TABLE.get(name, ("documents", "doc_id"))
    out = contract.queries()[name](spark, data)
    assert set(COLUMNS[name]) <= set(out.columns) and not any(f.dataType.typeName() == "void" for f in out.schema.fields)
    rows = out.collect()
    ids = {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in rows} == ids and (name == "op4_packing" or len(rows) == len(ids))
    if "held_out" in out.columns:
        fold, rest = {"op1_language_id": (5, 0), "op2_toxicity": (4, 2), "op8_lm_scoring": (10, 0)}[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == rest) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    assert same(queries.QUERIES[name](spark, data), connect(data), queries.ORACLE_SQL[name]) == ""


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, request):
    """Input and output rows of each stage, each written and read again."""
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        result = spark.read.parquet(path)
        out[name] = docs.collect(), result.collect(), docs.columns, result.columns
        docs = result
    return out


def kept(stages, name):
    before, after, columns, same_columns = stages[name]
    assert columns == same_columns == list(corpus_pipeline.COLUMNS)
    assert set(map(tuple, after)) <= set(map(tuple, before)) and len(after) == len({r["doc_id"] for r in after})
    return before, {r["doc_id"] for r in after}


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_toxic_documents_go(spark, stages):
    sf_dir = "/root/testdata/sf0.001"
    before, ids = kept(stages, "toxicity")
    model = toxicity.learn(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"), queries.fold(4) != 2)
    assert ids == {r["doc_id"] for r in before if model.scores(Block.of([r["text"]]))[0] < 0.3}


def plain_viterbi(model, x):
    """The likeliest states of one text's lines."""
    best, back = [], []
    for line in x:
        emit = line @ model.w
        if not best:
            best.append(emit)
            continue
        via = best[-1][:, None] + model.trans
        back.append(via.argmax(axis=0))
        best.append(via.max(axis=0) + emit)
    states = [int(np.argmax(best[-1]))] if best else []
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def test_poor_documents_go(spark, stages):
    sf_dir = "/root/testdata/sf0.001"
    before, ids = kept(stages, "quality_rules")
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.learn(docs, queries.table(spark, sf_dir, "labels"))
    want = set()
    for r in before:
        n, *_, repeats = quality_counts(r["text"])
        lines = quality.Lines(Block(pa.array([r["text"]], pa.string())))
        states = plain_viterbi(model, lines.x)
        content = sum(c for c, s in zip(lines.chars, states) if s == 0)
        if n >= 10 and 100 * repeats <= 20 * n and content / max(lines.chars.sum(), 1) >= model.share:
            want.add(r["doc_id"])
    assert ids == want


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(rows, linked):
    """The smallest id of each id's component."""
    ids, root = sorted(r["doc_id"] for r in rows), {}
    for i in ids:
        if i not in root:
            root[i], wait = i, [i]
            while wait:
                a = wait.pop()
                for b in ids:
                    if b not in root and linked(a, b):
                        root[b] = i
                        wait.append(b)
    return root


def test_one_of_each_group_stays(stages):
    """Texts that the fingerprints link, or that share 0.8 or more of their shingles, are one group; none of less than 0.65 is."""
    before, ids = kept(stages, "simhash_near_dedup")
    fp, sets = {r["doc_id"]: fingerprint(r["text"]) for r in before}, {r["doc_id"]: shingles(r["text"]) for r in before}

    def similar(least):
        return lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0

    narrow, wide = groups(before, similar(0.8)), groups(before, similar(0.65))
    assert set(wide.values()) <= ids <= set(narrow.values()) and len(ids) < len(before)


def test_near_groups(spark):
    """Copies with words exchanged: those that are similar enough are one group, others aren't, in buckets of any size."""
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(6)]
    texts = [(10 * k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        for j, changes in enumerate([1, 2, 4, 6, 60, 60]):
            w = t.split()
            for at in rng.sample(range(len(w)), changes):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append((10 * k + 1 + j, " ".join(w)))
    rows = [*texts, (900, None), (901, ""), (902, "one two"), (903, "one two"), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(0).alias("node"), F.lit("").alias("TEXT"))
    want = {i: i if i < 100 and i % 10 in (5, 6) else i // 10 * 10 for i, _ in texts} | {900: 900, 901: 900, 902: 902, 903: 902, None: 0}
    for chunk in (4096, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "CHUNK", chunk)
            assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == want
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_one_of_each_knows_rows_by_id_and_text(spark):
    """Rows of one id, or of none, with different texts stay; copies and repeated rows don't, whatever their other columns are."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a, 1), (None, b, 2), (None, c, 3), (5, d, 4), (5, "other " + a[::-1], 5), (5, d, 4), (5, d, 6), (7, d + " more", 7), (8, b, 8), (9, None, 9), (9, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").select("doc_id", "text", "n", F.lit(0).alias("TEXT"), F.lit("").alias("node"), F.create_map(F.lit(1), F.lit(2)).alias("h"))
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted((r[2], r[0], r[1]) for r in out.collect())
    assert [x[0] for x in got] in ([1, 3, 4, 5, 8, 9], [1, 3, 4, 5, 8, 10])
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A bucket of many chunks: eight dense groups of 40 texts, some of which are joined by one text of either only."""
    monkeypatch.setattr(simhash, "CHUNK", 48)
    r, flip = np.random.default_rng(3), np.zeros((9, 512), np.uint8)
    for k in range(1, 9):
        flip[k] = flip[k - 1]
        flip[k, r.permutation(512)[:150]] ^= 1
    bits = np.repeat(flip[:8], 40, axis=0)
    for k, x in enumerate(bits):
        x[r.permutation(512)[:3]] ^= 1
        if k % 40 == 20 or (k % 40 == 30 and k > 40):  # some of the way to the next group, to the one before
            to = flip[k // 40 + 1] if k % 40 == 20 else flip[k // 40 - 1]
            x[np.flatnonzero(x != to)[:: 3 if k % 40 == 20 else -3][:50]] ^= 1
    wide = np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)
    near = np.bitwise_count(wide[:, None] ^ wide[None]).sum(2) <= simhash.wide_radius(0.8)
    want = simhash._roots(len(wide), *np.nonzero(near))
    texts = spark.createDataFrame([(k, w.astype("<u8").tobytes(), [7]) for k, w in enumerate(wide)], "node long, wide binary, bands array<long>")
    found = np.array([(x["a"], x["b"]) for x in simhash.similar_links(texts).collect()])
    assert len(set(want.tolist())) < 8 and (simhash._roots(len(wide), found[:, 0], found[:, 1]) == want).all()


def test_links_are_those_of_the_exact_similarity(spark):
    """Pairs with a share of 0.78 to 0.82 of common shingles, of texts of any length: one group at 0.8 or more only."""
    r, rows, want = random.Random(8), [], {}
    for k in range(400):
        n = r.choice([12, 15, 16, 27, 40, 90, 300])
        w = [f"{k}w{j}" for j in range(n + 4)]
        longer = [*w, *(f"{k}x{j}" for j in range(max(1, round(n * r.uniform(0.2, 0.3)))))]
        if n >= 27 and k % 2:  # both with shingles of their own
            extra = round(n * r.uniform(0.1, 0.14))
            longer, w = [*w, *(f"{k}x{j}" for j in range(extra))], [*w, *(f"{k}y{j}" for j in range(extra))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(longer))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        share = len(a & b) / len(a | b)
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if share >= 0.8 or (fingerprint(rows[-2][1]) ^ fingerprint(rows[-1][1])).bit_count() <= 2 else 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = sum(want[2 * k] == want[2 * k + 1] for k in range(400))
    assert 80 < linked < 320
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_groups(docs).collect()} == want


@pytest.mark.parametrize("most", [1 << 20, 9000])
def test_copies_of_a_template_are_one_group(spark, monkeypatch, most):
    """All have 0.8 or more of the template, most less of each other; in one block or in many."""
    monkeypatch.setattr(simhash, "CHUNK", 30)
    monkeypatch.setattr(simhash, "SHINGLES", most)
    r = random.Random(8)
    template = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(template))]
    for k in range(1, 61):
        w = list(template)
        for at in range(6, 350, 49):
            w[at + r.randrange(40)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["component_id"] for x in simhash.near_groups(docs).collect()} == {0}


def test_wide_distances():
    values = np.random.default_rng(0).integers(0, 4, (150, 8), dtype=np.uint64)
    end = np.full(150, 150)
    end[:40] = 40
    for radius in (0, 1, 2, 3, 5, 7, 8, 100):
        want = {(i, j) for i in range(150) for j in range(i + 1, int(end[i])) if int(np.bitwise_count(values[i] ^ values[j]).sum()) <= radius}
        assert {p for i, j in simhash.near_rows(values, end, radius, most=20) for p in zip(i.tolist(), j.tolist())} == want


def test_contaminated_documents_go(spark, stages):
    before, ids = kept(stages, "benchmark_decontamination")
    items = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").collect()]
    assert ids == {i for (i, *_, dirty), _ in contaminated([(r["doc_id"], r["text"]) for r in before], items).items() if not dirty}


def test_packed_pieces(stages):
    before, after, _, columns = stages["packing"]
    assert columns == COLUMNS["op4_packing"]
    ids = dict(encoded([(r["doc_id"], r["text"]) for r in before], 0))
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in after:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces == {i: Counter(range(len(x))) for i, x in ids.items()}
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_run_is_the_stages_one_after_another(spark, stages):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    _, after, _, columns = stages["packing"]
    assert out.columns == columns
    total = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert total(out.collect()) == total(after)
    assert contract.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in contract.oracle_sql()


@pytest.mark.parametrize("n", [0, 1])
def test_stages_take_few_rows_nulls_and_more_columns(spark, n):
    docs = spark.createDataFrame([(None, None, None, None, None)] * n, "doc_id long, text string, lang string, source string, n_chars long").select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("score"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == (n if name in ("toxicity", "simhash_near_dedup", "benchmark_decontamination", "packing") else 0), name
