"""Samples to learn from are bounded, whatever repeats; what is learned doesn't depend on a repeated id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlog.llm import langid, quality, sample, store, toxicity


def hot(spark, n=3000):
    """A third of all rows has one id: copies of one text and others."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 6 == 0, "the same words again and again").otherwise(F.concat(F.lit("the words of number "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit(" idiot")).otherwise(F.lit(" fine")))).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
    )
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("toxic"), (F.col("id") % 2).cast("int").alias("quality"))
    return rows, labels


def test_choice_is_bounded_and_the_same_on_each_run(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("group"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).cast("long").alias("place"), F.lit(10).cast("long").alias("cost"))
    got = sample.choose(rows, 100)
    count = {g: sum(x == g for x, _ in got) for g in "ab"}
    assert all(90 <= n <= 100 for n in count.values()) and len(set(got)) == len(got)
    assert sorted(sample.choose(rows.repartition(7), 100)) == sorted(got)
    few = sample.choose(rows, 100, room=2 * 305)
    assert {g: sum(x == g for x, _ in few) for g in "ab"} == {"a": 30, "b": 30}
    assert sample.choose(rows.limit(0), 100) == []
    assert len(sample.choose(rows, 10**6)) == 3002  # the place 7 in either group


def test_a_hot_id_brings_no_more_rows(spark, monkeypatch):
    docs, labels = hot(spark)
    seen = {}
    for module in (langid, toxicity, quality):
        def train(*args, name=module.__name__, original=module.train, **kw):
            seen[name.rpartition(".")[2]] = args
            return original(*args, **kw)

        monkeypatch.setattr(module, "train", train)
    langid.learn(docs, F.lit(True), rows_each=50)
    toxicity.learn(docs, labels, F.lit(True), positives=40, unlabelled=60)
    quality.learn(docs, labels, docs_each=30)
    assert len(seen["langid"][0]) <= 100 and set(seen["langid"][1]) == {"en", "de"}
    assert sum(seen["toxicity"][3]) <= 40 and sum(seen["toxicity"][4]) <= 60
    assert len(seen["quality"][0]) <= 60


def test_scale_needs_no_negatives():
    gen = np.random.default_rng(1)
    pos, neg = gen.normal(2, 1, 4000), gen.normal(-2, 1, 20000)
    unl = np.concatenate([neg, gen.normal(2, 1, 5000)])
    at, values = toxicity.scale(pos, unl, 0.2)
    assert (np.diff(at) > 0).all() and (np.diff(values) >= 0).all() and 0 <= values[0] and values[-1] <= 1
    for m in (-2.0, 0.0, 1.0, 3.0):  # the true chance of two normal densities
        want = 0.2 * np.exp(-((m - 2) ** 2) / 2) / (0.2 * np.exp(-((m - 2) ** 2) / 2) + 0.8 * np.exp(-((m + 2) ** 2) / 2))
        assert abs(np.interp(m, at, values) - want) < 0.1


def test_long_texts_are_decoded_like_short_ones():
    gen = np.random.default_rng(2)
    off = np.concatenate([[0], np.cumsum([3, 0, 700, 1, 260, 256, 257, 5])])
    x = gen.normal(0, 1, (off[-1], len(quality.FEATURES)))
    model = quality.LineModel(gen.normal(0, 1, (len(quality.FEATURES), 2)), gen.normal(0, 2, (2, 2)), 0.5)
    assert (model.viterbi(x, off) == model._together(x @ model.w, off)).all()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, master, **conf):
            self.sparkContext, self.conf = type("C", (), {"master": master}), type("D", (dict,), {"set": dict.__setitem__})(conf)

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(Session(master))
        assert store.shared_dir(Session(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y/riverlog-llm"
    assert store.shared_dir(Session("local[4]")).startswith("file:///")
