"""A corpus pipeline of five of the training-data operators.

Each stage takes what its predecessor kept. All but the last return the columns of documents; the last returns the pieces
of packed sequences. Rows keep null and empty texts until a stage rejects them: an empty text isn't toxic, and fails the
quality rules. An empty table stays empty, and columns besides those of documents don't matter to any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.llm import decontaminate, packing, quality, simhash, toxicity
from riverlog.llm.queries import fold, table
from riverlog.llm.store import narrowed, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic; it learns from the labelled ones among ``docs``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.score(docs, model, list(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and have enough content lines; the CRF learns from the labelled ones among ``docs``."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, list(COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    return simhash.one_of_each(narrowed(docs, *COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item. The verdict depends on the text alone, so rows are known by two hashes of it:
    an id may be null or repeated."""
    keyed = narrowed(docs, *COLUMNS).withColumn("key", F.concat_ws(":", F.xxhash64("text").cast("string"), F.xxhash64(F.lit(1), "text", F.length("text")).cast("string")))
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    dirty = written(found.where("contaminated").select("key").distinct(), "contaminated")
    return keyed.join(dirty, "key", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifiers and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
