"""The registered queries of this subpackage: each applies an operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import brown, decontaminate, langid, packing, quality, simhash, tokenfiles, toxicity, urlfilter, wordpiece


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents with fold(5) = 0, or a null id, aren't learned from."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, fold(5) != 0)
    out = langid.identify(docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; nothing is learned from those with fold(4) = 2 or a null id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, fold(4) != 2)
    return toxicity.score(docs.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))), model, ["doc_id", "held_out"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints (3-word shingles) and components of documents (2 bits or fewer)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from wavelet-matrix files."""
    back = tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in 10-word windows of benchmark items."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


#: The production rules for URLs.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model scores of every document; those with fold(10) = 0 or a null id aren't learned from."""
    docs = table(spark, sf_dir, "documents")
    out = brown.score(docs, fold(10) != 0)
    return out.select("doc_id", F.coalesce(fold(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, rules and the CRF's verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every document, over the byte-level vocabulary."""
    vocabulary = wordpiece.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_simhash, op4_packing, op5_token_files, op6_decontamination, op7_url_filters, op8_lm_scoring, op9_quality_rules, op10_token_counts)}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, win)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM m)) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
}
