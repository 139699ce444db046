"""Trigram signatures of text: 96 bits that say which trigrams may occur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 96


def _bits(text: Column) -> Column:
    """Hashed positions of all trigrams of a text."""
    n = F.length(text)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.pmod(F.xxhash64(F.substr(text, k, F.lit(3))), F.lit(BITS)).cast("int"))


def signature(text: Column) -> Column:
    """struct(low: bits 0 to 47, high: bits 48 to 95) of one text; merge with ``merge``. Null and short texts have no bits."""
    bits = F.array_distinct(_bits(F.coalesce(text, F.lit(""))))

    def half(first: int) -> Column:
        return F.aggregate(F.filter(bits, lambda b: (b >= first) & (b < first + 48)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.expr("1L").cast("long") * F.pow(F.lit(2.0), b - first).cast("long")))

    return F.struct(half(0).alias("low"), half(48).alias("high"))


def merge(column: str) -> Column:
    """Aggregate: the signature of a group of texts."""
    return F.struct(F.bit_or(F.col(column)["low"]).alias("low"), F.bit_or(F.col(column)["high"]).alias("high"))


def may_contain(group: Column, text: Column) -> Column:
    """False only if no text of the group is or contains ``text``."""
    one = signature(text)
    return (group["low"].bitwiseAND(one["low"]) == one["low"]) & (group["high"].bitwiseAND(one["high"]) == one["high"])
