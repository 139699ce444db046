"""An equi-join that hot keys don't slow down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], share: float = 1e-4, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``, whose ``key`` (one column or several) is unique, by an inner or left join.

    Keys with at least ``share`` of all rows of ``left`` are at most 1 / share: their rows of ``right`` are broadcast, so those of
    ``left`` stay where they are. All other keys have less than that share each, and are joined by a shuffle. Both sides are read
    more than once, so they should be stored. A null key finds nothing.
    """
    by = [key] if isinstance(key, str) else key
    total = left.count()
    if total <= 1 / share:  # such a left side has no key that could be too frequent
        return left.join(right, by, how)
    whole = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in by))
    hot = left.where(whole).groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= F.lit(max(1.0, share * total))).select(*by)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    names = [*left.columns, *(c for c in right.columns if c not in by)]
    marked = left.join(hot, by, "left")
    fast = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(right.join(hot, by, "left_semi")), by, how)
    slow = marked.where(F.col("__hot").isNull()).drop("__hot").join(right, by, how)
    return fast.select(*names).unionByName(slow.select(*names))
