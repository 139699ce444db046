"""As-of joins as window expressions over the time-ordered union of both sides.

``L`` precedes ``R``: each right row belongs to the last left row at or before it (left first on equal times). A right row
matches if it's less than ``within`` ns after its left row, or always if that is 0. Rows carry ``producer`` and the order
columns (log_time, side, branch, sequence), which have to be unique.

``rows`` gives the narrow result: matched left rows once, and matched right rows. Whether a left row is matched shows in the next
row alone, so one sort answers everything and nothing is joined. ``pairs`` gives a row for each match.

One producer is one window partition of ``rows``. ``bucketed_rows`` cuts time into buckets, hands each bucket the last left row and the
neighbours from summaries of the others, and so spreads one large producer over many tasks with the same result. ``spread_rows``, which
queries use, measures the input and takes the first as long as no producer is too large for a task, else the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("log_time", "side", "branch", "sequence")
#: Inputs of at most so many bytes are sorted as they are: no task can get more. Rows that a window partition should have at most.
SMALL_BYTES, PARTITION_ROWS = 256 << 20, 4_000_000


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)


def _within(right_time, left_time, within: int):
    return (right_time - left_time < F.lit(within)) if within else F.lit(True)


def _keep(side, time, last_left, before_side, next_side, next_time, immediate: bool, within: int):
    matched_left = (side == 0) & (next_side == 1) & _within(next_time, time, within)
    matched_right = (side == 1) & last_left.isNotNull() & _within(time, last_left, within)
    if immediate:
        matched_right = matched_right & (before_side == 0)
    return F.coalesce(matched_left | matched_right, F.lit(False))


def rows(left: DataFrame, right: DataFrame, immediate: bool = False, within: int = 0, keys: tuple[str, ...] = ("producer",)) -> DataFrame:
    """Matched left and right rows, without duplicates of left rows; unmatched rows of either side are left out."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    u = _both(left, right).withColumns(
        {
            "__left": F.last(F.when(F.col("side") == 0, F.col("log_time")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__before": F.lag("side").over(w),
            "__next": F.lead("side").over(w),
            "__time": F.lead("log_time").over(w),
        }
    )
    keep = _keep(F.col("side"), F.col("log_time"), F.col("__left"), F.col("__before"), F.col("__next"), F.col("__time"), immediate, within)
    return u.where(keep).drop("__left", "__before", "__next", "__time", "side")


def bucketed_rows(left: DataFrame, right: DataFrame, bucket_ns: int, immediate: bool = False, within: int = 0, keys: tuple[str, ...] = ("producer",)) -> DataFrame:
    """The result of ``rows``, with windows over (keys, bucket of ``bucket_ns``)."""
    u = _both(left, right)
    names = [c for c in u.columns if c != "side"]
    u = u.withColumn("__bucket", F.expr(f"log_time div {int(bucket_ns)}L"))
    order = F.struct(*ORDER)
    # one row for each bucket, combined map-side; the windows below are over these alone
    summary = u.groupBy(*keys, "__bucket").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max(F.when(F.col("side") == 0, F.col("log_time"))).alias("left"))
    by_key = Window.partitionBy(*keys).orderBy("__bucket")
    carried = summary.select(
        *keys,
        "__bucket",
        F.last("left", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("__c_left"),
        F.lag("last").over(by_key)["side"].alias("__c_before"),
        F.lead("first").over(by_key).alias("__c_next"),
    )
    w = Window.partitionBy(*keys, "__bucket").orderBy(*ORDER)
    u = u.join(carried, [*keys, "__bucket"])
    helpers = {
        "__left": F.coalesce(F.last(F.when(F.col("side") == 0, F.col("log_time")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__c_left")),
        "__before": F.coalesce(F.lag("side").over(w), F.col("__c_before")),
        "__next": F.coalesce(F.lead("side").over(w), F.col("__c_next.side")),
        "__time": F.coalesce(F.lead("log_time").over(w), F.col("__c_next.log_time")),
    }
    u = u.withColumns(helpers)
    keep = _keep(F.col("side"), F.col("log_time"), F.col("__left"), F.col("__before"), F.col("__next"), F.col("__time"), immediate, within)
    return u.where(keep).select(*names)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer knows about the size of a plan's result, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_width(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("producer",)) -> int:
    """The width of buckets in ns at which the densest one of the largest producer has about ``PARTITION_ROWS`` rows; 0 if no producer
    has more than that. Reads keys and times only, and counts them map-side."""
    if estimated_bytes(left) + estimated_bytes(right) <= SMALL_BYTES:
        return 0
    slim = left.select(*keys, "log_time").unionByName(right.select(*keys, "log_time"))
    top = slim.groupBy(*keys).agg(F.count("*").alias("n"), F.min("log_time").alias("low"), F.max("log_time").alias("high")).agg(F.max("n").alias("n"), F.max(F.when(F.col("n") > PARTITION_ROWS, F.col("high") - F.col("low"))).alias("span")).first()
    if not top["n"] or top["n"] <= PARTITION_ROWS:
        return 0
    fine = max(1, top["span"] // 4096)
    densest = slim.groupBy(*keys, F.expr(f"log_time div {fine}L").alias("bin")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return fine * max(1, PARTITION_ROWS // densest)


def spread_rows(left: DataFrame, right: DataFrame, immediate: bool = False, within: int = 0, keys: tuple[str, ...] = ("producer",)) -> DataFrame:
    """The result of ``rows``, in buckets where a producer is too large for one task."""
    width = bucket_width(left, right, keys)
    return bucketed_rows(left, right, width, immediate, within, keys) if width else rows(left, right, immediate, within, keys)


def pairs(left: DataFrame, right: DataFrame, immediate: bool = False, within: int = 0, keys: tuple[str, ...] = ("producer",), bucket_ns: int | None = None) -> DataFrame:
    """A row for each match: the key columns, ``left`` (struct of the left row) and ``right``. Equal schemas aren't needed.

    bucket_ns: the width of time buckets, 0 for none; None: measured, as in ``spread_rows``. A bucket gets the last left row before it."""
    l = left.select(*keys, "log_time", F.lit(0).alias("side"), "branch", "sequence", F.struct(*(c for c in left.columns if c not in keys)).alias("left"))
    r = right.select(*keys, "log_time", F.lit(1).alias("side"), "branch", "sequence", F.struct(*(c for c in right.columns if c not in keys)).alias("right"))
    u = l.unionByName(r, allowMissingColumns=True)
    width = bucket_width(left, right, keys) if bucket_ns is None else bucket_ns
    by, c_left, c_before = keys, F.lit(None), F.lit(None)
    if width:
        by, order = (*keys, "__bucket"), F.struct(*ORDER)
        u = u.withColumn("__bucket", F.expr(f"log_time div {int(width)}L"))
        # one row for each bucket, combined map-side, as in bucketed_rows
        summary = u.groupBy(*by).agg(F.max(order).alias("last"), F.max_by("left", F.when(F.col("side") == 0, order)).alias("l"))
        over = Window.partitionBy(*keys).orderBy("__bucket")
        u = u.join(summary.select(*by, F.last("l", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__c_left"), F.lag("last").over(over)["side"].alias("__c_before")), list(by))
        c_left, c_before = F.col("__c_left"), F.col("__c_before")
    w = Window.partitionBy(*by).orderBy(*ORDER)
    u = u.withColumns({"__before": F.coalesce(F.lag("side").over(w), c_before), "left": F.coalesce(F.last("left", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), c_left)})
    out = u.where((F.col("side") == 1) & F.col("left").isNotNull() & _within(F.col("log_time"), F.col("left.log_time"), within))
    if immediate:
        out = out.where(F.col("__before") == 0)
    return out.select(*keys, "left", "right")


def neighbor_pairs(left: DataFrame, right: DataFrame, within: int, keys: tuple[str, ...] = ("producer",), bucket_ns: int | None = None) -> DataFrame:
    """An extension: pairs in both directions. For each row of either side, the last row of the other side at or before it,
    less than ``within`` ns away; ``left_first`` says which of the two came first. Equal times give a pair of either kind."""
    first = pairs(left, right, within=within, keys=keys, bucket_ns=bucket_ns).withColumn("left_first", F.lit(True))
    other = pairs(right, left, within=within, keys=keys, bucket_ns=bucket_ns).select(*keys, F.col("right").alias("left"), F.col("left").alias("right"), F.lit(False).alias("left_first"))
    return first.unionByName(other)
