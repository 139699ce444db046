"""Bounded samples of rows to learn from, exact in rows and bytes whatever ids or texts repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Bytes of features that a sample sends to the driver at most, in equal parts by group; costs are upper bounds, so it's far less as a rule.
ROOM = 192 << 20


def place(*columns):
    """Where a row stands in the order of samples: a hash of what it is, not of its id alone. Rows that are alike stand at one place."""
    return F.xxhash64(*columns)


def choose(rows: DataFrame, quota: int, room: int = ROOM) -> list[tuple[str, int]]:
    """(group, place) of the rows of a sample: of each group at most ``quota`` places, and as many as have their part of ``room``
    by ``cost`` together.

    ``rows`` (group: string, place: long, cost: long) should be narrow and stored. Rows at one place count once. The order is by a hash of
    the place, so it is the same on each run. What goes to the driver is about ``quota`` rows a group, and never over twice that.
    """
    n = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}
    if not n:
        return []
    order = F.shiftrightunsigned(F.xxhash64(F.lit(29), "place"), 33)
    share = F.create_map(*(F.lit(x) for g, k in n.items() for x in (g, min(1.0, (1.15 * quota + 50) / max(1, k)))))
    near = rows.withColumn("order", order).where(F.col("order") < share[F.col("group")] * float(1 << 31))
    near = near.groupBy("group", "place", "order").agg(F.max("cost").alias("cost")).orderBy("order", "place").limit(2 * (quota + 50) * len(n))
    out, count, used = [], dict.fromkeys(n, 0), dict.fromkeys(n, 0)
    for r in near.collect():
        g = r["group"]
        if count[g] < quota and used[g] + r["cost"] <= room / len(n):
            count[g], used[g] = count[g] + 1, used[g] + r["cost"]
            out.append((g, r["place"]))
    return out


def sampled(rows: DataFrame, chosen: list[tuple[str, int]]) -> DataFrame:
    """The rows (with a column place) at the chosen places, with their group; a place of several groups comes for each."""
    small = rows.sparkSession.createDataFrame(chosen, "group string, place long")  # bounded by the quota of each group
    return rows.join(F.broadcast(small), "place")


def stored_places(rows: DataFrame) -> DataFrame:
    return written(rows, "places")
