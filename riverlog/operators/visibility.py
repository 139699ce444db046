"""Which stored rows a reader sees, and de-duplication: shared by scans, statistics and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("producer", "topic", "log_time", "sequence")
#: Rows of deletes or truncations that are broadcast; more are joined by a shuffle on (producer, topic).
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def visible(rows: DataFrame, deletes: DataFrame | None = None, truncations: DataFrame | None = None, min_version: int | None = None, counts: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Rows newer than ``min_version`` and their table's last truncation, which no later delete covers.

    deletes: (producer, topic, start_ns, end_ns, version) over [start_ns, end_ns) of log time; rows of a later version survive.
    truncations: (producer, topic, version); the highest counts. counts: known sizes of both, for the choice of join.
    """
    if min_version is not None:
        rows = rows.where(F.col("version") > F.lit(min_version))
    if truncations is not None:
        last = truncations.groupBy("producer", "topic").agg(F.max("version").alias("__cut"))
        rows = rows.join(_small(last, counts[1]), ["producer", "topic"], "left").where(F.coalesce(F.col("version") > F.col("__cut"), F.lit(True))).drop("__cut")
    if deletes is not None:
        d = _small(deletes.select("producer", "topic", "start_ns", "end_ns", F.col("version").alias("__v")), counts[0]).alias("d")
        r = rows.alias("r")
        covers = (F.col("r.producer") == F.col("d.producer")) & (F.col("r.topic") == F.col("d.topic")) & (F.col("r.log_time") >= F.col("d.start_ns")) & (F.col("r.log_time") < F.col("d.end_ns")) & (F.col("d.__v") > F.col("r.version"))
        rows = r.join(d, covers, "left_anti")
    return rows


def _same(left: DataFrame, right: DataFrame, key: tuple[str, ...]):
    """Equality of keys, in which null equals null."""
    out = left[key[0]].eqNullSafe(right[key[0]])
    for c in key[1:]:
        out = out & left[c].eqNullSafe(right[c])
    return out


def deduplicated(batch: DataFrame, stored: DataFrame | None = None, key: tuple[str, ...] = KEY, unique: bool = False) -> DataFrame:
    """One row of ``batch`` for each key that ``stored`` doesn't have; of repeated keys the row with the least publish_time stays.

    Keys are compared first, in jobs that read nothing else, so that of up to ``BROADCAST_ROWS`` repeated or stored keys only the rows with these are
    shuffled, and no other payload is. unique: the caller knows that no key of the batch is repeated.
    """

    def least(rows: DataFrame) -> DataFrame:
        row = F.struct(*(F.col(c) for c in rows.columns))
        return rows.groupBy(*key).agg(F.min_by(row, F.struct("publish_time", F.xxhash64(*(F.col(c) for c in rows.columns)))).alias("__row")).select("__row.*")

    if not unique:
        again = batch.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        n = again.count()
        if n > BROADCAST_ROWS:
            batch = least(batch)
        elif n:
            again = F.broadcast(again)
            one = least(batch.join(again, _same(batch, again, key), "left_semi"))
            batch = batch.join(again, _same(batch, again, key), "left_anti").unionByName(one)
    if stored is None:
        return batch
    there = batch.select(*key).join(stored.select(*key), list(key), "left_semi").distinct()
    n = there.count()
    return batch.join(_small(there, n), list(key), "left_anti") if n else batch


def masked(rows: DataFrame, mask: DataFrame, key: tuple[str, ...] = ("log_time", "sequence")) -> DataFrame:
    """The ordered, de-duplicated merge of rows without the keys in ``mask``."""
    return rows.dropDuplicates(list(key)).join(mask.select(*key), list(key), "left_anti").orderBy(*key)


def without_range(ranges: list[tuple[int, int]], left: int, right: int) -> list[tuple[int, int]]:
    """Half-open ranges without [left, right)."""
    out = []
    for a, b in ranges:
        if b <= left or a >= right:
            out.append((a, b))
        else:
            out += [(x, y) for x, y in ((a, left), (right, b)) if x < y]
    return out
