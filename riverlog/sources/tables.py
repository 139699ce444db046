"""Topics over the driver's Parquet tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Between, Topics

#: event types are topics of their own
EVENTS = ("signup", "purchase", "click", "view", "error")
_EPOCH = datetime(1970, 1, 1)


def nanos(column: str):
    """Nanoseconds of a timestamp column (microseconds, UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp")) * F.lit(1000)


def _pushed(frame: DataFrame, column: str, between: Between) -> DataFrame:
    """The rows of a range of ns, as a predicate on the raw column that Parquet statistics can prune by."""
    if between is None:
        return frame
    kind = frame.schema[column].dataType.typeName()
    low, high = ((_EPOCH + timedelta(microseconds=n)).isoformat(sep=" ") for n in (max(0, between[0] // 1000), min(-(-between[1] // 1000), 2**53)))
    return frame.where(F.expr(f"`{column}` >= cast('{low}' as {kind}) and `{column}` <= cast('{high}' as {kind})"))


def driver_topics(spark: SparkSession, sf_dir: str) -> Topics:
    """/signup, /purchase, ... from events (producer: user), /orders (producer: status) and /lineitem (producer: return flag)."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def events(kind: str):
        def make(between: Between) -> DataFrame:
            rows = _pushed(read("events").where(F.col("event_type") == kind), "ts", between)
            return rows.select(nanos("ts").alias("log_time"), F.col("user_id").cast("string").alias("producer"), F.col("event_id").alias("sequence"), F.struct("value", "event_type", "props").alias("data"))

        return make

    def orders(between: Between) -> DataFrame:
        data = F.struct("o_custkey", "o_totalprice", "o_orderpriority", F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("header"))
        return _pushed(read("orders"), "o_orderdate", between).select(nanos("o_orderdate").alias("log_time"), F.col("o_orderstatus").alias("producer"), F.col("o_orderkey").alias("sequence"), data.alias("data"))

    def lineitem(between: Between) -> DataFrame:
        # a line's place in its order makes the sequence unique; orders are small, so no window is large
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"))
        rows = read("lineitem").withColumn("sequence", F.col("l_orderkey") * 1000 + place)
        data = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
        return _pushed(rows, "l_shipdate", between).select(nanos("l_shipdate").alias("log_time"), F.col("l_returnflag").alias("producer"), "sequence", data.alias("data"))

    out = Topics("driver")
    for kind in EVENTS:
        out.add(f"/{kind}", events(kind))
    return out.add("/orders", orders).add("/lineitem", lineitem)
