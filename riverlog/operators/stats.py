"""Multigranular statistics of fields over time bins.

Bins have the widths 60 s * 64**k, aligned to 1970; a requested granularity snaps to the largest of them that isn't above it.
All statistics but quantiles are built from ``partials``, which merge associatively: over bins, schemas and producers.
Statistics count visible rows; bins that overlap [start, end) are returned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldNotFoundError, FieldTypeError, PlanError
from ..functions.schema import flatten
from .predicates import resolve

SECOND = 10**9
WIDTHS = tuple(60 * 64**k for k in range(5))
QUANTILES = {"P25": 0.25, "P50": 0.5, "P75": 0.75, "P90": 0.9, "P95": 0.95, "P99": 0.99}
NUMERIC = ("mean", "min", "max", "sum", "count", *QUANTILES)
TEXT = ("min", "max")
ALPHA = 0.01
_GAMMA = (1 + ALPHA) / (1 - ALPHA)
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)


def snap(granularity_ns: int) -> int:
    """The bin width in seconds."""
    fits = [w for w in WIDTHS if w * SECOND <= granularity_ns]
    if not fits:
        raise PlanError("sorry, too granular: the finest granularity is 60 seconds")
    return fits[-1]


def bin_start(width_s: int) -> Column:
    """The start of a row's bin in ns; integer arithmetic, as ns are beyond what doubles hold."""
    w = width_s * SECOND
    return (F.col("log_time") - F.pmod(F.col("log_time"), F.lit(w))).alias("start")


def fields(frame: DataFrame, names: list[str] | None = None) -> list[tuple[str, Column, str]]:
    """(name, column, "numeric" or "text") of the named fields of a frame's payload, or of all with statistics."""
    data, root = frame.schema["data"].dataType, F.col("data")
    every = names if names is not None else [f.name for f in flatten(data)]
    out = []
    for name in every:
        col, kind = resolve(data, name, root)
        if isinstance(kind, _NUMBERS):
            out.append((name, col, "numeric"))
        elif isinstance(kind, T.StringType):
            out.append((name, col, "text"))
        elif names is not None:
            raise FieldTypeError(f"field {name} of type {kind.simpleString()} has no statistics")
    return out


def finite(col: Column) -> Column:
    """The value as a double, null where it is NaN or infinite."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def overlapping(frame: DataFrame, width_s: int, start_ns: int, end_ns: int) -> DataFrame:
    """Rows whose bin overlaps [start, end): a range of log_time, so it can be pushed down."""
    w = width_s * SECOND
    low, high = start_ns // w * w, -(-end_ns // w) * w
    return frame.where((F.col("log_time") >= F.lit(low)) & (F.col("log_time") < F.lit(high if end_ns > start_ns else low)))


def partials(frame: DataFrame, width_s: int = 60, names: list[str] | None = None, by: tuple[str, ...] = ("schema_hash",)) -> DataFrame:
    """Mergeable statistics: (by, start, field, type, n, total, low, high, text_low, text_high), and rows of field null with
    n messages, total bytes, and low and high log_time in observed_low and observed_high. One pass, one shuffle of bins."""
    chosen, aggs = fields(frame, names), []
    for k, (_, col, kind) in enumerate(chosen):
        x = finite(col) if kind == "numeric" else col
        aggs += [F.count(x).alias(f"n{k}"), F.min(x).alias(f"low{k}"), F.max(x).alias(f"high{k}")]
        aggs += [F.sum(x).alias(f"sum{k}")] if kind == "numeric" else []
    aggs += [F.count("*").alias("n"), F.sum("size_bytes").cast("double").alias("bytes"), F.min("log_time").alias("t0"), F.max("log_time").alias("t1")]
    bins = frame.groupBy(*by, bin_start(width_s)).agg(*aggs)
    null_s, null_d, null_l = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")

    def row(field, kind, n, total, low, high, text_low, text_high, t0, t1):
        return F.struct(F.lit(field).cast("string").alias("field"), F.lit(kind).alias("type"), n.alias("n"), total.alias("total"), low.alias("low"), high.alias("high"), text_low.alias("text_low"), text_high.alias("text_high"), t0.alias("observed_low"), t1.alias("observed_high"))

    rows = [row(None, "message", F.col("n"), F.col("bytes"), null_d, null_d, null_s, null_s, F.col("t0"), F.col("t1"))]
    for k, (name, _, kind) in enumerate(chosen):
        n, low, high = F.col(f"n{k}"), F.col(f"low{k}"), F.col(f"high{k}")
        rows.append(row(name, kind, n, F.col(f"sum{k}"), low, high, null_s, null_s, null_l, null_l) if kind == "numeric" else row(name, kind, n, null_d, null_d, null_d, low, high, null_l, null_l))
    return bins.select(*by, "start", F.explode(F.array(*rows)).alias("r")).select(*by, "start", "r.*")


def merged(parts: DataFrame, width_s: int, by: tuple[str, ...] = ("schema_hash",)) -> DataFrame:
    """Partials merged into wider bins, and over everything that isn't in ``by``."""
    w = width_s * SECOND
    parts = parts.withColumn("start", F.col("start") - F.pmod(F.col("start"), F.lit(w)))
    return parts.groupBy(*by, "start", "field", "type").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("text_low").alias("text_low"), F.max("text_high").alias("text_high"), F.min("observed_low").alias("observed_low"), F.max("observed_high").alias("observed_high")
    )


def statrange(frame: DataFrame, start_ns: int, end_ns: int, granularity_ns: int, names: list[str] | None = None, quantiles: str | None = "approx", by: tuple[str, ...] = ("schema_hash",)) -> DataFrame:
    """Long rows (by, start, end, type, field, name, value, text_value); value is a double, and text_value is that of text fields."""
    width = snap(granularity_ns)
    frame = overlapping(frame, width, start_ns, end_ns)
    parts = partials(frame, width, names, by)
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def stat(name, value, text=null_s):
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), text.alias("text_value"))

    numeric = F.array(stat("mean", F.col("total") / F.col("n")), stat("min", F.col("low")), stat("max", F.col("high")), stat("sum", F.col("total")), stat("count", F.col("n")))
    text = F.array(stat("min", null_d, F.col("text_low")), stat("max", null_d, F.col("text_high")))
    message = F.array(stat("messageCount", F.col("n")), stat("bytesUncompressed", F.col("total")), stat("minObservedTime", F.col("observed_low")), stat("maxObservedTime", F.col("observed_high")))
    each = F.when(F.col("type") == "numeric", F.filter(numeric, lambda s: (F.col("n") > 0) | (s["name"] == "count"))).when(F.col("type") == "text", text).otherwise(message)
    end = (F.col("start") + F.lit(width * SECOND)).alias("end")
    out = parts.select(*by, "start", end, "type", F.coalesce("field", F.lit("")).alias("field"), F.explode(each).alias("s")).select(*by, "start", "end", "type", "field", "s.*")
    if not quantiles:
        return out
    points = quantile_rows(frame, width, [f for f in fields(frame, names) if f[2] == "numeric"], by, quantiles)
    return out.unionByName(points.select(*by, "start", end, F.lit("numeric").alias("type"), "field", "name", "value", null_s.alias("text_value")))


def quantile_rows(frame: DataFrame, width_s: int, chosen: list[tuple[str, Column, str]], by: tuple[str, ...], how: str) -> DataFrame:
    """(by, start, field, name, value) of all ``QUANTILES``. how: "exact", "approx" (rank error) or "sketch" (1 % of the value)."""
    if not chosen:
        return frame.select(*by, F.lit(0).cast("long").alias("start"), F.lit("").alias("field"), F.lit("").alias("name"), F.lit(0.0).alias("value")).where(F.lit(False))
    if how == "sketch":
        return sketch_quantiles(sketch(frame, width_s, chosen, by), by)
    points = F.array(*(F.lit(q) for q in QUANTILES.values()))
    f = F.percentile if how == "exact" else F.percentile_approx
    bins = frame.groupBy(*by, bin_start(width_s)).agg(*(f(finite(c), points).alias(f"q{k}") for k, (_, c, _) in enumerate(chosen)))
    rows = F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"q{k}").cast("array<double>").alias("q")) for k, (name, _, _) in enumerate(chosen)))
    long = bins.select(*by, "start", F.explode(rows).alias("r")).where(F.col("r.q").isNotNull())
    names = F.array(*(F.lit(n) for n in QUANTILES))
    return long.select(*by, "start", F.col("r.field").alias("field"), F.explode(F.arrays_zip(names.alias("name"), F.col("r.q").alias("value"))).alias("z")).select(*by, "start", "field", F.col("z.name").alias("name"), F.col("z.value").alias("value"))


def sketch(frame: DataFrame, width_s: int, chosen: list[tuple[str, Column, str]], by: tuple[str, ...] = ()) -> DataFrame:
    """A relative-error quantile sketch as rows (by, start, field, sign, bucket, n): values x > 0 go to ceil(log(x) / log(gamma)).
    Sketches merge by adding n."""
    values = F.array(*(F.struct(F.lit(name).alias("field"), finite(c).alias("x")) for name, c, _ in chosen))
    long = frame.select(*by, bin_start(width_s), F.explode(values).alias("v")).where(F.col("v.x").isNotNull())
    x = F.col("v.x")
    bucket = F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / math.log(_GAMMA))).cast("long")
    return long.groupBy(*by, "start", F.col("v.field").alias("field"), F.signum(x).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sketch_quantiles(sketched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, field, name, value): the middle of the bucket that holds the rank q * (n - 1)."""
    key = [*by, "start", "field"]
    value = F.col("sign") * F.when(F.col("sign") == 0, 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1))
    ordered = Window.partitionBy(*key).orderBy("value")  # buckets, not rows: a few thousand at most
    cum = sketched.withColumn("value", value).groupBy(*key, "value").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*key))})
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in QUANTILES.items())))
    hit = cum.select(*key, "value", "upto", "n", "total", names.alias("p")).where((F.col("upto") > F.col("p.q") * (F.col("total") - 1)) & (F.col("upto") - F.col("n") <= F.col("p.q") * (F.col("total") - 1)))
    return hit.select(*key, F.col("p.name").alias("name"), "value")


def statistics(frame: DataFrame, field: str, stats: list[str], start_s: int, end_s: int, granularity_s: int, producer: str | None = None, by_producer: bool = False, quantiles: str = "approx") -> DataFrame:
    """One row for each bin (and producer): start and end in ns and a column for each of ``stats``, null where a bin has none."""
    width = snap(granularity_s * SECOND)
    if producer is not None:
        frame = frame.where(F.col("producer") == producer)
    (name, col, kind) = fields(frame, [field])[0]
    allowed = [s for s in NUMERIC if s != "sum"] if kind == "numeric" else list(TEXT)
    if unknown := [s for s in stats if s not in [*allowed, "messageCount"]]:
        raise FieldNotFoundError(f"statistics {', '.join(unknown)} are not available for field {name}; there are {', '.join(allowed)}")
    by = ["producer"] if by_producer else []
    x = finite(col) if kind == "numeric" else col
    made = {"mean": F.avg(x), "min": F.min(x), "max": F.max(x), "count": F.count(x), "messageCount": F.count("*")}
    point = F.percentile if quantiles == "exact" else F.percentile_approx
    made |= {n: point(x, F.lit(q)) for n, q in QUANTILES.items()}
    frame = overlapping(frame, width, start_s * SECOND, end_s * SECOND)
    return frame.groupBy(*by, bin_start(width)).agg(*(made[s].alias(s) for s in stats)).select(*by, "start", (F.col("start") + F.lit(width * SECOND)).alias("end"), *stats)


def available(frame: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(field, "numeric" or "text", statistics) of all fields of a frame's payload that have statistics."""
    return [(name, kind, [s for s in NUMERIC if s != "sum"] if kind == "numeric" else list(TEXT)) for name, _, kind in fields(frame)]
