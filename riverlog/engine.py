"""The engine: queries in the query language, statistics and catalog over a source."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import PlanError, TableNotFoundError
from .operators import stats
from .plans import ql
from .plans.lower import ENVELOPE, Lowering, order, union
from .plans.plan import compile_query, describe


#: The counters of Spark's operators by what they count.
_ROWS, _FILES, _BYTES, _MS = ("numOutputRows", "shuffleRecordsWritten"), ("numFiles",), ("filesSize", "dataSize", "shuffleBytesWritten"), ("pipelineTime", "scanTime", "sortTime", "aggTime", "buildTime")


def ran_plan(frame: DataFrame) -> list[tuple]:
    """Runs ``frame`` and reads the counters of its physical operators: (id, depth, operator, rows, files, bytes, ms). No row leaves the
    executors."""
    execution = frame._jdf.queryExecution()
    began = time.perf_counter()
    total = execution.toRdd().count()
    out = [(0, 0, "Result", total, None, None, int(1000 * (time.perf_counter() - began)))]

    def visit(node, depth: int) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return visit(node.plan(), depth)
        counters, found = node.metrics().iterator(), {}
        while counters.hasNext():
            pair = counters.next()
            found[pair._1()] = pair._2().value()
        if kind not in ("InputAdapter", "WholeStageCodegenExec", "AQEShuffleReadExec"):
            out.append((len(out), depth, node.nodeName(), *(next((found[c] for c in names if c in found), None) for names in (_ROWS, _FILES, _BYTES, _MS))))
            depth += 1
        children = node.children()
        for k in range(children.size()):
            visit(children.apply(k), depth)

    visit(execution.executedPlan(), 1)
    return out


class Engine:
    """``source``: ``sources.base.Topics`` or ``sources.store.LogStore``. asof_bucket_ns: the width
    of the time buckets in which as-of joins run; None: measured where a producer is too large for one task, 0: no buckets."""

    def __init__(self, spark: SparkSession, source, asof_bucket_ns: int | None = None):
        self.spark, self.source, self.asof_bucket_ns = spark, source, asof_bucket_ns

    def query(self, text: str, limit: int = 0, offset: int = 0, skeleton: bool = False) -> DataFrame:
        """The result of a query, in order. limit and offset (0: none) apply on top of the query's own. skeleton: without payloads.

        A truncate statement takes effect and gives an empty result; ``explain`` runs the query and gives one row, ``plan``: the plan, and what
        each operator did (``analyze``).
        """
        statement = ql.parse(text)
        if isinstance(statement, ql.Truncate):
            if not hasattr(self.source, "truncate"):
                raise PlanError("this source can't be changed")
            self.source.truncate(statement.producer, statement.topic, statement.time)
            return self.spark.createDataFrame([], "log_time long, producer string, topic string, sequence long")
        plan = compile_query(statement)
        out = Lowering(self.source, plan, self.asof_bucket_ns).frame()
        if offset:
            out = out.offset(offset)
        if limit:
            out = out.limit(limit)
        if skeleton:
            out = out.select(*ENVELOPE)
        if statement.explain:
            physical = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
            ran = "\n".join(f"{'  ' * d}{name}: " + ", ".join(f"{v} {what}" for v, what in ((n, "rows"), (f, "files"), (b, "bytes"), (ms, "ms")) if v is not None) for _, d, name, n, f, b, ms in ran_plan(out))
            return self.spark.createDataFrame([(f"{describe(plan)}\n\n{physical}\n\n{ran}",)], "plan string")
        return out

    def analyze(self, text: str) -> DataFrame:
        """Runs a query and gives a row for each operator of the plan that ran, the topmost first: id, depth, operator, rows, files, bytes and
        ms, null where an operator doesn't count such. Row 0 is the result as a whole, with the time that it took."""
        return self.spark.createDataFrame(ran_plan(self.query(text)), "id int, depth int, operator string, rows long, files long, bytes long, ms long")

    def ranked(self, text: str) -> DataFrame:
        """The result with ``rank``, the place of each row from 1: for results that go where order is lost. It sorts in one task,
        so it's for results of bounded size, such as those with a limit."""
        from pyspark.sql import Window

        statement = ql.parse(text)
        return self.query(text).withColumn("rank", F.row_number().over(Window.orderBy(*order(statement.desc))))

    def json_lines(self, text: str) -> DataFrame:
        """One column ``line``: a JSON object for each row, with times as seconds and nine decimals; bytes are base64."""
        out = self.query(text)
        payloads = [F.to_json(c, {"ignoreNullFields": "false"}) for c in out.columns if c.startswith("data_")]

        def seconds(c):
            return F.format_string("%d.%09d", F.expr(f"{c} div 1000000000L"), F.pmod(F.col(c), F.lit(10**9)))

        topic = F.substring(F.to_json(F.struct(F.col("topic").alias("t"))), 6, 1 << 20)  # a JSON string and a brace
        line = F.concat(F.lit('{"topic":'), F.expr("substring(__t, 1, length(__t) - 1)"), F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit(',"log_time":'), seconds("log_time"), F.lit(',"publish_time":'), seconds("publish_time"), F.lit(',"data":'), F.coalesce(*payloads), F.lit("}"))
        return out.withColumn("__t", topic).select(line.alias("line"))

    def _topic(self, topic: str, at_version: int | None = None) -> list[DataFrame]:
        frames = self.source.frames(topic) if at_version is None else self.source.frames(topic, at_version=at_version)
        if not frames:
            raise TableNotFoundError(f"topic {topic} not found")
        return frames

    def statrange(self, topic: str, start_ns: int, end_ns: int, granularity_ns: int, producer: str | None = None, names: list[str] | None = None, quantiles: str | None = "approx", at_version: int | None = None) -> DataFrame:
        """All statistics of a topic's fields, a row each, by bin and schema. Times are in ns. at_version: as a ``LogStore`` was then."""
        frames = [f if producer is None else f.where(F.col("producer") == producer) for f in self._topic(topic, at_version)]
        return union([stats.statrange(f, start_ns, end_ns, granularity_ns, names, quantiles) for f in frames])

    def statistics(self, topic: str, field: str, names: list[str], start_s: int, end_s: int, granularity_s: int, producer: str | None = None, by_producer: bool = False, quantiles: str = "approx", at_version: int | None = None) -> DataFrame:
        """Chosen statistics of one field, a column each, by bin. Times are in seconds. The field has to be in all schemas."""
        frames = self._topic(topic, at_version)
        if len(frames) > 1:  # one payload with just this field, so that statistics span schemas
            from .operators.predicates import resolve

            frames = [f.withColumn("data", F.struct(resolve(f.schema["data"].dataType, field, F.col("data"))[0].alias("value"))) for f in frames]
            return stats.statistics(union(frames), "value", names, start_s, end_s, granularity_s, producer, by_producer, quantiles)
        return stats.statistics(frames[0], field, names, start_s, end_s, granularity_s, producer, by_producer, quantiles)

    def available_statistics(self, topic: str) -> DataFrame:
        """(field, type, statistics) of a topic, over all its schemas."""
        rows = {(n, k): s for f in self._topic(topic) for n, k, s in stats.available(f)}
        return self.spark.createDataFrame([(n, k, s) for (n, k), s in sorted(rows.items())], "field string, type string, statistics array<string>")

    def tables(self) -> DataFrame:
        """(producer, topic, messages, bytes, first, last) of all visible rows."""
        return union([f.groupBy("producer", "topic").agg(F.count("*").alias("messages"), F.sum("size_bytes").alias("bytes"), F.min("log_time").alias("first"), F.max("log_time").alias("last")) for t in self.source.topics() for f in self._topic(t)]).groupBy("producer", "topic").agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"))
