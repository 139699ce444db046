"""Logical plan to DataFrame.

Every row carries the envelope (log_time, producer, topic, sequence, publish_time, schema_hash, size_bytes, version), its
place among producers and branches, and its payload in the column of its branch, ``data_0``, ``data_1``, ...; the others are null.
Rows are in the order of (log_time, producer_rank, branch, sequence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError, TableNotFoundError
from ..operators import asof
from ..operators.predicates import filtered
from .plan import AsOf, Merge, Plan, Scan

ENVELOPE = ("log_time", "producer", "topic", "sequence", "publish_time", "schema_hash", "size_bytes", "version")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def order(desc: bool = False) -> list[Column]:
    """Time, then the order in which producers and topics are named, then sequence; descending turns time and sequence round."""
    if desc:
        return [F.col("log_time").desc(), F.col("producer_rank").asc(), F.col("branch").asc(), F.col("sequence").desc()]
    return [F.col(c).asc() for c in ("log_time", "producer_rank", "branch", "sequence")]


class Lowering:
    """``source`` gives ``frames(topic, between)`` and ``missing(topic, producers)``; ``bucket_ns``: as-of joins work in
    buckets of that width; None: of a width that is measured where a producer is large, 0: never."""

    def __init__(self, source, plan: Plan, bucket_ns: int | None = None):
        self.source, self.plan, self.bucket_ns, self.branch = source, plan, bucket_ns, 0

    def scan(self, node: Scan) -> DataFrame:
        query, branch = self.plan.query, self.branch
        self.branch += 1
        frames = self.source.frames(node.topic, query.between)
        if not frames:
            raise TableNotFoundError(f"table {self.source.database}:{(query.producers or ('*',))[0]}:{node.topic} not found")
        if query.producers and (missing := self.source.missing(node.topic, query.producers)):
            raise TableNotFoundError(f"table {self.source.database}:{missing[0]}:{node.topic} not found")
        out = []
        for frame in frames:  # one for each schema: a field has to be in all of them
            if query.producers is not None:
                frame = frame.where(F.col("producer").isin(*query.producers))
            if node.predicate is not None:
                frame = filtered(frame, node.predicate, node.alias)
            out.append(frame.select(*ENVELOPE, F.col("data").alias(f"data_{branch}")))
        same = {f.schema[f"data_{branch}"].dataType.simpleString() for f in out}
        if len(same) > 1:  # schemas that differ keep columns of their own
            out = [f.withColumnRenamed(f"data_{branch}", f"data_{branch}_{k}") for k, f in enumerate(out)]
        return union(out).withColumn("branch", F.lit(branch))

    def node(self, node) -> DataFrame:
        if isinstance(node, Scan):
            return self.scan(node)
        if isinstance(node, Merge):
            return union([self.node(x) for x in node.items])
        if isinstance(node, AsOf):
            left = self.node(node.left)  # first, so that ties put it first
            right = self.node(node.right)
            if self.bucket_ns:
                return asof.bucketed_rows(left, right, self.bucket_ns, node.immediate, node.within)
            join = asof.spread_rows if self.bucket_ns is None else asof.rows
            return join(left, right, node.immediate, node.within)
        raise PlanError(f"unknown plan node {node!r}")

    def unordered(self) -> DataFrame:
        """All rows of the result before order and paging."""
        out, producers = self.node(self.plan.root), self.plan.query.producers
        if producers is None:
            return out.withColumn("producer_rank", F.col("producer"))
        rank = F.create_map(*(F.lit(x) for k, p in reversed(list(enumerate(producers))) for x in (p, k)))
        return out.withColumn("producer_rank", rank[F.col("producer")])

    def frame(self) -> DataFrame:
        """The result in order, with the query's paging."""
        q = self.plan.query
        out = self.unordered().orderBy(*order(q.desc))
        if q.offset:
            out = out.offset(q.offset)
        return out.limit(q.limit) if q.limit is not None else out
