"""What queries read: topics as DataFrames with one schema each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Between = tuple[int, int] | None


def schema_hash(data: T.StructType, definition: str | None = None) -> str:
    """SHA-256 of a schema's definition, or of its Spark type where it has none."""
    import hashlib

    return hashlib.sha256((definition or data.simpleString()).encode()).hexdigest()


def enveloped(frame: DataFrame, topic: str, definition: str | None = None) -> DataFrame:
    """``frame`` (producer, sequence, log_time, data and any other part of the envelope) with the whole envelope."""
    kind = frame.schema["data"].dataType
    defaults = {
        "topic": F.lit(topic),
        "publish_time": F.col("log_time"),
        "schema_hash": F.lit(schema_hash(kind, definition)),
        "size_bytes": F.lit(None).cast("long"),
        "version": F.lit(0).cast("long"),
    }
    frame = frame.withColumns({c: v for c, v in defaults.items() if c not in frame.columns})
    return frame.select("log_time", "producer", "topic", F.col("sequence").cast("long").alias("sequence"), "publish_time", "schema_hash", "size_bytes", "version", "data")


class Topics:
    """A source made of DataFrames: ``add`` a topic with a function from a time range (ns, or None) to a frame in it."""

    def __init__(self, database: str = "db"):
        self.database = database
        self._topics: dict[str, list[Callable[[Between], DataFrame]]] = {}

    def add(self, topic: str, make: Callable[[Between], DataFrame] | DataFrame, definition: str | None = None) -> Topics:
        """A DataFrame, or a function that may push the range into its scan; rows are cut to the range in any case."""

        def frame(between: Between) -> DataFrame:
            out = enveloped(make(between) if callable(make) else make, topic, definition)
            return out if between is None else out.where((F.col("log_time") >= F.lit(between[0])) & (F.col("log_time") < F.lit(between[1])))

        self._topics.setdefault(topic, []).append(frame)
        return self

    def topics(self) -> list[str]:
        return sorted(self._topics)

    def frames(self, topic: str, between: Between = None) -> list[DataFrame]:
        return [f(between) for f in self._topics.get(topic, ())]

    def missing(self, topic: str, producers: tuple[str, ...]) -> list[str]:
        """Which of ``producers`` have no row of the topic."""
        found: set[str] = set()
        for f in self.frames(topic):
            found |= {r[0] for r in f.where(F.col("producer").isin(*producers)).select("producer").distinct().collect()}
        return [p for p in producers if p not in found]
