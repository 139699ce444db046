"""Following a log: new rows as they are committed, and streams of message files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.visibility import KEY


def tail(store, topics: list[str], versions: dict[str, int] | None = None, start_ns: int = 0, end_ns: int = (1 << 63) - 1, idle_s: float = 0.5, polls: int | None = None) -> Iterator[DataFrame]:
    """Yields what is new in a ``LogStore`` since ``versions`` (default: everything), again and again; waits while there is nothing."""
    at = {t: (versions or {}).get(t, 0) for t in topics}
    while polls is None or polls > 0:
        found, at = store.export(at, start_ns, end_ns)
        if found is not None:
            yield found
        else:
            time.sleep(idle_s)
        polls = None if polls is None else polls - 1


def read_messages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, event_time: str, delay: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """The stream without repeated keys that come within ``delay`` of each other; state older than that is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def ingest_stream(stream: DataFrame, store, topic: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Ingests each micro-batch as a commit. A batch that is run again after a failure adds nothing twice, as ingest de-duplicates."""

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch, topic)

    write: Callable = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()
