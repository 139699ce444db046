"""Shared-folder tables and session settings that the operators of this subpackage use.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, the folder that the driver
and all executors share. That cuts lineage (a lost executor costs the tasks it ran, not the job) and,
unlike a cache, doesn't hold executor memory. The folders stay until ``clear`` removes them.
"""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch: small, as texts may be long and Python workers have little memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    path = os.path.join(tempfile.mkdtemp(prefix="riverlog-"), f"{top.name}.zip")
    Path(path).write_bytes(out.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, and sees that they can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in tests, a local temporary one. On a cluster it has to be set, as
    executors wouldn't see each other's local folders."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riverlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/riverlog-llm"


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; it isn't created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, once each. Others don't matter, even if their names differ in case alone or are repeated: a
    column is the first of exactly that name."""
    wanted = list(dict.fromkeys(names))
    if missing := [n for n in wanted if n not in df.columns]:
        raise ValueError(f"there is no column {', '.join(missing)}")
    at = df.toDF(*(f"_{k}" for k in range(len(df.columns))))
    return at.select(*(at[f"_{df.columns.index(n)}"].alias(n) for n in wanted))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a DataFrame that reads the files."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows: about ``each`` in one at most, and no fewer than the session's shuffle partitions. Those of an explicit
    repartition are never raised by Spark itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def clear(spark: SparkSession) -> None:
    """Removes everything that this subpackage left in the shared folder; results not yet read are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def releasing(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which memory that it freed goes back to the operating system. Workers live on over tasks and stages; else
    each holds the most that any of its tasks had."""

    @wraps(run)
    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # other C libraries don't have it
                ctypes.CDLL(None).malloc_trim(0)

    return released


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most ``most`` bytes of ``text``, or one longer row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(column(batch, text)), 0).to_pylist()
        first, total = 0, 0
        for k, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(first, k - first)
                first, total = k, 0
            total += n
        if first < len(sizes):
            yield batch.slice(first)
