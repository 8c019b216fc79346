"""Intermediate tables in the shared folder, and blocks of text for array code.

Lineage is cut by writing Parquet to the folder that spark.checkpoint.dir names, which driver and
executors share. Only where that setting is absent and the master is local (tests, a laptop) is a local
folder used; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, the context's own, or with a local master a fresh one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/keyloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path, threading.get_ident()))
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df once and returns the table read back: later readers don't compute it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df for a join in which nothing may be sent to all executors, whatever the session's threshold.

    Sizes are estimated by files and schema: rows that explode() makes count as one, and repeated values take
    next to nothing in a file. Such a table would pass the driver although it grows with the input."""
    return df.hint("merge")


def written() -> list[str]:
    """Paths of the tables of this thread that are still there, oldest first."""
    return [path for _, path, thread in _written if thread == threading.get_ident()]


def settle(df: DataFrame, label: str, since: list[str]) -> DataFrame:
    """stash, after which the tables that this thread has written besides `since` are deleted: df was made from them."""
    out = stash(df, label)
    release([path for path in written()[:-1] if path not in since])
    return out


def release(paths: list[str] | None = None) -> None:
    """Deletes tables by path, or all; frames that read them must be materialised by then."""
    for entry in [x for x in _written if paths is None or x[1] in paths]:
        with contextlib.suppress(Exception):  # at exit the context may be gone
            spark, path, _ = entry
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(entry)


atexit.register(release)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back, and the rows' offsets (n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 4 << 20):
    """Runs (first, last) of whole rows of about `size` bytes; a longer row makes a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
