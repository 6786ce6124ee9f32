"""Binary files in the shared folder, written and range-read by tasks."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from fathomline.session import scratch_folder


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared scratch folder; tasks create it as they write."""
    return f"{scratch_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def new_file(folder: str, ending: str):
    """(path, output stream) of a file no other attempt of a task writes to.

    The caller reports the path as a row of its result: only files that a finished task reported are read.
    """
    path = f"{folder}/{uuid.uuid4().hex}{ending}"
    system, inner = opened(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(inner)


def reading_tasks(ranges: DataFrame, each: int = 4) -> int:
    """Tasks that read ranges of files: one for every few ranges, at least as many as run at once, at most 100 000."""
    return int(min(100_000, max(ranges.sparkSession.sparkContext.defaultParallelism, -(-ranges.count() // each))))


# Bytes of rows handed to a function of batches at a time. The process holds two batches, Spark's side the vectors of
# one: at Spark's own bound, 64 MB, long texts made that most of a worker's memory.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def small_batches(spark: SparkSession) -> None:
    """Hand rows to functions of batches in small batches from now on, unless the session sets a bound of its own."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


# What a worker process keeps for its next tasks, by the module whose functions use it.
_KEPT: dict[str, dict] = {}


def kept_by(module: str) -> dict:
    """Where a module keeps what its later tasks in a worker process need; tasks of other modules drop it."""
    return _KEPT.setdefault(module, {})


def make_room(module: str) -> None:
    """Drop what other modules keep in this process."""
    others = [own for name, own in _KEPT.items() if own and name != module]
    if others:
        for own in others:
            own.clear()
        give_back()


def give_back() -> None:
    """Hand free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches in a worker process that lives on: what other modules keep is dropped before it, free memory handed back behind it."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(run.__module__)
        yield from run(batches)
        give_back()

    return wrapped
