"""What the corpus operators share: tables cut from their lineage, size-checked semi-joins, free column names, what passes to Python at a time and what a
worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.session import ensure_checkpoint_dir

#: A key set of at most this many rows (two longs each, so 16 MB) may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of the rows that pass to Python at a time: JVM and worker hold a whole batch outside the heap, Spark's default being 64 MB.
BATCH_BYTES, TEXT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps start there, also after executors are lost."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialise`` wrote and nothing reads any more: whatever was made of them is written itself."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def semi_join(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``on`` is (``left_anti``: is not) in the materialised, distinct ``keys``.

    The key set is counted first and broadcast only up to ``BROADCAST_ROWS`` rows; above, both sides are shuffled.
    """
    small = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, on, how)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """The object called ``name`` that tasks of this Python worker share, made at first use; one of another name is let go."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Free what ``held`` keeps. Spark uses a worker again for other stages: a task that needs memory of its own doesn't carry an earlier stage's."""
    if _held:
        _held.clear()
        gc.collect()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside pass rows to Python ``TEXT_BYTES`` at a time; the session's own setting holds again afterwards."""
    before = spark.conf.getAll.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(TEXT_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def give_back() -> None:
    """Hand memory that was freed back to the system, where the C library can: both allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` as a task whose worker gives back what it freed: Spark keeps idle workers, and they count as the executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` has (names differ by more than case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
