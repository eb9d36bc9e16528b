"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text an operator handles at once inside a task; longer texts come alone.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table; a path is only ever opened by Spark's reader."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def hexdigest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batches: Iterator[pa.RecordBatch], text_column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``size`` bytes of text at most (or one row)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_column))
        mean = max(1, column.nbytes // rows)
        step = max(1, size // mean)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def release() -> None:
    """Give freed memory back: a worker process outlives its task and waits beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def acyclic() -> Iterator[None]:
    """Without the search for cyclic garbage, which walks over all kept lists again and again; for work
    that makes no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, text_column: str) -> DataFrame:
    """mapInArrow over text slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(slices(batches, text_column))
        release()

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that begin like ``names`` and clash with no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where it is unset, a folder of our own on a
    local master, which has one machine; an error elsewhere, as executors share no local folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"{tempfile.gettempdir()}/faultline-checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
