"""Helpers shared by the operators: written tables, file access and text columns."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.session import scratch_path

_LIBC = ctypes.CDLL(None)


def ship(spark: SparkSession, batch_rows: int = 5000) -> None:
    """Let the executors import this library (once a SparkContext), as ``--py-files`` would, and
    set how many rows Spark hands to a Python worker at once (texts may be long)."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    if getattr(sc, "_demandlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="demandlens-py-"), "demandlens_py.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._demandlens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame) -> DataFrame:
    """The two columns the text operators read; anything else in ``df`` is left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(text: str = "text") -> Column:
    """64-bit key of a whole text (null: empty). With doc_id it names a row, so that rows
    that share a doc_id but not a text stay apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# --- files in the shared folder -------------------------------------------------------

def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a URI or a plain path (any scheme that pyarrow knows)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_file(uri: str, data: bytes) -> None:
    with publishing(uri) as out:
        out.write(data)


@contextmanager
def publishing(uri: str) -> Iterator[pa.NativeFile]:
    """An output stream that appears under its name only when complete: a retried or
    speculative task writes its own temporary name and the last move wins."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def release() -> None:
    """Give memory that was freed back to the system: allocators keep it, and a worker that waits
    for its next task shares the executor's memory with tasks that need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a partition's batches, and ``release`` at its end."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return whole


def text_slices(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``size`` bytes (a longer text is a run of
    its own), so that work on a run takes bounded memory however long the texts are."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths + 1) // size
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
