"""What the operators share: intermediate tables, code for the workers, rows packed for numpy."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from flowlens.session import remove, scratch_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Bytes of text that one numpy step looks at; a single longer text is a step of its own.
PIECE_BYTES = 4 << 20
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where PYTHONPATH does not already say so."""
    context = spark.sparkContext
    # Rows here can be large; a batch for a worker is cut by bytes, too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_flowlens", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-code-"), "flowlens-code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(ROOT, "flowlens")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._flowlens = True


# Intermediate tables in the order they were made: (path, name in the catalogue or None).
_MADE: list[tuple[str, str | None]] = []


def made() -> int:
    """How many intermediate tables there have been; those from here on can be released."""
    return len(_MADE)


def release(spark: SparkSession, first: int, end: int | None = None) -> None:
    """Delete the intermediate tables made from `first` to `end`: for when the result that came from them is written."""
    for place, (path, table) in list(enumerate(_MADE))[first:end]:
        if path:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, path)
            _MADE[place] = ("", None)
    forget(spark)


def reads(df: DataFrame, first: int, end: int) -> bool:
    """Whether a frame reads one of these intermediate tables."""
    paths = [path for path, _ in _MADE[first:end] if path]
    return any(path.split(":", 1)[-1].lstrip("/") in file for path in paths for file in df.inputFiles())


def land_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write an intermediate table bucketed by `key`: joins on it move the other side only.

    Tasks write their rows straight into buckets, without a shuffle.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", scratch_dir(spark, name)
    _MADE.append((path, table))
    writer = df.write.bucketBy(buckets, key).option("path", f"{path}/rows")
    writer.option("compression", "uncompressed").saveAsTable(table)
    return spark.table(table)


def land(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Later jobs start from the files, so an executor that is lost costs its running tasks only.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    _MADE.append((path, None))
    df.write.option("compression", compression).parquet(f"{path}/rows")
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def forget(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of jobs that nothing refers to any more; else it waits for the driver's memory to fill.

    Frames let go here are let go in the JVM a moment later, and what they held is found unused after that.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


# Seconds between two times that a worker hands memory back while it goes through groups.
TRIM_SECONDS = 2.0
_TRIMMED = [0.0]


def trim(every: float = 0.0) -> None:
    """Hand freed memory back to the system. Workers live on after a task, and several share an executor's memory."""
    now = time.monotonic()
    if now - _TRIMMED[0] >= every:
        _TRIMMED[0] = now
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library has no such function
            pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that hands memory back when its partition ends."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return lean_run


def lean_group(work: Callable) -> Callable:
    """A function for applyInArrow that hands memory back from time to time."""

    def lean_work(rows: pa.Table) -> pa.Table:
        out = work(rows)
        trim(TRIM_SECONDS)
        return out

    return lean_work


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def pieces(offsets, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes, or of one text."""
    first, last = 0, len(offsets) - 1
    while first < last:
        end = int(offsets.searchsorted(offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), last)
        yield first, end
        first = end


def frozen(table: pa.Table | pa.RecordBatch) -> bytes:
    """Rows as one compressed value."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def thawed(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


ROW_BITS = 21


def packed_texts(docs: DataFrame, id_col: str, text_col: str, name: str, keep_columns: bool = False, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Documents as a landed table of chunks: chunk long, n_docs long, n_bytes long, blob binary; by chunk.

    A blob holds neighbouring rows of one input partition, about `piece_bytes` of text, so no key decides
    its size: __id, __text and, if kept, __row with the other columns of `docs`. A row is named by chunk << ROW_BITS | place.
    """
    from pyspark.sql import functions as F

    ship(docs.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.words import texts

        number = partition_id() << 20
        for batch in batches:
            _, offsets = texts(batch.column(1))
            for lo, hi in pieces(offsets, piece_bytes):
                yield pa.record_batch(
                    {
                        "chunk": pa.array([number], pa.int64()),
                        "n_docs": pa.array([hi - lo], pa.int64()),
                        "n_bytes": pa.array([int(offsets[hi] - offsets[lo])], pa.int64()),
                        "blob": pa.array([frozen(batch.slice(lo, hi - lo))], pa.binary()),
                    }
                )
                number += 1

    # In a struct, names of columns do not meet those used here.
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row")
    rows = docs.select(
        F.col(id_col).cast("long").alias("__id"),
        F.col(text_col).cast("string").alias("__text"),
        *([others] if keep_columns else []),
    )
    return land_by(rows.mapInArrow(lean(chunks), "chunk long, n_docs long, n_bytes long, blob binary"), name, "chunk")


def whole_rows(table: pa.Table, columns: list[str], text_col: str, text: pa.Array, stay: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk that stay, with all columns of the documents and the given text."""
    others = iter(table.column("__row").combine_chunks().flatten()[1:])
    named = [text if c == text_col else next(others) for c in columns]
    yield pa.RecordBatch.from_arrays(named, columns).filter(pa.array(stay))


def packed_size(packed: DataFrame) -> tuple[int, int]:
    """Documents and bytes of text."""
    from pyspark.sql import functions as F

    row = packed.agg(F.sum("n_docs").alias("d"), F.sum("n_bytes").alias("b")).first()
    return row["d"] or 0, row["b"] or 0
