"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as numpy arrays at once (about 60 times as much memory, at worst).
CHUNK_BYTES = 2 << 20

_written: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over as many partitions as there are cores: only where its files give fewer are rows moved, before work that takes much longer than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, a null text as the empty one; columns of other names can't clash with an operator's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one is made only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if of_context.isDefined():
            return of_context.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="framelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/framelake-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster's own cleaning
            return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialize() gave, once nothing reads them any more."""
    path = _paths.pop(id(df), None)
    if path:
        _remove(df.sparkSession, path)


def ranges_for(df: DataFrame, bytes_a_range: int, least: int = 8, most: int = 1 << 14, unknown: int = 64) -> int:
    """How many ranges of a hash an input is dealt to, so that a range's share doesn't grow with it: a power of two, by the size of the files that Spark's plan knows of; nothing is read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's default where it knows nothing
        return unknown
    return min(most, max(least, 1 << max(0, -(-size // bytes_a_range) - 1).bit_length()))


def slices_of(batch: pa.RecordBatch, column: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """batch in parts, without a copy, whose strings in column have about limit bytes together; a longer one comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def release() -> None:
    """Give back to the system what a worker has freed: it is used again by later tasks, which may need its memory elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library alone has it
    if trim:
        trim(0)


def batches_of(rows: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(doc_ids, UTF-8 texts) of about limit bytes; a longer text comes alone."""
    ids: list[int] = []
    held: list[bytes] = []
    size = 0
    for batch in rows:
        for part in slices_of(batch.select(["doc_id", "text"]), "text", limit):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                if held and size + len(t) > limit:
                    yield ids, held
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(t)
                size += len(t)
    if held:
        yield ids, held
