"""Helpers shared by the corpus operators: shared scratch tables and files."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every word-based operator: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which the rows of one key are split before their aggregate is joined back.
SALTS = 64
#: Bytes of rows that a task and its Python worker hand each other at a time, where an operator runs within small_batches.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varistra-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared root."""
    return f"{shared_root(spark)}/varistra/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, wherever its store is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def store(uri: str):
    """(file system, path) of a shared URI for Python code on executors: file, hdfs, s3, gs and the like."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write a file under a temporary name and move it into place, so that a lost or repeated task leaves no half file."""
    where, path = store(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(draft, compression=None) as out:
        write(out)
    where.move(draft, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORKER: dict = {}


def worker_cache(owner: str, key, make):
    """What a Python worker keeps from task to task for one operator; workers are reused, so another owner's or key's goes."""
    if _WORKER.get("of") != (owner, key):
        forget()
        _WORKER.update(of=(owner, key), held=make())
    return _WORKER["held"]


def forget() -> None:
    """Give back what this Python worker keeps; for tasks that don't need what the operator's earlier tasks kept."""
    _WORKER.clear()
    give_back()


def give_back() -> None:
    """Hand the system the memory that this worker has freed: Spark takes waiting workers in turn, so all that a step ever had at once stay alive."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others have none
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started within pass Arrow batches of BATCH_BYTES, or of one longer row, instead of Spark's 64 MB; a limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key)


def by_bytes(batch, column: int, most: int):
    """An Arrow batch in slices of about most bytes in a column of texts or bytes; a longer row is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
