"""The folder that driver and executors share, for tables that cut lineage and for files that Python code on executors reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder, but only if everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="varistra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared one."""
    return f"{root(spark)}/varistra/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, by: str | None = None) -> tuple[DataFrame, str]:
    """df written to the shared folder, in folders by a column's value if one is named, and read again; and where."""
    path = scratch(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path), path


def store(uri: str):
    """(file system, path) of a shared folder's URI, for Python code on executors."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write a file under a temporary name and move it into place: a lost task leaves no half file under its name."""
    where, path = store(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(draft, compression=None) as out:
        write(out)
    where.move(draft, path)


def read_arrow(uri: str):
    """An Arrow table of a Parquet folder, read by Python on an executor; None where there is none."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    where, path = store(uri)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    files = sorted(x.path for x in where.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
    import pyarrow as pa

    return pa.concat_tables([pq.ParquetFile(where.open_input_file(f)).read() for f in files]) if files else None
