"""Extraction over stored chunks in bounded micro-batches that a stopped run takes up again."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from varistra.sources import chunks, shared

INDEX = "id long, chunk string, offset long, begin long, bytes long"
ROWS = f"{chunks.SCHEMA}, batch long"


def extract(spark: SparkSession, source: str, out: str, transform=None, keep: DataFrame | None = None, files_per_batch: int = 16) -> DataFrame:
    """The rows of the chunks under source, or those whose id is in keep's column id, through transform into out; returns all of out.

    A micro-batch is so many files of the chunks' index, so what is in flight is bounded. It is written to a folder of its
    number, over what an attempt that was stopped may have left there; which batches are done stands in out's own log.
    A run after a stop goes on at the batch it was in, and a run after new chunks were added takes those alone: each row
    is in out once. Only one run at a time may write to out. No chunks: an empty result. Rows of an id that the index
    holds twice stay two; null ids can't be written; repeated and null ids in keep count once and not at all."""
    wanted = keep.select("id").dropna().distinct() if keep is not None else None

    def one(batch: DataFrame, number: int) -> None:
        asked = batch if wanted is None else batch.join(wanted, "id", "left_semi")
        chunks.read_rows(asked, source, transform=transform).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    index = spark.readStream.schema(INDEX).option("maxFilesPerTrigger", files_per_batch).parquet(f"{source}/index")
    run = index.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    where, at = shared.store(f"{out}/rows")
    if where.get_file_info(at).type == fs.FileType.NotFound:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(f"{out}/rows")
