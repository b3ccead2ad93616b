"""Arrow IPC files, one for each task, that stand under their names only when all of them are whole."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from varistra.sources import shared


@dataclass
class Shard(WriterCommitMessage):
    draft: str
    partition: int
    rows: int


class ShardWriter(DataSourceArrowWriter):
    """Tasks write drafts; the commit gives those of successful attempts their names, an abort removes the drafts."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        where, folder = shared.store(self.path)
        where.create_dir(f"{folder}/_drafts-{self.run}", recursive=True)
        draft, writer, rows = f"{folder}/_drafts-{self.run}/{uuid.uuid4().hex}", None, 0
        with where.open_output_stream(draft, compression=None) as out:
            for batch in iterator:
                if writer is None:
                    writer = pa.ipc.new_file(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer:
                writer.close()
        return Shard(draft if rows else "", TaskContext.get().partitionId(), rows)

    def commit(self, messages):
        where, folder = shared.store(self.path)
        from pyarrow import fs

        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(folder)):
                if f.path.endswith(".arrow"):
                    where.delete_file(f.path)
        for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
            where.move(m.draft, f"{folder}/shard-{m.partition:05d}-{self.run[:8]}.arrow")
        self.drop_drafts()

    def abort(self, messages):
        self.drop_drafts()

    def drop_drafts(self):
        from pyarrow import fs

        where, folder = shared.store(self.path)
        drafts = f"{folder}/_drafts-{self.run}"
        if where.get_file_info(drafts).type == fs.FileType.Directory:
            where.delete_dir(drafts)


class ShardSink(DataSource):
    """K2: ``df.write.format("arrow_shards").save(path)``."""

    @classmethod
    def name(cls):
        return "arrow_shards"

    def writer(self, schema, overwrite):
        return ShardWriter(self.options["path"], overwrite)


def write_shards(df: DataFrame, path: str, mode: str = "append") -> None:
    """K2: df as Arrow IPC files under path, one for each task that has rows; ``readers.arrow_ipc`` reads them. mode: append, or
    overwrite, which replaces the files there when the new ones are whole."""
    df.sparkSession.dataSource.register(ShardSink)
    df.write.format("arrow_shards").mode(mode).option("path", path).save()
