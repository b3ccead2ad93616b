"""Chunks of vectors in tensor files with a JSON header (its length first), and a data source that reads single rows of them.

Writing gives an index (id, chunk, offset, ...), kept beside the chunks; reading by id touches the bytes of those rows only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from varistra.sources import shared

SCHEMA = "id long, chunk string, offset long, v array<float>"
#: Bytes of one partition of a full scan; rows this near each other are read at once; rows of a batch.
PART_BYTES, GAP_BYTES, BATCH = 64 << 20, 64 << 10, 1024


def encoded(rows, kind: str) -> bytes:
    import numpy as np

    x = np.ascontiguousarray(rows, "<f4")
    if kind == "F32":
        return x.tobytes()
    if kind == "F16":
        return x.astype("<f2").tobytes()
    bits = x.view("<u4")  # BF16: the upper half, rounded to even
    return ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2").tobytes()


def decoded(data: bytes, kind: str, width: int):
    import numpy as np

    if kind == "BF16":
        return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4").reshape(-1, width)
    return np.frombuffer(data, {"F32": "<f4", "F16": "<f2", "F64": "<f8"}[kind]).astype("<f4").reshape(-1, width)


def write_chunks(df: DataFrame, path: str, key: str, vector: str, rows_per_chunk: int = 4096, kind: str = "F32", name: str = "activations", mode: str = "error") -> DataFrame:
    """Vectors into chunks under path; returns the index (id, chunk, offset, begin, bytes), stored under path/index.
    Mode "append" adds chunks to those that are there.

    A chunk's file has a name that no other attempt of its task has, and the index names only those of attempts that
    succeeded. All vectors have one length; another, a null vector or a null id is an error."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(ids, rows, at):
            x = np.concatenate(rows)
            chunk, body = f"chunk-{TaskContext.get().partitionId():05d}-{at:05d}-{uuid.uuid4().hex[:8]}", encoded(x, kind)
            head = json.dumps({name: {"dtype": kind, "shape": list(x.shape), "data_offsets": [0, len(body)]}}).encode()
            shared.put_file(f"{path}/{chunk}.safetensors", lambda f: f.write(len(head).to_bytes(8, "little") + head + body))
            n, size = len(x), len(body) // max(1, len(x))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array([chunk] * n), pa.array(range(n), pa.int64()), pa.array(range(8 + len(head), 8 + len(head) + n * size, size) if size else [8 + len(head)] * n, pa.int64()), pa.array([size] * n, pa.int64())], ["id", "chunk", "offset", "begin", "bytes"])

        ids, rows, held, at, width = [], [], 0, 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_chunk):
                part = batch.slice(start, rows_per_chunk)
                column = part.column(1)
                lengths = set(np.diff(column.offsets.to_numpy()).tolist())
                if part.column(0).null_count or column.null_count or len(lengths | ({width} if width is not None else set())) > 1:
                    raise ValueError(f"null ids or vectors, or vectors of lengths {sorted(lengths)}")
                (width,) = lengths
                ids.append(part.column(0).to_numpy())
                rows.append(column.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(part.num_rows, width))
                held += part.num_rows
                if held >= rows_per_chunk:
                    yield flush(ids, rows, at)
                    ids, rows, held, at = [], [], 0, at + 1
        if held:
            yield flush(ids, rows, at)

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    rows.mapInArrow(run, "id long, chunk string, offset long, begin long, bytes long").write.mode(mode).parquet(f"{path}/index")
    return df.sparkSession.read.parquet(f"{path}/index")


def header(uri: str, name: str) -> tuple[str, int, int, int]:
    """(kind, values in a row, where the rows begin, how many) of a chunk's tensor."""
    where, path = shared.store(uri)
    with where.open_input_file(path) as f:
        n = int.from_bytes(f.read(8), "little")
        about = json.loads(f.read(n))[name]
    shape = about["shape"]
    width = 1
    for s in shape[1:]:
        width *= s
    return about["dtype"], width, 8 + n + about["data_offsets"][0], shape[0]


def joined_ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[int]]]:
    """(begin, end, members) of reads that cover sorted places (begin, bytes); those at most gap apart are one read."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (begin, size) in enumerate(places):
        if out and begin - out[-1][1] <= gap and begin + size - out[-1][0] <= PART_BYTES:
            out[-1] = (out[-1][0], max(out[-1][1], begin + size), [*out[-1][2], i])
        else:
            out.append((begin, begin + size, [i]))
    return out


def read_rows(index: DataFrame, path: str, name: str = "activations", transform=None, gap: int = GAP_BYTES) -> DataFrame:
    """(id, chunk, offset, v) of the rows of an index, however many: they are dealt by chunk and read in order of place.

    A task opens a chunk once and reads only ranges that hold its rows. transform turns a batch's matrix into another."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows_of(chunk, ids, offsets, begins, sizes):
            kind, width, _, _ = header(f"{path}/{chunk}.safetensors", name)
            where, file = shared.store(f"{path}/{chunk}.safetensors")
            with where.open_input_file(file) as f:
                for begin, end, members in joined_ranges(list(zip(begins, sizes)), gap):
                    f.seek(begin)
                    data = f.read(end - begin)
                    for at in range(0, len(members), BATCH):
                        some = members[at : at + BATCH]
                        x = np.concatenate([decoded(data[begins[i] - begin : begins[i] - begin + sizes[i]], kind, width) for i in some])
                        x = np.asarray(transform(x), "<f4") if transform else x
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array([chunk] * len(some)), pa.array([offsets[i] for i in some], pa.int64()), lists], ["id", "chunk", "offset", "v"])

        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != now or len(held) >= 100_000:
                    if held:
                        yield from rows_of(now, *map(list, zip(*held)))
                    now, held = row[0], []
                held.append(row[1:])
        if held:
            yield from rows_of(now, *map(list, zip(*held)))

    dealt = index.select("chunk", "id", "offset", "begin", "bytes").repartition("chunk").sortWithinPartitions("chunk", "begin")
    return dealt.mapInArrow(run, SCHEMA)


@dataclass
class Range(InputPartition):
    """Rows of one chunk that stand close together."""

    chunk: str
    ids: list[int]
    offsets: list[int]
    begins: list[int]
    size: int


class ChunkReader(DataSourceReader):
    """Partitions are ranges of chunks; a filter on id leaves those that hold the ids."""

    def __init__(self, options):
        self.path, self.name, self.ids = options["path"], options.get("name", "activations"), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                asked = set(f.value if isinstance(f, In) else [f.value])
                self.ids = asked if self.ids is None else self.ids & asked
            yield f  # Spark tests the rows again

    def partitions(self):
        import pyarrow.parquet as pq

        where, at = shared.store(f"{self.path}/index")
        chosen = None if self.ids is None else [("id", "in", sorted(i for i in self.ids if i is not None))]
        if chosen and not chosen[0][2]:
            return []
        from pyarrow import fs

        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
        out = []
        for file in files:
            rows = pq.read_table(file, filesystem=where, filters=chosen).sort_by([("chunk", "ascending"), ("begin", "ascending")]).to_pydict()
            spans = list(zip(rows["chunk"], rows["begin"], rows["bytes"]))
            start = 0
            for i in range(1, len(spans) + 1):
                # a new partition at another chunk, after a gap, or when it is full
                if i == len(spans) or spans[i][0] != spans[start][0] or spans[i][1] - spans[i - 1][1] - spans[i - 1][2] > GAP_BYTES or spans[i][1] - spans[start][1] >= PART_BYTES:
                    part = slice(start, i)
                    if start < i:
                        out.append(Range(spans[start][0], rows["id"][part], rows["offset"][part], rows["begin"][part], spans[start][2]))
                    start = i
        return out

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        if not isinstance(partition, Range):  # Spark asks once even if there are no partitions
            return
        uri = f"{self.path}/{partition.chunk}.safetensors"
        kind, width, _, _ = header(uri, self.name)
        where, file = shared.store(uri)
        first = partition.begins[0]
        with where.open_input_file(file) as f:
            f.seek(first)
            data = f.read(partition.begins[-1] + partition.size - first)
        for at in range(0, len(partition.ids), BATCH):
            x = np.concatenate([decoded(data[b - first : b - first + partition.size], kind, width) for b in partition.begins[at : at + BATCH]])
            ids, offsets = partition.ids[at : at + BATCH], partition.offsets[at : at + BATCH]
            lists = pa.array(list(x), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([partition.chunk] * len(ids)), pa.array(offsets, pa.int64()), lists], ["id", "chunk", "offset", "v"])


class ChunkSource(DataSource):
    """``spark.read.format("tensor_rows").load(path)``: id, chunk, offset and v of each row; filters on id choose bytes."""

    @classmethod
    def name(cls):
        return "tensor_rows"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ChunkReader(self.options)


def tensor_rows(spark: SparkSession, path: str, name: str = "activations") -> DataFrame:
    """The chunks under path as rows; an ``isin`` or equality filter on id reads their bytes only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
    return spark.read.format("tensor_rows").option("path", path).option("name", name).load()
