"""Chunks read by row, Arrow shards that appear whole, tables of which only matching files are opened."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistra.sources import chunks, lookup, readers, shards
from varistra.streaming import batches


@pytest.fixture()
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 16)).astype(np.float32)
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(1000)], "id long, v array<float>").repartition(3)


@pytest.mark.parametrize("kind,error", [("F32", 0), ("F16", 4e-3), ("BF16", 2e-2)])
def test_chunks_come_back(spark, vectors, tmp_path, kind, error):
    x, df = vectors
    path = f"file://{tmp_path}/c"
    index = chunks.write_chunks(df, path, "id", "v", rows_per_chunk=100, kind=kind)
    assert index.count() == 1000 and index.select("chunk").distinct().count() >= 10
    for rows in (chunks.read_rows(index, path), chunks.tensor_rows(spark, path)):
        got = {r.id: r for r in rows.collect()}
        assert len(got) == 1000 and all(np.abs(np.array(got[i].v) - x[i]).max() <= error for i in got)
    places = {(r.id, r.chunk, r.offset) for r in index.collect()}
    assert {(r.id, r.chunk, r.offset) for r in got.values()} == places
    old = readers.tensor_chunks(spark, f"{path}/*.safetensors").select("chunk", "offset", "v")
    assert old.join(index, ["chunk", "offset"]).count() == 1000  # the files are what the plain reader expects
    doubled = chunks.read_rows(index.filter("id < 5"), path, transform=lambda m: m * 2).collect()
    assert all(np.abs(np.array(r.v) - 2 * x[r.id]).max() <= 2 * error + 1e-6 for r in doubled) and len(doubled) == 5


def test_only_asked_bytes_are_read(spark, vectors, tmp_path, monkeypatch):
    _, df = vectors
    path = f"file://{tmp_path}/c"
    chunks.write_chunks(df.coalesce(1), path, "id", "v", rows_per_chunk=500)
    monkeypatch.setattr(chunks, "GAP_BYTES", 0)
    reader = chunks.ChunkReader({"path": path})
    whole = sum(len(p.ids) * p.size for p in reader.partitions())
    reader = chunks.ChunkReader({"path": path})
    list(reader.pushFilters([chunks.In(("id",), tuple(range(0, 1000, 10)))]))
    parts = reader.partitions()
    assert sorted(i for p in parts for i in p.ids) == list(range(0, 1000, 10))
    assert sum(p.begins[-1] + p.size - p.begins[0] for p in parts) * 10 == whole
    plan = chunks.tensor_rows(spark, path).filter(F.col("id").isin(5, 6, 2000))
    assert sorted(r.id for r in plan.collect()) == [5, 6] and chunks.tensor_rows(spark, path).filter("id = -1").count() == 0
    assert [(a, b, m) for a, b, m in chunks.joined_ranges([(0, 4), (4, 4), (20, 4)], gap=5)] == [(0, 8, [0, 1]), (20, 24, [2])]


def test_bad_vectors_are_an_error(spark, tmp_path):
    for i, rows in enumerate(([(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(None, [1.0])])):
        with pytest.raises(Exception, match="null ids or vectors"):
            chunks.write_chunks(spark.createDataFrame(rows, "id long, v array<float>").coalesce(1), f"file://{tmp_path}/{i}", "id", "v")
    empty = spark.createDataFrame([], "id long, v array<float>")
    assert chunks.write_chunks(empty, f"file://{tmp_path}/e", "id", "v").count() == 0 and chunks.tensor_rows(spark, f"file://{tmp_path}/e").count() == 0


def test_shards_appear_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") / 3).alias("x")).repartition(4)
    shards.write_shards(df, path)
    back = lambda: readers.arrow_ipc(spark, f"{path}/*.arrow", "id long, name string, x double")
    assert sorted(map(tuple, back().collect())) == sorted(map(tuple, df.collect())) and len(glob.glob(f"{tmp_path}/s/*.arrow")) == 4
    fails = df.select("id", F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("name")).alias("name"), "x")
    with pytest.raises(Exception):
        shards.write_shards(fails, path)
    assert back().count() == 1000 and not glob.glob(f"{tmp_path}/s/_drafts*")
    shards.write_shards(df.filter("id < 10"), path, "overwrite")
    assert back().count() == 10
    with pytest.raises(Exception):
        shards.write_shards(fails, path, "overwrite")
    assert back().count() == 10
    shards.write_shards(df.limit(0), path)
    assert back().count() == 10


def test_lookups_open_matching_files_only(spark, tmp_path):
    rows = [(i if i % 50 else None, f"Gene{i % 97}" if i % 10 else None, i * 3 % 101) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, name string, score long").repartition(3)
    path = f"file://{tmp_path}/t"
    lookup.write_indexed(df, path, "k", {"name": F.upper("name")}, rows_per_file=100)
    table = lookup.IndexedTable(spark, path)
    files = len(glob.glob(f"{tmp_path}/t/table/*.parquet"))
    assert files >= 15
    assert [tuple(r) for r in table.between(777, 777).collect()] == [rows[777]] and len(table.opened) == 1
    assert sorted(r.k for r in table.between(500, 560).collect()) == [i for i in range(500, 561) if i % 50] and len(table.opened) <= 3
    assert table.between(5000, 6000).count() == 0 and table.opened == []
    got = table.prefixed("name", "GENE9").filter(F.upper("name").startswith("GENE9"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if (r[1] or "").startswith("Gene9"))
    assert all(f.startswith(("index/name", "table")) for f in table.opened)
    assert table.by_index("name", "NONE", "NONE").count() == 0 and not [f for f in table.opened if f.startswith("table")]
    one = spark.createDataFrame([(i, f"n{i // 100}", 0) for i in range(2000)], df.schema)
    lookup.write_indexed(one, f"{path}2", "k", {"name": F.col("name")}, rows_per_file=100)
    narrow = lookup.IndexedTable(spark, f"{path}2")
    assert narrow.by_index("name", "n7", "n7").filter("name = 'n7'").count() == 100
    assert len([f for f in narrow.opened if f.startswith("table")]) <= 3  # of 20
    lookup.write_indexed(df.limit(0), f"{path}3", "k", {"name": F.col("name")})
    empty = lookup.IndexedTable(spark, f"{path}3")
    assert empty.between(0, 9).count() == 0 and empty.prefixed("name", "G").count() == 0


def test_prepared_tables_are_kept(spark, tmp_path):
    spark.range(100).write.parquet(f"file://{tmp_path}/r")
    df = spark.read.parquet(f"file://{tmp_path}/r")
    first = lookup.prepared(df, "r", "id")
    assert lookup.prepared(df, "r", "id") is first and first.between(3, 5).count() == 3
    assert os.path.isdir(first.path.removeprefix("file://"))


def test_stopped_extraction_goes_on(spark, vectors, tmp_path, monkeypatch):
    """A run that fails within its third batch, after files of it were written, and the run after it give each row once."""
    x, df = vectors
    source, out = f"file://{tmp_path}/c", f"file://{tmp_path}/o"
    chunks.write_chunks(df.repartition(5, "id"), source, "id", "v", rows_per_chunk=64)
    read, calls = chunks.read_rows, []

    def broken(index, *args, **kw):
        calls.append(index.count())
        rows = read(index, *args, **kw)
        if len(calls) == 3:
            rows.write.parquet(f"{out}/rows/batch=2")
            raise RuntimeError("lost")
        return rows

    monkeypatch.setattr(chunks, "read_rows", broken)
    with pytest.raises(Exception, match="lost"):
        batches.extract(spark, source, out, files_per_batch=1)
    assert len(calls) == 3 and len(glob.glob(f"{tmp_path}/o/rows/batch=*")) == 3
    first = {b: os.path.getmtime(f"{tmp_path}/o/rows/batch={b}") for b in (0, 1)}
    got = batches.extract(spark, source, out, files_per_batch=1).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and all(np.array_equal(np.float32(r.v), x[r.id]) for r in got)
    assert len(calls) == 6 and calls[2] == calls[3] and first == {b: os.path.getmtime(f"{tmp_path}/o/rows/batch={b}") for b in (0, 1)}
    assert batches.extract(spark, source, out).count() == 1000 and len(calls) == 6  # nothing new
    chunks.write_chunks(spark.createDataFrame([(5000, [1.0] * 16), (5001, [2.0] * 16)], df.schema), source, "id", "v", mode="append")
    keep = spark.createDataFrame([(5001,), (5001,), (None,), (7,)], "id long")
    later = batches.extract(spark, source, out, transform=lambda m: m + 1, keep=keep)
    assert [list(r.v) for r in later.filter("id >= 5000").collect()] == [[3.0] * 16] and later.count() == 1001


def test_extraction_of_nothing(spark, vectors, tmp_path):
    _, df = vectors
    chunks.write_chunks(df.limit(0), f"file://{tmp_path}/c", "id", "v")
    assert batches.extract(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/o").count() == 0
