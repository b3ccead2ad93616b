"""Readers, sinks and key states on small files."""

import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varistra.sources import readers, sinks
from varistra.streaming import state


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# c\nP1\tG1\t12\tx\n#more\nP2\tG2\t7\ty\n")
    got = readers.delimited(spark, f"file://{tmp_path}/a.tsv", "\t", ["id", "name", "size", "note"], "#").collect()
    assert [r.name for r in got] == ["G1", "G2"] and got[0]["size"] == "12"
    (tmp_path / "b.txt").write_text("p1 p2 score\na b 900\n")
    assert readers.delimited(spark, f"file://{tmp_path}/b.txt", " ").first().score == "900"


def test_wide_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cell,G'1,G.2\nc1,1.5,\nc2,NaN,2\n")
    assert sorted(map(tuple, readers.wide_csv(spark, f"file://{tmp_path}/m.csv", ["cell"], "gene", "v").collect())) == [("c1", "G'1", 1.5), ("c2", "G.2", 2.0)]


def test_sets(spark, tmp_path):
    sub = lambda *g: [{"swissprot": {"gene_name": x}} for x in g]
    (tmp_path / "s.json").write_text(json.dumps([{"complex_id": 1, "complex_name": "x", "subunits": sub("a", "B", "a", None)}, {"complex_id": 2, "complex_name": "y", "subunits": sub("c")}]))
    assert sorted((r.set_id, r.gene) for r in readers.gene_sets(spark, f"file://{tmp_path}/s.json").collect()) == [(1, "A"), (1, "B")]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("s.json", json.dumps([{"ComplexID": 1, "ComplexName": "x", "Organism": "Human", "subunits(Gene name)": "a;b; "}, {"ComplexID": 2, "ComplexName": "y", "Organism": "Rat", "subunits(Gene name)": "c"}]))
    assert sorted(r.gene for r in readers.zipped_sets(spark, f"file://{tmp_path}/s.zip", "Human").collect()) == ["A", "B"]


def test_arrow_and_tensors(spark, tmp_path):
    t = pa.table({"id": pa.array([1, 2], pa.int64()), "x": pa.array([0.5, None], pa.float64())})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(map(tuple, readers.arrow_ipc(spark, f"file://{tmp_path}/t.arrow", "id long, x double").collect())) == [(1, 0.5), (2, None)]
    v = np.arange(6, dtype="<f4").reshape(3, 2)
    head = json.dumps({"activations": {"dtype": "F32", "shape": [3, 2], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "c0.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + v.tobytes())
    chunks = readers.tensor_chunks(spark, f"file://{tmp_path}/c0.safetensors")
    index = spark.createDataFrame([("a", "c0", 2)], "id string, chunk string, offset long")
    assert [tuple(r) for r in readers.gather(index, chunks).collect()] == [("a", [4.0, 5.0])]


def test_lines_publish_insert(spark, tmp_path):
    df = spark.createDataFrame([("a", float("inf"), 1), ("b", 0.1234567, None), (None, 1.0, 1), ("x" * 3000, 1.0, 1)], "k string, v double, n int")
    assert sorted(r.value for r in sinks.typed_lines(df, "k").collect()) == ['{"k":"a","n":1}', '{"k":"b","v":0.123457}']
    path = f"file://{tmp_path}/served"
    good = df.filter("k is not null").select("k")
    assert sinks.publish(good, path, "k") == 3
    with pytest.raises(ValueError):
        sinks.publish(df.select("k"), path, "k")
    assert spark.read.parquet(path).count() == 3
    at = f"file://{tmp_path}/cache"
    sinks.insert_absent(good.limit(1), at, "k")
    sinks.insert_absent(good.union(good), at, "k")
    assert spark.read.parquet(at).count() == 3


def test_fingerprint_and_cache(spark, tmp_path):
    df = spark.range(50).withColumnRenamed("id", "x")
    assert readers.fingerprint(df, ["x"]) == readers.fingerprint(df.repartition(7), ["x"]) != readers.fingerprint(df.union(df.limit(2)), ["x"])
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert readers.cached(spark, f"file://{tmp_path}/knn", "f1", make).count() == 50
    assert len(calls) == 1


def test_state_machine_batch_and_stream(spark, tmp_path):
    rows = [("a", 1, "pending"), ("a", 2, "complete"), ("a", 3, "processing"), ("a", 4, "failed"), ("a", 5, "pending"), ("b", 1, "complete"), ("c", 1, "pending")]
    df = spark.createDataFrame(rows, "k string, ts long, asked string")
    want = {"a": ("pending", 4), "b": ("not_started", 0), "c": ("pending", 1)}
    assert {r.k: (r.state, r.moves) for r in state.final_states(df, "k", "asked", ["ts"]).collect()} == want
    src = f"file://{tmp_path}/in"
    df.coalesce(1).write.parquet(src)
    q = state.stream_states(spark.readStream.schema(df.schema).parquet(src), "k", "asked").writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("states").collect():
        got[r.k] = max(got.get(r.k, ("", 0)), (r.state, r.moves), key=lambda x: x[1])
    assert got == {k: v for k, v in want.items() if v[1]}


def test_stale_keys_fail_on_the_stream(spark, tmp_path):
    """Requests out of order within the watermark's delay, a key that nothing comes to any more, one that moves before its time-out."""
    rows = [[("a", 20, 2, "processing"), ("a", 10, 1, "pending"), ("b", 10, 1, "pending"), ("b", 30, 2, "processing"), ("c", 5, 1, "complete"), (None, 7, 1, "pending"), ("d", 9, 1, None)], [("b", 60, 3, "complete"), ("b", 50, 2, "x"), ("e", None, 1, "pending")], [("z", 400, 1, "pending")], [("z", 800, 1, "processing"), ("a", 790, 5, "pending")]]
    for part in rows:
        df = spark.createDataFrame(part, "k string, s long, tie int, asked string").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    moves = state.timed_stream_states(stream, "k", "asked", "ts", "tie", 100_000, "20 seconds")
    q = moves.writeStream.format("memory").queryName("timed").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(((r.k, r.moves, r.state, r.at // 1000) for r in spark.table("timed").collect()), key=str)
    assert got == sorted([("a", 1, "pending", 10), ("a", 2, "processing", 20), ("a", 3, "failed", 120), ("b", 1, "pending", 10), ("b", 2, "processing", 30), ("b", 3, "complete", 60), (None, 1, "pending", 7), ("z", 1, "pending", 400)], key=str)


def test_redelivery(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("b", 4, True), ("c", 1, False)], "k string, t int, ok boolean")
    assert {r.k: (r.tries, r.fate) for r in state.redelivered(df, "k", "ok", ["t"]).collect()} == {"a": (2, "done"), "b": (3, "dead"), "c": (1, "open")}
