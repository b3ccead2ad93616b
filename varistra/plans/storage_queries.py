"""Queries over tables that are first written in the engine's own forms: chunks of vectors, Arrow shards, indexed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.plans.catalog import Tables, query
from varistra.sources import chunks, lookup, readers, shards, shared
from varistra.streaming import batches

ROWS = "SELECT vec_id AS id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 5) AS s FROM embeddings"


def summed(df: DataFrame) -> DataFrame:
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("id", F.size("v").cast("long").alias("n"), F.round(total, 5).alias("s"))


def stored_chunks(t: Tables) -> tuple[DataFrame, str]:
    path = shared.scratch(t.spark, "chunks")
    return chunks.write_chunks(t.embeddings, path, "vec_id", "embedding", rows_per_chunk=128), path


@query("s13_gathered_rows", f"{ROWS} WHERE vec_id % 10 = 3")
def gathered(t: Tables) -> DataFrame:
    """A tenth of the rows by the index of their chunks."""
    index, path = stored_chunks(t)
    return summed(chunks.read_rows(index.filter("id % 10 = 3"), path))


@query("s14_all_rows", ROWS)
def all_rows(t: Tables) -> DataFrame:
    """Every row, by ranges of chunks."""
    return summed(chunks.tensor_rows(t.spark, stored_chunks(t)[1]))


@query("s14_asked_rows", f"{ROWS} WHERE vec_id IN (3, 77, 140, 141)")
def asked_rows(t: Tables) -> DataFrame:
    """A filter on id that reaches the reader."""
    return summed(chunks.tensor_rows(t.spark, stored_chunks(t)[1]).filter(F.col("id").isin(3, 77, 140, 141)))


def doubled(x):
    return x * 2


@query("t6_micro_batches", "SELECT vec_id AS id, len(embedding) AS n, round(2 * list_sum(embedding::DOUBLE[]), 5) AS s FROM embeddings WHERE vec_id % 3 > 0")
def micro_batches(t: Tables) -> DataFrame:
    """Wanted rows of chunks through a function, one index file a batch; chunks that come later are taken alone by a second run."""
    path, out = shared.scratch(t.spark, "chunks"), shared.scratch(t.spark, "extracted")
    wanted = t.embeddings.select(F.col("vec_id").alias("id")).filter("id % 3 > 0")
    for part in range(2):
        own = t.embeddings.filter(F.pmod(F.col("vec_id"), F.lit(2)) == part)
        chunks.write_chunks(own.repartition(3, "vec_id"), path, "vec_id", "embedding", rows_per_chunk=128, mode="append")
        rows = batches.extract(t.spark, path, out, doubled, wanted, files_per_batch=2)
    return summed(rows)


@query("k2_arrow_shards", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def arrow_shards(t: Tables) -> DataFrame:
    """Written as Arrow IPC by each task and read again."""
    path = shared.scratch(t.spark, "shards")
    shards.write_shards(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return readers.arrow_ipc(t.spark, f"{path}/*.arrow", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("s10_zipped_sets", "SELECT c_nationkey AS set_id, 'N' || c_nationkey AS set_name, upper('c' || c_custkey) AS gene FROM customer WHERE c_mktsegment = 'BUILDING'")
def zipped(t: Tables) -> DataFrame:
    """Sets packed by each task as JSON lists in ZIP files, read back for one organism."""
    members = t.customer.select("c_nationkey", "c_mktsegment", F.concat(F.lit(" c"), "c_custkey").alias("gene"))
    sets = members.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.collect_list("gene"), ";").alias("genes"))  # a nation's customers
    path = shared.scratch(t.spark, "zipped")

    def pack(batches):
        import io
        import json
        import zipfile

        import pyarrow as pa
        from pyspark import TaskContext

        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("sets.json", json.dumps([{"ComplexID": k, "ComplexName": f"N{k}", "Organism": o, "subunits(Gene name)": g} for k, o, g in rows]))
            shared.put_file(f"{path}/part-{TaskContext.get().partitionId()}.zip", lambda f: f.write(held.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    sets.mapInArrow(pack, "n long").agg(F.sum("n")).collect()
    return readers.zipped_sets(t.spark, path, "BUILDING")


def orders_by_key(t: Tables) -> lookup.IndexedTable:
    return lookup.prepared(t.orders, "orders", "o_orderkey", rows_per_file=50_000)


def lines_by_order(t: Tables) -> lookup.IndexedTable:
    return lookup.prepared(t.lineitem, "lineitem", "l_orderkey", rows_per_file=50_000)


def parts_by_name(t: Tables) -> lookup.IndexedTable:
    return lookup.prepared(t.part, "part", "p_partkey", {"brand": F.upper("p_brand")}, rows_per_file=50_000)


def prepare(t: Tables) -> None:
    """The indexed tables, as a service has them before its first question."""
    for make in (orders_by_key, lines_by_order, parts_by_name):
        make(t)
