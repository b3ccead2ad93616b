"""Vectors as arrays: normalising, views, exact cosine neighbours by blocks, group means and standardising."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varistra.sources import shared

#: Vectors are stored in parts of about so many bytes, and a task asks for so many at once.
BLOCK_BYTES = 8 << 20
#: Similarities that a task works out at once.
TILE = 2 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-10) -> Column:
    """M1: length 1; a vector shorter than eps is divided by eps."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def views(a: Column, rows: int, cols: int) -> tuple[Column, Column, Column]:
    """M3: row means, column means and the flat vector of a row-major matrix."""
    row = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.aggregate(F.slice(a, i * cols + 1, F.lit(cols)), F.lit(0.0), lambda s, x: s + x.cast("double")) / cols)
    col = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(rows - 1)), F.lit(0.0), lambda s, i: s + F.get(a, (i * cols + j).cast("int")).cast("double")) / rows)
    return row, col, a


def neighbours(df: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """(source, rank, target, similarity): exact cosine top k without the row itself, ties by target.

    Every row is a query against all rows, in blocks: the table is written to the shared folder in parts of about
    BLOCK_BYTES by a hash; a task takes queries of up to as many bytes, reads one part after another and keeps each
    query's k best so far. What a task holds is a part, its queries and TILE similarities, however large the table. Nothing
    goes through the driver, nothing is broadcast, and only the queries are dealt anew, once."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, width = n or 0, max(1, width or 1)
    parts, scale = max(1, -(-n * width * 4 // BLOCK_BYTES)), 10.0**digits
    table, path = shared.stored(rows.repartition(parts, F.xxhash64("id")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), "vectors", "part")
    held = max(1, BLOCK_BYTES // (4 * width))

    def unit_rows(column) -> np.ndarray:
        x = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-10)[:, None]
        return x

    def merged(row, name, whole, most: int, best) -> None:
        """The k best of each query into best: of what it holds and candidates (row, name, similarity as a whole number)."""
        names, sims = best
        own = np.unique(row)
        held_n, held_s = names[own], sims[own]
        row = np.concatenate([np.repeat(own, most), row])
        name, whole = np.concatenate([held_n.reshape(-1), name]), np.concatenate([held_s.reshape(-1), whole])
        order = np.lexsort((name, -whole, row))
        row, name, whole = row[order], name[order], whole[order]
        begin = np.searchsorted(row, own)
        at = begin[:, None] + np.arange(most)  # a query holds ``most`` places at least
        names[own], sims[own] = name[at], whole[at]

    def answer(own: np.ndarray, mine: np.ndarray):
        names, sims = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), -np.inf)
        for i in range(parts):
            part = shared.read_arrow(f"{path}/part={i}")
            if part is None:
                continue
            part = part.sort_by("id")
            ids, matrix = part.column("id").to_numpy(), unit_rows(part.column("v"))
            step = max(1, TILE // len(ids))
            for at in range(0, len(own), step):
                here = slice(at, min(at + step, len(own)))
                sim = mine[here] @ matrix.T
                sim *= scale
                sim[own[here, None] == ids[None, :]] = np.nan
                row, column = np.nonzero(sim >= sims[here, -1:] - 0.5)
                if len(row) > 8 * k * sim.shape[0] and len(ids) > k:  # too many to sort: a row's k best first, of equals the smaller ids
                    np.rint(sim, out=sim)
                    places = np.where(np.isfinite(sim), -sim, 3e9).astype(np.int64)
                    places <<= 31
                    places += np.arange(len(ids))
                    places.partition(k - 1, axis=1)
                    column = (places[:, :k] & ((1 << 31) - 1)).reshape(-1)
                    row = np.repeat(np.arange(sim.shape[0]), k)
                    whole = sim[row, column]
                    keep = np.isfinite(whole)
                    row, column, whole = row[keep], column[keep], whole[keep]
                else:
                    whole = np.rint(sim[row, column])
                    keep = np.isfinite(whole)
                    row, column, whole = row[keep], column[keep], whole[keep]
                if len(row):
                    merged(row + at, ids[column], whole, k, (names, sims))
        return names, sims / scale

    def run(batches):
        import pyarrow as pa

        def flush(own, mine):
            own, mine = np.concatenate(own), np.concatenate(mine)
            names, best = answer(own, mine)
            keep = np.isfinite(best).reshape(-1)
            rank = np.broadcast_to(np.arange(1, best.shape[1] + 1, dtype=np.int32), best.shape).reshape(-1)
            columns = [np.repeat(own, best.shape[1]), rank, names.reshape(-1), best.reshape(-1)]
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["source", "rank", "target", "similarity"])

        own, mine, size = [], [], 0
        for batch in batches:
            own.append(batch.column(0).to_numpy(zero_copy_only=False))
            mine.append(unit_rows(batch.column(1)))
            size += batch.num_rows
            if size >= held:
                yield flush(own, mine)
                own, mine, size = [], [], 0
        if size:
            yield flush(own, mine)

    asked = table.select("id", "v").repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))
    return asked.mapInArrow(run, "source long, rank int, target long, similarity double")


def neighbour_arrays(edges: DataFrame, meta: DataFrame, key: str, fills: dict[str, object]) -> DataFrame:
    """(source, neighbors): each source's neighbours by rank as structs with meta's columns, missing ones filled."""
    about = meta.withColumnRenamed(key, "target")
    columns = [c for c in about.columns if c != "target"]
    joined = edges.join(about, "target", "left").fillna(fills)
    return joined.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("target").alias("id"), *columns, "similarity"))).alias("neighbors"))


def explode_neighbours(arrays: DataFrame) -> DataFrame:
    """(source, rank from 1, id, similarity)."""
    return arrays.select("source", F.posexplode("neighbors").alias("pos", "x")).select("source", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.similarity").alias("similarity"))


def mean_vectors(df: DataFrame, group: str, vector: str, least: int = 3) -> DataFrame:
    """A10: (group, i, mean): elementwise means of groups with at least ``least`` rows."""
    long = df.select(group, F.posexplode(vector).alias("i", "v"))
    return long.groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")


def standardise(long: DataFrame, by: str, value: str, floor: float = 1e-10) -> DataFrame:
    """Z by column with the population deviation; one under the floor counts as 1."""
    w = Window.partitionBy(by)
    std = F.stddev_pop(value).over(w)
    return long.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(std < floor, 1.0).otherwise(std))
