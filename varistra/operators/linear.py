"""Linear models over vectors: sums of products by tiles, ridge regression with cross-validation, principal components.

A task turns its rows into sums of products or a triangular factor, whose size is that of the vector's width and not of
the rows; those meet by tile or up a tree. Nothing of the rows goes through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistra.sources import shared

#: Side of a tile of sums of products; rows that a task multiplies at once; triangular factors that one task joins.
TILE, ROWS, FAN = 256, 2048, 8


def matrix(column, width: int) -> np.ndarray:
    """A column of lists as rows of doubles; a list of another length, or with nulls, is an error."""
    from pyarrow import compute as pc

    lengths = pc.list_value_length(column)
    if len(column) and (pc.min_max(lengths).as_py() != {"min": width, "max": width} or column.flatten().null_count):
        raise ValueError(f"vectors must have {width} values, without nulls")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def width_of(df: DataFrame, vector: str) -> int:
    """The vectors' length, 0 for an empty table; different lengths are an error."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} values")
    return low or 0


def product_sums(df: DataFrame, vector: str, target: str, fold: Column) -> DataFrame:
    """(fold, ti, tj, tile): sums over a fold's rows of the products of all pairs of columns, by tiles of TILE x TILE with ti <= tj.

    The columns are the vector's values, the target and a constant 1, so the sums hold means and counts too. A task's
    rows come sorted by fold, so it holds one square matrix; tiles of all tasks are added up one after another. Rows with
    a null vector or target are left out."""
    rows = df.select(fold.cast("int").alias("fold"), F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y")).filter("v is not null and y is not null")
    width = width_of(rows, "v") + 2
    tiles = -(-width // TILE)

    def run(batches):
        import pyarrow as pa

        def tiles_of(fold, total):
            for i in range(tiles):
                for j in range(i, tiles):
                    yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total[i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE].reshape(-1)], pa.list_(pa.float64()))], ["fold", "ti", "tj", "tile"])

        now, total = None, None
        for batch in batches:
            folds, ys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = np.concatenate([matrix(batch.column(1), width - 2), ys[:, None], np.ones((len(ys), 1))], 1)
            for f in np.unique(folds):
                if f != now:
                    if total is not None:
                        yield from tiles_of(now, total)
                    now, total = int(f), np.zeros((width, width))
                own = x[folds == f]
                for at in range(0, len(own), ROWS):
                    total += own[at : at + ROWS].T @ own[at : at + ROWS]
        if total is not None:
            yield from tiles_of(now, total)

    def add(batches):
        import pyarrow as pa

        def row(key, tile):
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([tile], pa.list_(pa.float64()))], ["fold", "ti", "tj", "tile"])

        now, total = None, None
        for batch in batches:
            for *key, tile in zip(*(batch.column(i) for i in range(4))):
                key, tile = [k.as_py() for k in key], tile.values.to_numpy()
                if key != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = key, np.zeros(len(tile))
                total = total + tile
        if now is not None:
            yield row(now, total)

    schema = "fold int, ti int, tj int, tile array<double>"
    parts = rows.sortWithinPartitions("fold").mapInArrow(run, schema)
    return parts.repartition("fold", "ti", "tj").sortWithinPartitions("fold", "ti", "tj").mapInArrow(add, schema)


def product_entries(tiles: DataFrame, width: int) -> DataFrame:
    """(fold, i, j, s): the entries i <= j of the sums of products."""
    last = (width - 1) // TILE
    side = F.when(F.col("tj") == last, width - last * TILE).otherwise(TILE)
    out = tiles.select("fold", "ti", "tj", side.alias("side"), F.posexplode("tile").alias("pos", "s"))
    return out.select("fold", (F.col("ti") * TILE + F.floor(F.col("pos") / F.col("side"))).cast("int").alias("i"), (F.col("tj") * TILE + F.col("pos") % F.col("side")).cast("int").alias("j"), "s").filter("i <= j")


class Normal:
    """Sums of products of some rows: of the values (x), the target and 1."""

    def __init__(self, total: np.ndarray):
        self.n = total[-1, -1]
        self.xx, self.xy, self.yy, self.x, self.y = total[:-2, :-2], total[:-2, -2], total[-2, -2], total[:-2, -1], total[-2, -1]

    def scaled(self, mean: np.ndarray, deviation: np.ndarray, y_mean: float, y_deviation: float) -> Normal:
        """The sums that rows would have after standardising."""
        x = (self.x - self.n * mean) / deviation
        xx = (self.xx - np.outer(self.x, mean) - np.outer(mean, self.x) + self.n * np.outer(mean, mean)) / np.outer(deviation, deviation)
        y = (self.y - self.n * y_mean) / y_deviation
        xy = (self.xy - self.x * y_mean - mean * self.y + self.n * mean * y_mean) / deviation / y_deviation
        out = Normal.__new__(Normal)
        out.n, out.x, out.xx, out.y, out.xy = self.n, x, xx, y, xy
        out.yy = (self.yy - 2 * self.y * y_mean + self.n * y_mean**2) / y_deviation**2
        return out

    def fits(self, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a column of weights for each alpha, intercepts), by one eigendecomposition."""
        mean, y_mean = self.x / self.n, self.y / self.n
        values, vectors = np.linalg.eigh(self.xx - self.n * np.outer(mean, mean))
        along = vectors.T @ (self.xy - self.x * y_mean)
        weights = vectors @ (along[:, None] / (np.maximum(values, 0)[:, None] + alphas[None, :]))
        return weights, y_mean - mean @ weights

    def r2(self, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
        """R2 of each column of weights on these rows."""
        squares = self.yy - 2 * (weights.T @ self.xy + intercepts * self.y) + np.einsum("ia,ia->a", weights, self.xx @ weights) + 2 * intercepts * (weights.T @ self.x) + self.n * intercepts**2
        total = self.yy - self.y**2 / self.n
        return 1 - squares / total if total > 0 else np.full(len(intercepts), np.nan)


def ridge(df: DataFrame, vector: str, target: str, fold: Column, folds: int, alphas: list[float], floor: float = 1e-10) -> DataFrame:
    """(fold, alpha, r2, weights): ridge regression of a standardised target on standardised vectors, for a grid of alphas.

    fold is a number from 0 to folds - 1.

    A row for each fold and alpha has the R2 on that fold of the fit to the other folds (with an intercept); the row with
    fold null is the fit to all rows, for the alpha whose mean R2 over folds is the largest (the smaller alpha of equals), with that
    mean and the weights; weights are null elsewhere. A column whose deviation is under the floor counts as constant. One task a fold
    makes one eigendecomposition, from sums of products alone. An empty table, or a single fold, gives no rows."""
    width = width_of(df.filter(F.col(vector).isNotNull() & F.col(target).isNotNull()), vector) + 2
    tiles, _ = shared.stored(product_sums(df, vector, target, fold), "products")
    dealt = tiles.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("test"), "fold", "ti", "tj", "tile")  # every fold's task needs all sums
    grid = np.array(sorted(alphas))

    def sums(batches):
        """(test fold, sums of all rows, sums of the test fold) as squares."""
        now, whole, own = None, None, None
        for batch in batches:
            for test, f, i, j, tile in zip(*(batch.column(k) for k in range(5))):
                test, f, i, j = test.as_py(), f.as_py(), i.as_py(), j.as_py()
                if test != now:
                    if now is not None:
                        yield now, whole, own
                    now, whole, own = test, np.zeros((width, width)), np.zeros((width, width))
                rows, columns = (min(TILE, width - k * TILE) for k in (i, j))
                x = tile.values.to_numpy().reshape(rows, columns)
                for square in [whole, own] if f == test else [whole]:
                    square[i * TILE : i * TILE + rows, j * TILE : j * TILE + columns] += x
                    if i != j:
                        square[j * TILE : j * TILE + columns, i * TILE : i * TILE + rows] += x.T
        if now is not None:
            yield now, whole, own

    def standard(whole):
        total = Normal(whole)
        mean = total.x / total.n
        deviation = np.sqrt(np.maximum(np.diag(total.xx) / total.n - mean**2, 0))
        y_deviation = np.sqrt(max(total.yy / total.n - (total.y / total.n) ** 2, 0))
        return mean, np.where(deviation < floor, 1.0, deviation), total.y / total.n, y_deviation if y_deviation >= floor else 1.0

    schema = "fold int, alpha double, r2 double, weights array<double>"

    def score(batches):
        import pyarrow as pa

        for test, whole, own in sums(batches):
            if own[-1, -1] in (0, whole[-1, -1]):
                continue  # nothing to score, or nothing to fit
            by = standard(whole)
            fit = Normal(whole - own).scaled(*by).fits(grid)
            r2 = Normal(own).scaled(*by).r2(*fit)
            yield pa.RecordBatch.from_arrays([pa.array([test] * len(grid), pa.int32()), pa.array(grid), pa.array(r2), pa.nulls(len(grid), pa.list_(pa.float64()))], ["fold", "alpha", "r2", "weights"])

    scores, _ = shared.stored(dealt.repartition("test").sortWithinPartitions("test").mapInArrow(score, schema), "ridge")
    best = scores.groupBy("alpha").agg(F.avg("r2").alias("r2")).agg(F.max_by("alpha", F.struct("r2", -F.col("alpha"))).alias("alpha"), F.max("r2").alias("r2"))  # a row for each alpha

    def refit(batches):
        import pyarrow as pa

        chosen = []

        def noted():
            for batch in batches:
                if batch.num_rows and not chosen:
                    chosen.extend(batch.column(k)[0].as_py() for k in (5, 6))
                yield batch

        for _, whole, _ in sums(noted()):
            weights, _ = Normal(whole).scaled(*standard(whole)).fits(np.array(chosen[:1]))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array(chosen[:1]), pa.array(chosen[1:]), pa.array([weights[:, 0]], pa.list_(pa.float64()))], ["fold", "alpha", "r2", "weights"])

    one = tiles.select(F.lit(-1).alias("test"), "fold", "ti", "tj", "tile").join(F.broadcast(best.filter("alpha is not null")), F.lit(True))  # one row
    return scores.union(one.coalesce(1).mapInArrow(refit, schema))


def triangles(df: DataFrame, vector: str, width: int) -> DataFrame:
    """(node, r): a triangular factor of each task's rows of df, less the column means ``m`` that each row brings along."""

    def run(batches):
        import pyarrow as pa

        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), width) - matrix(batch.column(1).slice(0, 1), width)
                for at in range(0, len(x), ROWS):
                    r = np.linalg.qr(np.concatenate([r, x[at : at + ROWS]]), mode="r")
        if len(r):
            yield factor(TaskContext.get().partitionId(), r)

    return df.select(vector, "m").mapInArrow(run, "node long, r array<double>")


def factor(node: int, r: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.reshape(-1)], pa.list_(pa.float64()))], ["node", "r"])


def joined_triangles(rows: DataFrame, width: int) -> DataFrame:
    """One factor for each FAN of them; a task reads them one after another."""

    def run(batches):
        now, r = None, None
        for batch in batches:
            for node, flat in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = flat.values.to_numpy().reshape(-1, width)
                if node != now and r is not None:
                    yield factor(now, r)
                    r = None
                now, r = node, part if r is None else np.linalg.qr(np.concatenate([r, part]), mode="r")
        if r is not None:
            yield factor(now, r)

    up = rows.select(F.floor(F.col("node") / FAN).alias("node"), "r")
    return up.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, r array<double>")


def principal_components(df: DataFrame, vector: str, k: int = 50) -> DataFrame:
    """(component from 1, variance, share, mean, loadings): the first k principal components of the vectors.

    Two passes: column means, then a triangular factor of each task's centred rows; factors are joined in a tree, FAN at
    a time, and the last one's singular values and vectors are those of all rows. variance has the divisor n - 1, share
    is of the total; the largest loading of a component (the first of equals) is positive. Null vectors are left out; fewer than two rows, or an empty table,
    give no rows; there are at most as many components as rows or values."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    width = width_of(rows, "v")
    means = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    means, _ = shared.stored(means.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"), F.max("n").alias("n")), "means")  # one row
    n = means.first().n or 0
    if n < 2:
        return df.sparkSession.createDataFrame([], "component int, variance double, share double, mean array<double>, loadings array<double>")
    level, _ = shared.stored(triangles(rows.join(F.broadcast(means.select("m")), F.lit(True)), "v", width), "factors")  # beside one row
    while level.count() > 1:
        level, _ = shared.stored(joined_triangles(level, width), "factors")

    def decompose(batches):
        import pyarrow as pa

        for batch in batches:
            for flat, mean in zip(batch.column(0), batch.column(1)):
                _, s, vt = np.linalg.svd(flat.values.to_numpy().reshape(-1, width), full_matrices=False)
                some = min(k, len(s), n)
                at = np.argmax(np.abs(vt[:some]) > np.abs(vt[:some]).max(1, keepdims=True) * (1 - 1e-9), axis=1)
                vt = vt[:some] * np.where(vt[np.arange(some), at] < 0, -1.0, 1.0)[:, None]
                variance, total = s[:some] ** 2 / (n - 1), float((s**2).sum()) / (n - 1)
                share = variance / total if total > 0 else np.zeros(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, some + 1, dtype=np.int32)), pa.array(variance), pa.array(share), pa.array([mean.as_py()] * some, pa.list_(pa.float64())), pa.array(list(vt), pa.list_(pa.float64()))], ["component", "variance", "share", "mean", "loadings"])

    last = level.select("r").join(F.broadcast(means.select("m")), F.lit(True))
    return last.mapInArrow(decompose, "component int, variance double, share double, mean array<double>, loadings array<double>")


def projected(df: DataFrame, vector: str, components: DataFrame) -> DataFrame:
    """df with ``scores``: its vectors along the components; null for a null vector. Components are a row each, k at most."""
    table = components.groupBy().agg(F.array_sort(F.collect_list(F.struct("component", "loadings"))).alias("pc_all"), F.first("mean").alias("pc_mean"))  # one row
    centred = F.zip_with(F.col(vector), "pc_mean", lambda a, b: a.cast("double") - b)
    score = lambda c: F.aggregate(F.zip_with("pc_x", c["loadings"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    both = df.join(F.broadcast(table), F.lit(True)).withColumn("pc_x", centred)
    return both.withColumn("scores", F.when(F.col("pc_x").isNotNull(), F.transform("pc_all", score))).drop("pc_all", "pc_mean", "pc_x")
