"""Hierarchical clustering of the members of groups: merges, leaf order and cuts, each group in the task that owns it.

Merges are found without a sorted list of pairs, in the square of a group's size steps: those of small groups by chains of
nearest neighbours in a matrix of distances, those of larger ones from the vectors alone, in memory that grows with the group's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members of a group whose distances are held as a matrix (of 8 * n * n bytes, a few times), and bytes of a block of distances otherwise.
MATRIX = 1500
BLOCK_BYTES = 16 << 20


def cosine_distances(x: np.ndarray, block: int = 1024) -> np.ndarray:
    """1 - cosine of all pairs of rows in single blocks of rows, 0 on the diagonal; a zero row has cosine 0 with all others."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(length < 1e-10, 1.0, length)
    out = np.empty((len(x), len(x)))
    for at in range(0, len(x), block):
        out[at : at + block] = np.maximum(1 - x[at : at + block] @ x.T, 0)
    out = (out + out.T) / 2
    np.fill_diagonal(out, 0)
    return out


def chain_merges(d: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) in rising order of height: leaves are 0 to n - 1, the merge in place i is n + i.

    From any cluster on, each step goes to the nearest neighbour (of equals first the one just left, then the one with
    the smallest leaf); two that are each other's nearest are merged. Average and Ward never make a merge lower than those
    below it, so the merges found in any order are those of the usual one. d is overwritten."""
    n = len(d)
    d = d.astype(np.float64)
    np.fill_diagonal(d, np.inf)
    size, alive, found, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        keep, gone, height = min(a, b), max(a, b), d[a, b]
        ni, nj = size[keep], size[gone]
        others = alive.copy()
        others[[keep, gone]] = False
        x, y, nk = d[keep, others], d[gone, others], size[others]
        new = (ni * x + nj * y) / (ni + nj) if method == "average" else np.sqrt(np.maximum(((ni + nk) * x**2 + (nj + nk) * y**2 - nk * height**2) / (ni + nj + nk), 0))
        d[keep, others] = d[others, keep] = new
        alive[gone] = False
        size[keep] += nj
        found.append((keep, gone, float(height), int(size[keep])))
    # by height; clusters are known by their smallest leaf until then
    name, out = list(range(n)), []
    for place, i in enumerate(sorted(range(n - 1), key=lambda i: (found[i][2], i))):
        keep, gone, height, total = found[i]
        out.append((min(name[keep], name[gone]), max(name[keep], name[gone]), height, total))
        name[keep] = n + place
    return out


class Clusters:
    """Clusters of vectors, and a cluster's distances from all others, worked out from the vectors: average, or Ward's on cosine distances.

    Average: 1 - the product of the mean unit vectors. Ward: with D the squares of the distances, 2ab/(a + b) times (mean D
    between both - half of each one's mean D within), which is what its update by merges comes to for any D; D between a
    cluster and a point is a sum over the cluster's vectors or, for large clusters, a form with their product matrix."""

    def __init__(self, x: np.ndarray, method: str):
        length = np.linalg.norm(x, axis=1, keepdims=True)
        self.unit = x / np.where(length < 1e-10, 1.0, length)
        self.ward, n = method == "ward", len(x)
        self.size, self.alive, self.within = np.ones(n), np.ones(n, bool), np.zeros(n)
        self.mean = None if self.ward else self.unit.copy()
        self.of, self.members = np.arange(n), [np.array([i]) for i in range(n)] if self.ward else None

    def rows(self, some: np.ndarray) -> np.ndarray:
        """Distances of some clusters (rows) from all; infinite for itself and for those that are gone."""
        n = len(self.size)
        if not self.ward:
            out = np.maximum(1 - self.mean[some] @ self.mean.T, 0)
        elif all(len(self.members[c]) == 1 for c in some):
            between = np.zeros((len(some), n))
            d = np.maximum(1 - self.unit[[self.members[c][0] for c in some]] @ self.unit.T, 0) ** 2
            for i in range(len(some)):
                between[i] = np.bincount(self.of, d[i], n)
            out = self.height(some, between)
        else:
            out = self.height(some, np.stack([np.bincount(self.of, self.to_points(c), n) for c in some]))
        out[:, ~self.alive] = np.inf
        out[np.arange(len(some)), some] = np.inf
        return out

    def to_points(self, c: int) -> np.ndarray:
        """Sums of squared distances of all points from a cluster's members."""
        u, own = self.unit, self.unit[self.members[c]]
        if len(own) > u.shape[1]:
            return np.maximum(len(own) - 2 * (u @ own.sum(0)) + np.einsum("ij,ij->i", u @ (own.T @ own), u), 0)
        out = np.zeros(len(u))
        for at in range(0, len(own), 8):
            out += (np.maximum(1 - u @ own[at : at + 8].T, 0) ** 2).sum(1)
        return out

    def height(self, some: np.ndarray, between: np.ndarray) -> np.ndarray:
        a, b = self.size[some][:, None], self.size[None, :]
        ya, yb = (self.within[some] / self.size[some] ** 2)[:, None], (self.within / self.size**2)[None, :]
        return np.sqrt(np.maximum(2 * a * b / (a + b) * (between / (a * b) - ya - yb), 0))

    def join(self, keep: int, gone: int, height: float) -> None:
        a, b = self.size[keep], self.size[gone]
        if self.ward:  # within: the sum over unordered pairs
            both = (height**2 * (a + b) / (2 * a * b) + self.within[keep] / a**2 + self.within[gone] / b**2) * a * b
            self.within[keep] += self.within[gone] + both
            self.of[self.members[gone]] = keep
            self.members[keep], self.members[gone] = np.concatenate([self.members[keep], self.members[gone]]), None
        else:
            self.mean[keep] = (a * self.mean[keep] + b * self.mean[gone]) / (a + b)
        self.size[keep] = a + b
        self.alive[gone] = False


def vector_merges(x: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """The merges of ``chain_merges`` from the vectors, without a matrix of all distances.

    Each cluster knows its nearest one and how far that was. No merge brings clusters nearer than the merged ones were, so that number
    stays a lower bound: the cluster with the smallest one is merged with its nearest if that is unchanged, and looks anew
    otherwise, together with the next few whose nearest has changed."""
    n = len(x)
    clusters, found = Clusters(x, method), []
    some = max(1, BLOCK_BYTES // (8 * max(1, n)))
    least, near, changed, seen = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def look(which: np.ndarray) -> None:
        for at in range(0, len(which), some):
            own = which[at : at + some]
            d = clusters.rows(own)
            near[own] = d.argmin(1)
            least[own] = d[np.arange(len(own)), near[own]]
            seen[own] = changed[near[own]]

    look(np.arange(n))
    name = list(range(n))
    for place in range(n - 1):
        while True:
            a = int(np.argmin(least))
            if clusters.alive[near[a]] and seen[a] == changed[near[a]]:
                break
            stale = np.flatnonzero(clusters.alive & ~(clusters.alive[near] & (seen == changed[near])))
            few = min(8, len(stale))
            look(stale[np.argpartition(least[stale], few - 1)[:few]] if few < len(stale) else stale)
        b, height = int(near[a]), float(least[a])
        keep, gone = min(a, b), max(a, b)
        clusters.join(keep, gone, height)
        least[gone] = np.inf
        changed[keep] += 1
        found.append((min(name[keep], name[gone]), max(name[keep], name[gone]), height, int(clusters.size[keep])))
        name[keep] = n + place
        if place < n - 2:
            look(np.array([keep]))
    # rounding may make a merge lower than one before it by its last digits
    heights = np.maximum.accumulate([m[2] for m in found]) if found else []
    return [(*m[:2], float(h), m[3]) for m, h in zip(found, heights)]


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[tuple[int, int | None]]:
    """(leaf, merge that joins it with the leaf before it) from left to right, a merge's left part first."""
    stack, out = [(2 * n - 2, None)] if n else [], []
    while stack:
        i, joint = stack.pop()
        if i < n:
            out.append((i, joint))
        else:
            left, right, _, _ = merges[i - n]
            stack += [(right, i - n), (left, joint)]
    return out


def hierarchy(df: DataFrame, group: str, key: str, vector: str, method: str = "average", most: int | None = None) -> DataFrame:
    """A row for each merge and each leaf of each group's tree over cosine distances.

    (group, kind 'merge', place from 0, left, right, height, size) with leaves numbered by rising key and merges after
    them, and (group, kind 'leaf', place in leaf order, left: its number, right: the place of the merge that joins it with the leaf
    before it, key). method: average, or ward (on the distances
    as they are). A group is worked out in one task, in memory that grows with its members' vectors, since each merge depends on
    those before it; its time grows with the square of its members. With ``most``, a group of more members is an error. Null vectors and null keys are left out, null groups are a group; repeated keys
    are leaves of their own."""
    kinds = dict(df.dtypes)
    rows = df.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and v is not null")

    def run(table):
        import pyarrow as pa

        if most is not None and table.num_rows > most:
            raise ValueError(f"a group of {table.num_rows} members; the most is {most}")
        table = table.sort_by("key")
        keys, lists = table.column("key").to_pylist(), table.column("v").combine_chunks()
        lengths = set(np.diff(lists.offsets.to_numpy()).tolist())
        if len(lengths) > 1:
            raise ValueError(f"vectors of lengths {sorted(lengths)}")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
        merges = chain_merges(cosine_distances(x), method) if len(x) <= MATRIX else vector_merges(x, method)
        n, k = len(keys), len(merges)
        order = leaf_order(merges, n)
        columns = {
            "grp": pa.array([table.column("grp")[0].as_py()] * (k + n), table.schema.field("grp").type),
            "kind": pa.array(["merge"] * k + ["leaf"] * n),
            "place": pa.array([*range(k), *range(n)], pa.int32()),
            "left": pa.array([m[0] for m in merges] + [i for i, _ in order], pa.int32()),
            "right": pa.array([m[1] for m in merges] + [joint for _, joint in order], pa.int32()),
            "height": pa.array([m[2] for m in merges] + [None] * n, pa.float64()),
            "size": pa.array([m[3] for m in merges] + [1] * n, pa.int32()),
            "key": pa.array([None] * k + [keys[i] for i, _ in order], pa.int64()),
        }
        return pa.table(columns)

    out = rows.groupBy("grp").applyInArrow(run, f"grp {kinds[group]}, kind string, place int, left int, right int, height double, size int, key long")
    return out.withColumnRenamed("grp", group)


def cut(tree: DataFrame, group: str, clusters: int) -> DataFrame:
    """(group, key, cluster from 1 in leaf order): what is left of the tree without its clusters - 1 last merges."""
    leaves = tree.filter("kind = 'leaf'")
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    parted = leaves.withColumn("parted", F.when(F.col("right") >= n - clusters, 1).otherwise(0))
    return parted.select(group, "key", (F.sum("parted").over(Window.partitionBy(group).orderBy("place")) + 1).cast("int").alias("cluster"))
