"""Ridge regression, principal components and clustering against dense computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistra.operators import clustering, linear

VECTORS = "id long, v array<double>, y double, g string"


def table(spark, n=200, width=7, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.arange(1, width + 1) + 3
    x[:, -1] = 2.5  # a constant column
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
    rows = [(i, x[i].tolist(), float(y[i]), f"g{i % 3}") for i in range(n)]
    return x, y, spark.createDataFrame([*rows, (n, None, 1.0, "g0"), (n + 1, x[0].tolist(), None, None)], VECTORS).repartition(5)


@pytest.mark.parametrize("tile", [256, 3])
def test_ridge_equals_dense_fits(spark, monkeypatch, tile):
    monkeypatch.setattr(linear, "TILE", tile)
    x, y, df = table(spark)
    alphas = [0.01, 1.0, 50.0, 1e4]
    got = linear.ridge(df, "v", "y", F.pmod("id", F.lit(4)), 4, alphas).collect()
    sd = x.std(0)
    xs, ys = (x - x.mean(0)) / np.where(sd < 1e-10, 1, sd), (y - y.mean()) / y.std()
    r2 = {}
    for f in range(4):
        test = np.arange(len(y)) % 4 == f
        a, b, ya, yb = xs[~test], xs[test], ys[~test], ys[test]
        for alpha in alphas:
            w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(x.shape[1]), (a - a.mean(0)).T @ (ya - ya.mean()))
            fit = (b - a.mean(0)) @ w + ya.mean()
            r2[f, alpha] = 1 - ((yb - fit) ** 2).sum() / ((yb - yb.mean()) ** 2).sum()
    assert {(r.fold, r.alpha): pytest.approx(r.r2, abs=1e-9) for r in got if r.fold is not None} == r2
    (best,) = [r for r in got if r.fold is None]
    means = {alpha: np.mean([r2[f, alpha] for f in range(4)]) for alpha in alphas}
    assert best.alpha == max(means, key=means.get) and best.r2 == pytest.approx(means[best.alpha])
    assert best.weights == pytest.approx(np.linalg.solve(xs.T @ xs + best.alpha * np.eye(x.shape[1]), xs.T @ ys).tolist(), abs=1e-9)
    assert linear.ridge(df.limit(0), "v", "y", F.lit(0), 2, alphas).count() == 0


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0, "g"), (2, [1.0], 2.0, "g")], VECTORS)
    for run in (lambda: linear.ridge(df, "v", "y", F.lit(0), 2, [1.0]), lambda: linear.principal_components(df, "v")):
        with pytest.raises(ValueError):
            run()


def test_components_equal_dense_svd(spark):
    x, _, df = table(spark, 300)
    df = df.filter("id < 300").repartition(20)  # more factors than one task joins
    got = linear.principal_components(df, "v", 4).orderBy("component").collect()
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert [r.variance for r in got] == pytest.approx((s[:4] ** 2 / 299).tolist(), rel=1e-9)
    assert sum(r.share for r in got) == pytest.approx((s[:4] ** 2).sum() / (s**2).sum())
    for r, v in zip(got, vt):
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert r.loadings == pytest.approx(v.tolist(), abs=1e-8)
    scores = {r.id: r.scores for r in linear.projected(df, "v", linear.principal_components(df, "v", 4)).collect()}
    assert np.allclose(np.array([scores[i] for i in range(300)]) @ np.array([r.loadings for r in got]), (x - x.mean(0)) @ np.array([r.loadings for r in got]).T @ np.array([r.loadings for r in got]), atol=1e-8)
    assert linear.principal_components(df.limit(0), "v").count() == 0 and linear.principal_components(df.filter("id = 1"), "v").count() == 0


def merges_by_hand(d, method):
    """Closest pair first, distances updated by Lance and Williams' formula."""
    n = len(d)
    parts = {i: [i] for i in range(n)}
    dist = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
    out = []
    for step in range(n - 1):
        (a, b), h = min(dist.items(), key=lambda e: e[1])
        na, nb = len(parts[a]), len(parts[b])
        new = {}
        for k in parts:
            if k not in (a, b):
                x, y, nk = dist[min(a, k), max(a, k)], dist[min(b, k), max(b, k)], len(parts[k])
                new[k] = (na * x + nb * y) / (na + nb) if method == "average" else np.sqrt(((na + nk) * x * x + (nb + nk) * y * y - nk * h * h) / (na + nb + nk))
        dist = {e: v for e, v in dist.items() if a not in e and b not in e}
        parts[n + step] = parts.pop(a) + parts.pop(b)
        dist |= {(k, n + step): v for k, v in new.items()}
        out.append((frozenset(parts[n + step]), h))
    return out


@pytest.mark.parametrize("method", ["average", "ward"])
def test_trees_equal_brute_force(spark, method):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=5).tolist(), None, "ab"[i % 2] if i < 60 else None) for i in rng.permutation(63)] + [(99, [0.0] * 5, None, "z"), (100, None, None, "a")]
    tree = clustering.hierarchy(spark.createDataFrame(rows, VECTORS), "g", "id", "v", method)
    found = tree.collect()
    for g in ("a", "b", None, "z"):
        members = sorted((i, v) for i, v, _, x in rows if x == g and v)
        d = clustering.cosine_distances(np.array([v for _, v in members]), block=4)
        unit = np.array([v for _, v in members]) / np.maximum(np.linalg.norm([v for _, v in members], axis=1, keepdims=True), 1e-10)
        assert np.allclose(d, np.clip(1 - unit @ unit.T, 0, None) * (1 - np.eye(len(members))))
        want = merges_by_hand(d, method)
        parts, n = {i: frozenset([i]) for i in range(len(members))}, len(members)
        own = sorted((r for r in found if r.g == g and r.kind == "merge"), key=lambda r: r.place)
        for r in own:
            parts[n + r.place] = parts[r.left] | parts[r.right]
            assert r.size == len(parts[n + r.place])
        assert [parts[n + r.place] for r in own] == [w for w, _ in want] and [r.height for r in own] == pytest.approx([h for _, h in want])
        leaves = sorted((r for r in found if r.g == g and r.kind == "leaf"), key=lambda r: r.place)
        assert sorted(r.key for r in leaves) == [i for i, _ in members]
        at = {r.left: r.place for r in leaves}
        assert all(max(at[i] for i in p) - min(at[i] for i in p) == len(p) - 1 for p in parts.values())  # every part stands together
        for k in (1, 3, n):
            got = {r.key: r.cluster for r in clustering.cut(tree, "g", k).filter(F.col("g").eqNullSafe(F.lit(g))).collect()}
            tops = set(parts.values()) if k == n else {frozenset(p) for p in parts.values()}
            left = [frozenset(i for i in range(n) if got[members[i][0]] == c) for c in set(got.values())]
            assert len(left) == min(k, n) and all(p in tops for p in left)


def test_a_group_too_large_is_an_error(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], None, "g") for i in range(5)], VECTORS)
    with pytest.raises(Exception, match="a group of 5 members"):
        clustering.hierarchy(df, "g", "id", "v", most=4).collect()
    assert clustering.hierarchy(df.limit(0), "g", "id", "v").count() == 0


def test_merges_from_vectors_equal_those_from_distances():
    import tracemalloc

    from varistra.operators import clustering

    rng = np.random.default_rng(8)
    for n, width in ((1, 5), (2, 5), (3, 2), (60, 3), (300, 8), (300, 64)):
        x = rng.normal(size=(n, width)) + rng.normal(size=width)
        for method in ("average", "ward"):
            want = clustering.chain_merges(clustering.cosine_distances(x), method)
            got = clustering.vector_merges(x, method)
            assert [m[:2] + m[3:] for m in got] == [m[:2] + m[3:] for m in want]
            assert np.allclose([m[2] for m in got], [m[2] for m in want], atol=1e-9)
    alike = np.concatenate([np.tile(x[:1], (50, 1)), np.zeros((5, width)), x[1:40]])
    assert np.allclose([m[2] for m in clustering.vector_merges(alike, "average")], [m[2] for m in clustering.chain_merges(clustering.cosine_distances(alike), "average")], atol=1e-7)
    tracemalloc.start()
    clustering.vector_merges(rng.normal(size=(1600, 8)), "average")
    assert tracemalloc.get_traced_memory()[1] < 4 * (clustering.BLOCK_BYTES + (1 << 20))  # distances' blocks, not a multiple of the matrix
    tracemalloc.stop()
