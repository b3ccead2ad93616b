"""Forward tests against brute force on small versions of groups."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistra.functions import special
from varistra.operators import forward, resample


def versions(seed=4):
    rng = np.random.default_rng(seed)
    old = [(g, int(m)) for g in range(12) for m in rng.choice(40, 4, replace=False)]
    new = old + [(g, int(m)) for g in range(8, 25) for m in rng.choice(45, 5, replace=False)]
    return old, new


def pairs_by_hand(old, new, universe):
    made = lambda rows: {(a, b) for g in {g for g, _ in rows} for a, b in combinations(sorted({m for h, m in rows if h == g and m in universe}), 2)}
    o, n = made(old), made(new)
    return {(a, b, "old") for a, b in o} | {(a, b, "novel") for a, b in n - o}


def test_pairs_and_controls(spark):
    old, new = versions()
    universe = list(range(3, 40))
    df = lambda rows: spark.createDataFrame(rows, "g int, m long")
    nodes = spark.createDataFrame([(i,) for i in universe], "m long")
    pairs = forward.versioned_pairs(df(old), df(new), "g", "m", nodes)
    want = pairs_by_hand(old, new, set(universe))
    assert {tuple(r) for r in pairs.collect()} == want
    both = [tuple(r) for r in forward.with_controls(pairs, nodes, "m", 5).collect()]
    controls, positive = [(a, b) for a, b, kind in both if kind == "random"], {(a, b) for a, b, _ in want}
    novel = [(a, b) for a, b, kind in want if kind == "novel"]
    assert len(controls) == len(novel) and not set(controls) & positive and all(a < b and {a, b} <= set(universe) for a, b in controls)
    drawn = []
    for a, b in novel:
        for t in range(forward.TRIES):
            other = universe[int(resample.draws(5, a, b, t)) % len(universe)]
            if other != a and (min(a, other), max(a, other)) not in positive:
                drawn.append((min(a, other), max(a, other)))
                break
    assert sorted(drawn) == sorted(controls)
    none = forward.with_controls(forward.versioned_pairs(df(old), df(old), "g", "m", nodes), nodes, "m", 5)
    assert none.filter("kind <> 'old'").count() == 0


def test_features_of_new_groups(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    x[:6, 2] += 4  # the members of the new group 9 stand out in one feature
    old = [(g, m) for g in range(3) for m in range(10 * g + 10, 10 * g + 20)]
    new = old + [(9, m) for m in range(6)] + [(10, m) for m in range(50, 60)] + [(11, 1), (11, 2)]
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id int, v array<double>")
    df = lambda rows: spark.createDataFrame(rows, "g int, m int")
    got = {r.g: r for r in forward.new_group_features(df(old), df(new), "g", "m", vectors, "id", 3).collect()}
    assert set(got) == {9, 10}
    for g, members in ((9, range(6)), (10, range(50, 60))):
        inside = np.isin(np.arange(60), list(members))
        a, b = x[inside], x[~inside]
        va, vb = a.var(0, ddof=1) / len(a), b.var(0, ddof=1) / len(b)
        t, dof = (a.mean(0) - b.mean(0)) / np.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
        p = np.array([special.t_two_sided(float(s), float(d)) for s, d in zip(t, dof)])
        order = np.argsort(p)
        fdr = np.empty(5)
        fdr[order] = np.minimum.accumulate((p[order] * 5 / np.arange(1, 6))[::-1])[::-1]
        hit = fdr < 0.05
        assert (got[g].members, got[g].n_sig) == (len(a), hit.sum())
        assert got[g].mean_abs_effect == pytest.approx(np.abs(a.mean(0) - b.mean(0))[hit].mean() if hit.any() else 0)
    assert got[9].n_sig >= 1


def test_scores_of_kinds(spark):
    rows = [(1, 2, "novel", 0.9), (1, 3, "novel", 0.4), (2, 3, "random", 0.4), (4, 5, "random", 0.1), (5, 6, "old", 0.2), (6, 7, "old", None)]
    r = forward.compare_kinds(spark.createDataFrame(rows, "a int, b int, kind string, score double")).first()
    assert (r.novel_n, r.old_n, r.random_n, r.u) == (2, 1, 2, 3.5) and r.rank_biserial == pytest.approx(1 - 7 / 4)
    assert r.cohens_d == pytest.approx((0.65 - 0.25) / math.sqrt((0.125 + 0.045) / 2))
    v = spark.createDataFrame([([3.0, 0.0], [0.0, 2.0], [3.0, 4.0], [0.0, 0.0])], "x array<double>, y array<double>, z array<double>, o array<double>")
    s = v.select(forward.cosine(F.col("x"), F.col("y")), forward.cosine(F.col("x"), F.col("z")), forward.cosine(F.col("x"), F.col("o")), forward.weighted_sum(F.array(F.lit(1.0), F.lit(3.0)))(F.col("x"), F.col("z"))).first()
    assert list(s) == pytest.approx([0.0, 0.6, 0.0, (6 + 12) / 4])
