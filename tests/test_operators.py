"""Edge cases and properties of the operators on small tables."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varistra.functions import scalar as S
from varistra.functions import special
from varistra.operators import hist, pairs, relational as R, resample, schema, stats, vectors as V
from varistra.sources import shared

NAN = float("nan")


def one(spark, column, value, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", -0.04), ("a", 0.0), ("a", 0.05), ("a", 1.0), ("a", 7.0), ("a", NAN), ("a", None), ("b", None)], "k string, v double")
    got = {(r.k, r.bin): (r.frac, r.total) for r in hist.histogram(df, ["k"], "v", 20).collect()}
    assert got == {("a", 0): (0.4, 5), ("a", 1): (0.2, 5), ("a", 19): (0.4, 5)}
    assert sum(hist.dense_histogram(df, "k", "v", 4).first().hist) == pytest.approx(1)


def test_heatmap_needs_more_than_ten(spark):
    rows = [(0.15, 0.25, i % 2) for i in range(10)]
    make = lambda r: hist.heatmap(spark.createDataFrame(r, "x double, y double, p int"), [], "x", "y", F.col("p") == 1).collect()
    assert make(rows) == []
    assert [tuple(r) for r in make([*rows, (0.15, 0.25, 1), (NAN, 0.2, 1)])] == [(1, 2, 11, 54.5)]


def test_head_stats_and_z(spark):
    long = spark.createDataFrame([("flat", 2.0)] * 11 + [("few", 1.0)] * 10 + [("all_nan", NAN)] * 20, "head string, value double")
    s = hist.head_stats(long)
    assert [(r.head, r.std) for r in s.collect()] == [("flat", 0.0)]
    assert {r.z for r in hist.abs_z(long, s).collect()} == {None}


@pytest.mark.parametrize("value, want", [(None, "Not observed"), (0.0, "Not observed"), (0.0000810, "1 in 12,346"), (0.012, "1.2%")])
def test_frequency_text(spark, value, want):
    assert one(spark, S.frequency_text, value) == want


@pytest.mark.parametrize("value, want", [(None, None), (0.0, None), (5e-5, "ultra-rare"), (0.06, "common"), (0.02, "low-frequency"), (0.005, None)])
def test_frequency_band(spark, value, want):
    assert one(spark, S.frequency_band, value) == want


def test_text_scalars(spark):
    t = lambda f, v: one(spark, f, v, "string")
    assert t(lambda c: S.list_json(c, exclude=("not provided",)), "a; b ;;Not provided") == '["a","b"]' and t(S.list_json, None) == "[]"
    assert [tuple(d) for d in t(lambda c: S.domains(c, ("x",)), "p:1:2,x:3,bad")] == [("p", "1:2")] and t(S.domains, None) == []
    assert t(S.slug, "  Hello, World! ") == "hello_world" and len(t(S.slug, "ab " * 60)) == 60
    assert t(S.contig, "chrM") == "MT" and t(S.contig, "CHR7") == "7" and t(S.after_last, "a:b:c.1") == "c.1"
    assert t(S.fnv1a_hex, "a") == "af63dc4c8601ec8c" and t(S.fnv1a_hex, None) is None
    assert t(lambda c: S.display_enum(c, {"x": "Y"}), "missense_variant") == "Missense Variant"


def test_number_scalars(spark):
    assert one(spark, S.tier, 0.9) == "high" and one(spark, S.tier, None) is None and one(spark, S.quartile_bin, NAN) == "missing"
    assert one(spark, S.clamp01, None) == 0.5 and one(spark, lambda c: S.likelihood(c, F.lit(0.0)), 0.0) == 0.5
    assert "96" in one(spark, S.calibration_text, 1.0) or "97" in one(spark, S.calibration_text, 1.0)
    assert one(spark, lambda c: S.decode_class(c, S.swap_classes()), 379, "int") == "Y>W" and one(spark, lambda c: S.decode_class(c, ["a"]), -1, "int") is None
    assert sum(one(spark, lambda c: S.soft_bins(c, 5, 0.3), 0.4)) == pytest.approx(1)


def test_schema(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, score_a double, ref_score_a double, ref_pred double")
    kept = schema.filter_heads(df, ("score_", "ref_score_"), set())
    assert kept.columns == ["id", "ref_pred"]
    assert schema.rewrite_prefixes(df, {"score_": "eff_", "ref_score_": "ref_"}, "gt_").columns == ["id", "eff_a", "ref_a", "ref_pred"]
    assert schema.rewrite_prefixes(spark.createDataFrame([(1, 2)], "score_a int, eff_a int"), {"score_": "eff_"}, "gt_").columns == ["eff_a", "gt_eff_a"]
    with pytest.raises(ValueError):
        schema.require_clean(spark.createDataFrame([(NAN,)], "x double"), ["x"])
    with pytest.raises(ValueError):
        schema.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    assert schema.drop_degenerate(spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.0, None)], "a double, b double, c double"), ["a", "b", "c"]).columns == ["a"]


def test_band_join_is_exact(spark):
    rng = np.random.default_rng(1)
    a, b = ([(int(k), int(p), i) for i, (k, p) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-50, 50, 200)))] for _ in range(2))
    for r in (0, 1, 7):
        x, y = spark.createDataFrame(a, "k int, pa long, ia int"), spark.createDataFrame(b, "k int, pb long, ib int")
        got = {(q.ia, q.ib) for q in R.band_join(x, y, ["k"], "pa", "pb", r).collect()}
        assert got == {(i, j) for k, p, i in a for m, q, j in b if k == m and abs(p - q) <= max(1, r)}


def test_bh_and_ranks(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.5])], "id int, p double")
    got = {r.id: r.fdr for r in R.benjamini_hochberg(df, "p", "id").collect()}
    assert got == pytest.approx({0: 0.05, 1: 0.2 / 3, 2: 0.2 / 3, 3: 0.5, 4: 0.5})
    assert sorted(r.rk for r in R.average_rank(df, "p", [], "rk").collect()) == [1, 2, 3, 4.5, 4.5]


def test_search_and_locus(spark):
    df = spark.createDataFrame([(1, "BRCA1", 0.5, 10), (2, "BRCA10", 0.9, 12), (3, "brca1", 0.7, 900), (4, None, 1.0, 11)], "id int, g string, s double, pos long")
    assert [r.id for r in R.tiered_search(df, "g", "Brca1", "s", "id").collect()] == [3, 1, 2]
    near = R.locus_range(df.withColumn("c", F.lit("1")), "c", "pos", "id", ("1", 11), 0, 99, 4)
    assert [(r.id, r.distance) for r in near.collect()] == [(1, 1), (2, 1)]


def test_group_pairs_in_blocks(spark):
    m = spark.createDataFrame([(g, i) for g, n in ((1, 40), (2, 6), (3, 1)) for i in range(100 * g, 100 * g + n)] + [(1, 100), (2, 100)], "g int, m int")
    whole = {(r.a, r.b) for r in R.group_pairs(m, "g", "m").collect()}
    assert len(whole) == 40 * 39 // 2 + 7 * 6 // 2
    for block in (1, 5, 39):
        got = R.group_pairs(m, "g", "m", block=block).collect()
        assert len(got) == len(whole) and {(r.a, r.b) for r in got} == whole


def test_neighbours_ties_zero_and_blocks(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    whole = sorted(map(tuple, V.neighbours(df, "id", "v", 3).collect()))
    monkeypatch.setattr(V, "BLOCK_BYTES", 16)
    assert whole == sorted(map(tuple, V.neighbours(df, "id", "v", 3).collect()))
    assert [(s, r, t) for s, r, t, _ in whole if s == 1] == [(1, 1, 2), (1, 2, 5), (1, 3, 3)]
    assert all(s != t for s, _, t, _ in whole)


def test_correlation_guards(spark):
    rows = [("ok", float(i), float(i * 2)) for i in range(60)] + [("flat", 1.0, float(i)) for i in range(60)] + [("few", float(i), float(i)) for i in range(49)]
    got = {r.k: r.r for r in stats.guarded_corr(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["flat"] is None and got["few"] is None and got["ok"] == pytest.approx(1)


def test_eval_binary(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "p double, y int")
    r = stats.eval_binary(df, [], "p", "y").first()
    assert r.auc == pytest.approx((3 + 0.5 + 1) / 6) and r.accuracy == pytest.approx(3 / 5) and r.f1 == pytest.approx(2 * 2 / (2 * 2 + 2))
    assert stats.eval_binary(df.filter("y = 0"), [], "p", "y").first().auc is None


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.gammaincc(1.5, 3.0) == pytest.approx(0.1116102, abs=1e-6)
    assert special.fisher_greater(8, 2, 1, 5) == pytest.approx(0.02447552, abs=1e-7)
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_mann_whitney_and_welch(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False), (2.0, False)], "v double, f boolean")
    r = stats.mann_whitney(df, "v", F.col("f")).first()
    assert (r.n1, r.n2, r.u) == (2, 3, 0.5) and r.rank_biserial == pytest.approx(1 - 1 / 6)
    g = stats.welch(spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 3, "g string, v double"), "g", "v").collect()
    assert {x.t for x in g} == {None}


def test_controls_differ_and_match(spark):
    t = spark.createDataFrame([(i % 3, i) for i in range(60)] + [(9, 100)], "b int, id int")
    got = resample.matched_controls(t, t, ["b"], "id", 1).collect()
    assert len(got) == 60 and all(r.control != r.id and r.control % 3 == r.id % 3 for r in got)


def test_bootstrap_split_permutation(spark):
    df = spark.createDataFrame([(g, float(g % 7)) for g in range(200)], "g int, v double")
    r = resample.bootstrap(df, "g", "v", 200, 1).first()
    assert r.lo < r.mean < r.hi and r.groups == 200
    assert resample.bootstrap(df.filter("g < 9"), "g", "v", 50, 1).first().lo is None
    s = resample.disjoint_split(df.union(df), "g", 0.3, 1)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0 and 30 < s.filter("split = 'test'").count() / 2 < 90
    labels = spark.createDataFrame([(i, i // 10) for i in range(40)], "id int, lab int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "u int, v int")
    p = resample.permutation_null(edges, labels, "id", "lab", 50, 1).first()
    assert p.observed > p.null_mean and p.p == pytest.approx(1 / 51) and p.z > 2


def test_shuffled_places_are_permutations():
    for n in (1, 2, 7, 1000):
        sent = resample.shuffled_places(np.arange(n), n, 3, np.arange(1, 30))
        assert (np.sort(sent, 0) == np.arange(n)[:, None]).all()
    # a place goes everywhere, and neighbours don't stay neighbours
    sent = resample.shuffled_places(np.arange(10), 10, 5, np.arange(4000))
    assert all(abs((sent[i] == j).mean() - 0.1) < 0.025 for i in range(10) for j in range(10))
    assert abs(((sent[1] - sent[0]) % 10 == 1).mean() - 1 / 9) < 0.025


def test_draws_are_even_and_the_same_everywhere(spark):
    df = spark.range(-5, 5000).select("id", resample.draw(3, F.col("id"), F.lit(2)).alias("d")).collect()
    d = np.array([r.d for r in df])
    assert (d == resample.draws(3, np.array([r.id for r in df]), 2)).all() and d.min() >= 0 and d.max() < resample.PRIME
    assert np.abs(np.histogram(d / resample.PRIME, 10, (0, 1))[0] - 500).max() < 110


def test_overlap_tail_is_exact(spark):
    from math import comb

    from varistra.functions import exact

    cases = [(a, b, c, n) for n in (5, 40, 300, 5000) for b in (0, 3, n // 3, n) for c in (0, 2, n // 2, n) for a in (0, 1, 2, n // 9, n // 4, n)] + [(3, 9, 2, 8), (-1, 2, 2, 8), (None, 1, 1, 2)]
    got = spark.createDataFrame(cases, "a long, b long, c long, n long").withColumn("p", exact.overlap_tail(*map(F.col, "abcn"))).collect()
    for r in got:
        if r.a is None or r.a < 0 or r.b > r.n or r.c > r.n:
            assert r.p is None
        else:
            want = sum(comb(r.b, k) * comb(r.n - r.b, r.c - k) for k in range(max(r.a, r.b + r.c - r.n, 0), min(r.b, r.c) + 1)) / comb(r.n, r.c)
            assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300)
    row = spark.createDataFrame([(8, 2, 1, 5)], "a int, b int, c int, d int").select(exact.fisher_greater(*map(F.col, "abcd")).alias("p")).first()
    assert row.p == pytest.approx(special.fisher_greater(8, 2, 1, 5))


def test_retrieval_f1_is_harmonic(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    t = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a int, b int")
    r = pairs.retrieval(p, t).first()
    assert r.micro_f1 == pytest.approx(2 * r.micro_precision * r.micro_recall / (r.micro_precision + r.micro_recall)) and r.macro_recall == pytest.approx(4 / 6)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0.1, 9), min_size=2, max_size=6), st.floats(0.2, 5))
def test_beta_symmetry(xs, b):
    for a in xs:
        assert special.betainc(a, b, 0.3) + special.betainc(b, a, 0.7) == pytest.approx(1, abs=1e-9)
    assert math.isclose(special.gammaincc(1.0, b), math.exp(-b), rel_tol=1e-9)


def test_benjamini_hochberg_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x)) for g, n in (("a", 200), ("b", 7), (None, 3)) for i, x in enumerate(np.round(rng.random(n) ** 2, 2))] + [("a", 999, None)]
    got = {(r.g, r.i): r.fdr for r in R.benjamini_hochberg(spark.createDataFrame(rows, "g string, i int, p double"), "p", "i", ["g"], parts=5).collect()}
    assert len(got) == len(rows) and got["a", 999] is None
    for g in ("a", "b", None):
        own = sorted((p, i) for h, i, p in rows if h == g and p is not None)
        low = 1.0
        for rank in range(len(own), 0, -1):
            p, i = own[rank - 1]
            low = min(low, p * len(own) / rank)
            if rank == 1 or own[rank - 2][0] != p:  # ties share the value of the last of them
                pass
            assert got[g, i] == pytest.approx(min(low, *(p * len(own) / (j + 1) for j, x in enumerate(own) if x[0] == p)))


def test_row_differences_skip_nulls(spark):
    rows = [(1, [1.0, None, 3.0, float("nan")], [2.0, 5.0, 1.0, 1.0]), (2, [None], [1.0]), (3, [0.0, 0.0], [1.0, 2.0])]
    from varistra.functions import scalar as S

    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    got = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in S.row_differences(F.col("a"), F.col("b")).items()]).collect()}
    assert (got[1].mean_diff, got[1].median_diff, got[1].l2) == (1.5, 1.5, pytest.approx(5**0.5)) and got[1].cosine == pytest.approx(5 / (10 * 5) ** 0.5)
    assert got[2].mean_diff is None and got[2].cosine is None and got[3].cosine is None and got[3].mean_diff == 1.5


def test_search_modes(spark):
    df = spark.createDataFrame([(1, "rs12", 7, "8", "ABC", 0.5), (2, "rs12", 8, "9", "RS12", 0.9), (3, None, None, None, "abcd", 0.7)], "id int, rs string, a long, b string, g string, s double")
    find = lambda q: [r.id for r in R.search(df, q, "rs", ["a", "b"], "g", "s", "id").collect()]
    assert find("RS12 ") == [2, 1] and find("8") == [] and find("08") == [] and find("abc") == [1, 3] and find("a") == []
    assert [r.id for r in R.search(df.withColumn("a", F.col("a") + 10), "18", "rs", ["a", "b"], "g", "s", "id").collect()] == [2]


def test_metadata_heads_go_and_null_heads_stay(spark):
    df = spark.createDataFrame([("exon_number", 1.0), ("depth", 2.0), (None, 3.0), ("Exon_number", 4.0)], "head string, value double")
    assert {tuple(r) for r in schema.without_metadata(df).collect()} == {("depth", 2.0), (None, 3.0), ("Exon_number", 4.0)}
    assert schema.without_metadata(df.limit(0)).collect() == []


def test_heads_are_ranked_within_the_row(spark):
    from varistra.operators import relational as R

    rows = [(1, 3.0, 2.0, 2.0, None), (1, 3.0, 2.0, 2.0, None), (2, 0.4, 0.1, None, 0.5), (3, None, None, None, None), (4, float("nan"), 9.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, a_x double, a_y double, b_x double, c_x double")
    heads = df.columns[1:]
    got = R.attribute(df, ["id"], heads, lambda h: F.substring(h, 1, 1), 2)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted([(1, "a_x", "a", 3.0, 1), (1, "b_x", "b", 2.0, 2)] * 2 + [(4, "a_y", "a", 9.0, 1), (4, "c_x", "c", 2.0, 2)])
    top = R.ranked_heads(df, ["id"], heads, lambda v, i: F.abs(v), 0.45, 2)
    assert sorted(map(tuple, top.collect())) == sorted([(1, "a_x", 3.0, 1), (1, "a_y", 2.0, 2)] * 2 + [(2, "c_x", 0.5, 1), (4, "a_y", 9.0, 1), (4, "c_x", 2.0, 2)])


def test_neighbours_by_tiles_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 6)), np.tile(rng.normal(size=6), (40, 1)), np.zeros((3, 6))]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(1000)[: len(x)]]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id int, v array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-10)
    sim = np.round(u @ u.T, 6)
    want = []
    for i, a in enumerate(ids):
        near = sorted((-sim[i, j], b) for j, b in enumerate(ids) if b != a)[:5]
        want += [(a, r, b, round(-s, 6) + 0.0) for r, (s, b) in enumerate(near, 1)]
    for block, tile in ((8 << 20, 2 << 20), (16 * 24, 40), (50 * 24, 300)):
        monkeypatch.setattr(V, "BLOCK_BYTES", block)
        monkeypatch.setattr(V, "TILE", tile)
        got = [(a, r, b, round(s, 6) + 0.0) for a, r, b, s in V.neighbours(df, "id", "v", 5).collect()]
        assert sorted(got) == sorted(want)


def test_neighbours_hold_a_tile_of_similarities(spark, monkeypatch):
    import resource

    def used(n):
        def run(batches):
            for b in batches:
                yield b
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0], pa.int32()), pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]), pa.array([0.0])], ["source", "rank", "target", "similarity"])

        df = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(F.col("id") * (i + 1)).cast("float")).alias("v"))
        near = V.neighbours(df, "id", "v", 5)
        return max(r.target for r in near.mapInArrow(run, near.schema).filter("source = -1").collect()) / 1024

    assert used(30_000) < used(1_000) + 150  # in MB; 512 x 30,000 similarities and their sorted copies were over 400


def test_ranks_within_groups_come_from_ranges(spark):
    rows = [(i % 3 or None, [None, float("nan"), -0.0, 0.0, 1.5, 7.0, 7.0, float(i)][i % 8], i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    df = df.withColumn("d", F.timestamp_seconds(F.coalesce(F.nanvl("v", F.lit(900.0)), F.lit(0.0)) * 5000))
    for value in ("v", "d", "i"):
        got = R.average_rank(df, value, ["g"], "r")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "rank(" not in plan
        from pyspark.sql import Window

        w = Window.partitionBy("g")
        want = df.withColumn("r", F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy("g", value)) - 1) / 2)
        pick = lambda x: {r.i: r.r for r in x.collect()}
        assert pick(got) == pick(want)
    ok = df.filter("not isnan(v)")
    assert {r.g: r.median for r in R.medians(ok, "v", ["g"]).collect()} == {r.g: r.m for r in ok.groupBy("g").agg(F.median("v").alias("m")).collect()}


def test_collapse_hashes_rows_of_whole_number_keys(spark):
    base = spark.range(300).select((F.col("id") % 7).alias("g"), ((F.col("id") - 150) * 40_000_000_000_000_000).alias("k"))
    for kind in ("long", "int", "string"):
        df = base.withColumn("k", (F.col("k") / 40_000_000_000_000_000).cast("int") if kind == "int" else F.col("k").cast(kind))
        many = df.crossJoin(spark.range(6).select(F.col("id").cast("int").alias("repeat")))
        want = many.groupBy("repeat", "g").agg(F.min_by("k", F.struct(resample.draw(5, F.col("repeat"), resample.number(df, "k")), "k")).alias("k"))
        got = resample.collapse(df, "g", "k", 6, 5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert ("SortAggregate" in got._jdf.queryExecution().executedPlan().toString()) == (kind == "string")


def test_rows_of_one_key_are_ranked_together(spark):
    rows = [(1, 3.0, 2.0, 2.0, None), (1, 4.0, 2.0, 5.0, None), (2, 0.4, 0.1, None, 0.5), (3, None, None, None, None), (4, float("nan"), 9.0, 1.0, 2.0), (4, 9.5, None, None, 9.0)]
    df = spark.createDataFrame(rows, "id int, a_x double, a_y double, b_x double, c_x double")
    heads = df.columns[1:]
    got = R.attribute_keys(df, ["id"], heads, lambda h: F.substring(h, 1, 1), 2)
    assert sorted(map(tuple, got.collect())) == [(1, "a_x", "a", 4.0, 2), (1, "b_x", "b", 5.0, 1), (4, "a_x", "a", 9.5, 1), (4, "c_x", "c", 9.0, 2)]
    top = R.ranked_keys(df, ["id"], heads, lambda v, i: F.abs(v), 0.45, 2)
    assert sorted(map(tuple, top.collect())) == [(1, "a_x", 4.0, 2), (1, "b_x", 5.0, 1), (2, "c_x", 0.5, 1), (4, "a_x", 9.5, 1), (4, "a_y", 9.0, 2)]


def test_pairs_of_sets_are_distinct_without_a_shuffle_of_pairs(spark):
    import random

    rows = [(random.Random(i).randrange(30) if i % 7 else None, random.Random(-i).randrange(40) if i % 11 else None) for i in range(600)]
    rows += [(g, 99) for g in range(30)]
    df = spark.createDataFrame(rows, "g int, m int")
    groups = {}
    for g, m in rows:
        if g is not None and m is not None:
            groups.setdefault(g, set()).add(m)
    want = sorted({(a, b) for ms in groups.values() for a in ms for b in ms if a < b})
    for block, most in ((8192, 256), (3, 256), (8192, 8), (4, 15), (4, 0)):
        got = R.group_pairs(df, "g", "m", block=block, most=most)
        assert want == sorted(map(tuple, got.collect()))
        if most == 256:
            assert "keys=[a#" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_counted_by_label_equal_pairs_made(spark):
    from varistra.operators import relational as R

    rng = np.random.default_rng(3)
    labels = spark.createDataFrame([(i, int(rng.integers(4)) if i % 9 else None) for i in range(60)], "id int, lab int")
    predicted = spark.createDataFrame([(int(a), int(b)) for a, b in np.sort(rng.integers(0, 60, (150, 2)), 1)], "a int, b int").filter("a < b")
    made = pairs.retrieval(predicted, R.group_pairs(labels.filter("lab is not null"), "lab", "id")).first()
    counted = pairs.retrieval_by_label(predicted, labels, "id", "lab").first()
    assert list(counted) == pytest.approx(list(made))


def test_domain_names_replace_accessions(spark):
    from varistra.functions import scalar

    heads = spark.createDataFrame([("pfam_PF00001.2",), ("pfam_PF99999",), ("score_other_head",), (None,)], "head string")
    names = spark.createDataFrame([("PF00001", "7tm_1"), ("PF00001", "8tm"), (None, "x")], "acc string, name string")
    got = {r.head: r.shown for r in scalar.domain_display(heads, "head", names, "acc", "name", ("pfam_", "score_")).collect()}
    assert got == {"pfam_PF00001.2": "7tm_1", "pfam_PF99999": "PF99999", "score_other_head": "Other Head", None: None}


def test_halves_are_ranked_by_means_worked_out_once(spark):
    import random

    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    long = spark.range(240).select((F.col("id") % 20).alias("g"), (F.col("id") % 12).alias("f"), drawn().alias("v"))
    got = resample.split_halves(long, "g", "f", "v", 3, F.expr("(g div 4 + repeat) % 2 = 0")).collect()
    assert sorted((r.repeat, r.features) for r in got) == [(1, 12), (2, 12), (3, 12)] and all(-1 <= r.rho <= 1 for r in got)


def test_pairs_of_sets_shuffle_memberships_twice(spark):
    import random

    rng = random.Random(1)
    rows = [(f"s{rng.randrange(20)}", rng.randrange(300)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, m int").repartition(2)
    sc, jvm = spark.sparkContext, spark._jvm

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    df, _ = shared.stored(df, "rows")
    groups = {}
    for g, m in rows:
        groups.setdefault(g, set()).add(m)
    want = sorted({(a, b) for ms in groups.values() for a in ms for b in ms if a < b})
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large
    try:
        for more in ({}, {"coded": 19}, {"block": 30}, {"coded": 19, "block": 30, "most": 8}):
            before = shuffled()
            assert want == sorted(map(tuple, R.group_pairs(df, "g", "m", **more).collect()))
            if "block" not in more:
                assert shuffled() - before < 2.5 * len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
