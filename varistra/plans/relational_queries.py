"""Joins, set operations, windows, searches, vectors and neighbour pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varistra.operators import pairs, relational as R, schema, vectors as V
from varistra.plans.catalog import Tables, query

KNN = """knn AS (SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS rank FROM knn QUALIFY rank <= 10)"""


def edges(t: Tables, k: int = 10) -> DataFrame:
    return V.neighbours(t.embeddings, "vec_id", "embedding", k)


# ---------------------------------------------------------------- joins


@query("j1_inner_left", "SELECT o_orderkey, c_mktsegment, coalesce(n, 0) AS n_lines FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_orderkey = o_orderkey")
def inner_left(t: Tables) -> DataFrame:
    """The aggregate comes before the join."""
    n = t.lineitem.filter("l_quantity > 45").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "c_mktsegment", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"))


@query("j3_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(t: Tables) -> DataFrame:
    """J3, P9."""
    return t.customer.join(t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j4_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti(t: Tables) -> DataFrame:
    """J4."""
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j10_band", "SELECT a.event_id AS a, b.event_id AS b, abs(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND abs(floor(epoch(a.ts))::BIGINT - floor(epoch(b.ts))::BIGINT) <= 3600 AND a.event_type = 'purchase' AND b.event_type = 'click'".replace("abs(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT)", "abs(floor(epoch(a.ts))::BIGINT - floor(epoch(b.ts))::BIGINT)"))
def band(t: Tables) -> DataFrame:
    """Binned range join."""
    e = t.events.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pos"))
    a = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("a"), "user_id", F.col("pos").alias("pa"))
    b = e.filter("event_type = 'click'").select(F.col("event_id").alias("b"), "user_id", F.col("pos").alias("pb"))
    return R.band_join(a, b, ["user_id"], "pa", "pb", 3600).select("a", "b", F.abs(F.col("pa") - F.col("pb")).alias("gap"))


@query("j12_shared_sets", "SELECT DISTINCT a.o_custkey AS a, b.o_custkey AS b FROM orders a JOIN orders b ON a.o_orderdate = b.o_orderdate AND a.o_custkey < b.o_custkey")
def shared(t: Tables) -> DataFrame:
    """Distinct pairs that share a set."""
    return R.group_pairs(t.orders, "o_orderdate", "o_custkey")


@query("j14_complement", "WITH s AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS v FROM part GROUP BY 1) SELECT p_brand, round(v / n - (sum(v) OVER () - v) / (sum(n) OVER () - n), 4) AS diff FROM s")
def complement(t: Tables) -> DataFrame:
    """J14."""
    from varistra.operators.stats import welch

    return welch(t.part, "p_brand", "p_retailprice").select("p_brand", F.round("diff", 4).alias("diff"))


@query("j17_ego_groups", """
WITH e AS (SELECT DISTINCT least(o_custkey, l_suppkey + 1000000) AS u, greatest(o_custkey, l_suppkey + 1000000) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 40),
b AS (SELECT u AS node, v AS p FROM e UNION SELECT v, u FROM e) SELECT node, count(*) AS size FROM b GROUP BY node HAVING count(*) >= 5 ORDER BY size DESC, node LIMIT 500""")
def ego(t: Tables) -> DataFrame:
    """J17."""
    e = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", (F.col("l_suppkey") + 1000000).alias("s"), "l_quantity")
    return R.ego_groups(e, "o_custkey", "s", "l_quantity", 40, 5, 500)


@query("j18_intervals", "SELECT o_orderkey, greatest(o_orderkey, 100) AS lo, least(o_orderkey + 50, 400) AS hi FROM orders WHERE o_orderkey <= 400 AND o_orderkey + 50 >= 100")
def intervals(t: Tables) -> DataFrame:
    """J18."""
    lo, hi, over = R.clip_interval(F.col("o_orderkey"), F.col("o_orderkey") + 50, 100, 400)
    return t.orders.filter(over).select("o_orderkey", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


# ---------------------------------------------------------------- set operations


@query("u1_union_by_name", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS bal, NULL AS size FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'p', p_partkey, NULL, p_size FROM part")
def union(t: Tables) -> DataFrame:
    """By name, types relaxed, missing columns null."""
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").cast("int").alias("id"), F.col("s_acctbal").cast("string").alias("bal"))
    p = t.part.select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return schema.union_relaxed([c, s, p], {"id": "long", "bal": "double"})


@query("u5_set_algebra", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either,
round((SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard""")
def algebra(t: Tables) -> DataFrame:
    """One pass with a flag for each side."""
    s = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"))
    s = s.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("a") | F.col("b")).alias("either"))
    return s.withColumn("jaccard", F.round(F.col("both") / F.col("either"), 6))


@query("a29_old_vs_new", """
WITH o AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 35), n AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 15)
SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, count(*) FILTER (WHERE o.p_type IS NOT NULL AND n.p_type IS NOT NULL) AS shared, count(*) FILTER (WHERE o.p_type IS NULL) AS added, count(*) FILTER (WHERE n.p_type IS NULL) AS removed, round(count(*) FILTER (WHERE o.p_type IS NOT NULL AND n.p_type IS NOT NULL) / count(*), 8) AS jaccard
FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.p_type = n.p_type GROUP BY 1""")
def old_new(t: Tables) -> DataFrame:
    """A29."""
    return pairs.compare_sets(t.part.filter("p_size < 35"), t.part.filter("p_size > 15"), "p_brand", "p_type").withColumn("jaccard", F.round("jaccard", 8))


# ---------------------------------------------------------------- lookups, searches, windows


@query("p5_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def lookup(t: Tables) -> DataFrame:
    """P5, K4: the file whose range holds the key, and the key's filter in its scan."""
    from varistra.plans import storage_queries

    return storage_queries.orders_by_key(t).between(77, 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("p6_locus_range", "SELECT l_partkey, l_orderkey, l_linenumber, abs(l_orderkey - 500) AS distance FROM (SELECT l_orderkey AS k, * FROM lineitem) WHERE l_linestatus = 'O' AND l_orderkey BETWEEN 400 AND 600 AND l_orderkey <> 500 ORDER BY distance, l_orderkey, l_linenumber, l_partkey LIMIT 50".replace("SELECT l_partkey, l_orderkey, l_linenumber, abs", "SELECT l_orderkey, abs").replace(", l_linenumber, l_partkey LIMIT", " LIMIT"))
def locus(t: Tables) -> DataFrame:
    """Of the files whose ranges meet the window."""
    from varistra.plans import storage_queries

    near = storage_queries.lines_by_order(t).between(500 - 100, 500 + 100)
    return R.locus_range(near, "l_linestatus", "l_orderkey", "l_orderkey", ("O", 500), 100, 900, 500).select("l_orderkey", "distance")


@query("p7_search", "SELECT p_partkey, p_brand, CASE WHEN upper(p_brand) = 'BRAND#1' THEN 0 ELSE 1 END AS tier FROM part WHERE starts_with(upper(p_brand), 'BRAND#1') ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 30")
def search(t: Tables) -> DataFrame:
    """Exact, then prefix, best first, in the files that the index of names gives."""
    from varistra.plans import storage_queries

    return R.tiered_search(storage_queries.parts_by_name(t).prefixed("brand", "BRAND#1"), "p_brand", "Brand#1", "p_retailprice", "p_partkey").select("p_partkey", "p_brand", "tier")


@query("w3_topk_per_set", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20")
def topk(t: Tables) -> DataFrame:
    """W3, O4, O3."""
    return R.top_k(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("o_orderpriority", "o_orderkey", "rank")


@query("w6_bh_fdr", """
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS f, (l_extendedprice % 1000) / 1000 AS p FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p, id) AS rn, count(*) OVER (PARTITION BY f) AS n FROM s)
SELECT id, round(greatest(0, least(1, min(p * n / rn) OVER (PARTITION BY f ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 6) AS fdr FROM r""")
def bh(t: Tables) -> DataFrame:
    """W6."""
    df = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", (F.col("l_extendedprice") % 1000 / 1000).alias("p"))
    return R.benjamini_hochberg(df, "p", "id", ["l_returnflag"]).select("id", F.round("fdr", 6).alias("fdr"))


@query("w7_attribution", """
WITH long AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity / 25 AS a_qty, l_discount * 20 AS a_disc, l_tax * 25 AS b_tax, l_extendedprice / 40000 AS b_price FROM lineitem) ON a_qty, a_disc, b_tax, b_price INTO NAME head VALUE z),
c AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY z DESC, head) AS place FROM long),
g AS (SELECT *, left(head, 1) AS grp, row_number() OVER (PARTITION BY id, left(head, 1) ORDER BY z DESC, head) AS nth FROM c WHERE place <= 6 AND z > 0.5)
SELECT id, head, grp, z, row_number() OVER (PARTITION BY id ORDER BY z DESC, head) AS rank FROM g WHERE nth = 1 QUALIFY rank <= 2""")
def attribution(t: Tables) -> DataFrame:
    """The strongest heads, one for each group, over all rows of a key."""
    wide = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 25).alias("a_qty"), (F.col("l_discount") * 20).alias("a_disc"), (F.col("l_tax") * 25).alias("b_tax"), (F.col("l_extendedprice") / 40000).alias("b_price"))
    return R.attribute_keys(wide, ["id"], ["a_qty", "a_disc", "b_tax", "b_price"], lambda head: F.substring(head, 1, 1), 2)


@query("w8_dense_index", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS seg, count(*) OVER (PARTITION BY c_nationkey) AS in_nation FROM customer")
def dense_index(t: Tables) -> DataFrame:
    """The distinct values are ranked, not the rows."""
    index = t.customer.select("c_mktsegment").distinct().withColumn("seg", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1)
    n = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("in_nation"))
    return t.customer.join(index, "c_mktsegment").join(n, "c_nationkey").select("c_custkey", F.col("seg").cast("long").alias("seg"), "in_nation")


@query("w10_rank_overlap", "SELECT count(*) AS shared, round(count(*) / (200 - count(*)), 6) AS jaccard FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) JOIN (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 100) USING (p_partkey)")
def overlap(t: Tables) -> DataFrame:
    """W10, O5."""
    a, b = (t.part.orderBy(F.desc(c), "p_partkey").limit(100).select("p_partkey") for c in ("p_retailprice", "p_size"))
    return a.join(b, "p_partkey").agg(F.count(F.lit(1)).alias("shared")).withColumn("jaccard", F.round(F.col("shared") / (200 - F.col("shared")), 6))


@query("w11_first_per_name", "WITH s AS (SELECT p_name, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) SELECT p_name, p_partkey FROM s WHERE rn = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
def first_name(t: Tables) -> DataFrame:
    """W11."""
    return R.top_k(t.part, ["p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")], 1).orderBy(F.desc("p_retailprice"), "p_partkey").limit(12).select("p_name", "p_partkey")


@query("w11_size_fallback", """
WITH c AS (SELECT l_partkey AS p_partkey, count(*) AS n_sig FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.10 AND l_returnflag = 'R' GROUP BY 1),
s AS (SELECT p_partkey, p_name, n_sig, p_size FROM part LEFT JOIN c USING (p_partkey)),
f AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY n_sig DESC NULLS LAST, p_size DESC, p_partkey) AS rn FROM s)
SELECT p_partkey, p_name, n_sig FROM f WHERE rn = 1 ORDER BY n_sig DESC NULLS LAST, p_size DESC, p_partkey LIMIT 40""")
def names_with_fallback(t: Tables) -> DataFrame:
    """Names of parts with significant lines first; the rest by size."""
    lines = t.lineitem.filter("l_quantity = 50 and l_discount = 0.10 and l_returnflag = 'R'")
    counts = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_sig"))
    return R.first_names(t.part, counts, "p_partkey", "p_name", "n_sig", [-F.col("p_size")], 40)


# ---------------------------------------------------------------- vectors and neighbours


@query("m2_neighbours_topk", f"WITH {KNN} SELECT source, target, rank, similarity FROM top")
def knn(t: Tables) -> DataFrame:
    """M2, M1, J8, W4."""
    return edges(t)


@query("j5_neighbours_joined", f"WITH {KNN} SELECT source, target, rank, a.label AS source_label, b.label AS neighbor_label FROM top JOIN embeddings a ON a.vec_id = source JOIN embeddings b ON b.vec_id = target")
def joined(t: Tables) -> DataFrame:
    """J5."""
    return pairs.labelled_edges(edges(t), t.embeddings, "vec_id", "label").select("source", "target", "rank", "source_label", "neighbor_label")


@query("j6_neighbour_arrays", f"WITH {KNN} SELECT source, rank, target AS id, similarity FROM top")
def arrays(t: Tables) -> DataFrame:
    """Neighbour arrays built and exploded again."""
    meta = t.embeddings.select("vec_id", F.col("label").cast("string").alias("label_display"))
    return V.explode_neighbours(V.neighbour_arrays(edges(t), meta, "vec_id", {"label_display": "?"})).withColumn("rank", F.col("rank").cast("long"))


@query("a21_label_counts", f"WITH {KNN} SELECT source, count(*) FILTER (WHERE b.label = a.label) AS same, count(*) FILTER (WHERE b.label <> a.label) AS other, CASE WHEN count(*) FILTER (WHERE b.label = a.label) >= 2 * count(*) FILTER (WHERE b.label <> a.label) THEN 'same' WHEN count(*) FILTER (WHERE b.label <> a.label) >= 2 * count(*) FILTER (WHERE b.label = a.label) THEN 'other' ELSE 'mixed' END AS character FROM top JOIN embeddings a ON a.vec_id = source JOIN embeddings b ON b.vec_id = target GROUP BY source")
def label_counts(t: Tables) -> DataFrame:
    """A21."""
    hit = F.col("source_label") == F.col("neighbor_label")
    s = pairs.labelled_edges(edges(t), t.embeddings, "vec_id", "label").groupBy("source").agg(F.count_if(hit).alias("same"), F.count_if(~hit).alias("other"))
    return s.withColumn("character", F.when(F.col("same") >= 2 * F.col("other"), "same").when(F.col("other") >= 2 * F.col("same"), "other").otherwise("mixed"))


@query("m8_same_label_enrichment", f"""
WITH {KNN}, e AS (SELECT rank, a.label = b.label AS hit FROM top JOIN embeddings a ON a.vec_id = source JOIN embeddings b ON b.vec_id = target),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), base AS (SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS base FROM n)
SELECT k, count(*) AS pairs, round(avg(hit::INT), 6) AS observed, round(any_value(base), 6) AS base, round(avg(hit::INT) / any_value(base), 4) AS fold FROM e, base, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY k""")
def enrichment(t: Tables) -> DataFrame:
    """M8, M28, A16."""
    s = pairs.same_label_enrichment(edges(t), t.embeddings, "vec_id", "label", [1, 5, 10])
    return s.select("k", "pairs", F.round("observed", 6).alias("observed"), F.round("base", 6).alias("base"), F.round("fold", 4).alias("fold"))


@query("a25_per_class_lift", f"""
WITH {KNN}, e AS (SELECT a.label, a.label = b.label AS hit FROM top JOIN embeddings a ON a.vec_id = source JOIN embeddings b ON b.vec_id = target WHERE rank <= 5),
n AS (SELECT label, count(*) AS members FROM embeddings GROUP BY 1) SELECT label, any_value(members) AS members, round(avg(hit::INT), 6) AS precision, round(avg(hit::INT) / ((any_value(members) - 1) / ((SELECT sum(members) FROM n) - 1)), 4) AS lift FROM e JOIN n USING (label) GROUP BY label""")
def class_lift(t: Tables) -> DataFrame:
    """A25."""
    return pairs.per_class_lift(edges(t), t.embeddings, "vec_id", "label", 5).select("label", "members", F.round("precision", 6).alias("precision"), F.round("lift", 4).alias("lift"))


@query("a24_retrieval", f"""
WITH {KNN}, p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM top WHERE rank <= 5), t AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id), h AS (SELECT * FROM p INTERSECT SELECT * FROM t),
nt AS (SELECT n, count(*) AS t FROM (SELECT a AS n FROM t UNION ALL SELECT b FROM t) GROUP BY n), np AS (SELECT n, count(*) AS p FROM (SELECT a AS n FROM p UNION ALL SELECT b FROM p) GROUP BY n), nh AS (SELECT n, count(*) AS h FROM (SELECT a AS n FROM h UNION ALL SELECT b FROM h) GROUP BY n),
m AS (SELECT CASE WHEN coalesce(p, 0) > 0 THEN coalesce(h, 0) / p ELSE 0 END AS pr, coalesce(h, 0) / t AS re FROM nt LEFT JOIN np USING (n) LEFT JOIN nh USING (n))
SELECT round((SELECT count(*) FROM h) / (SELECT count(*) FROM p), 6) AS micro_precision, round((SELECT count(*) FROM h) / (SELECT count(*) FROM t), 6) AS micro_recall, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS macro_f1 FROM m""")
def retrieval(t: Tables) -> DataFrame:
    """A24, J13, U5."""
    predicted = edges(t, 5).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    s = pairs.retrieval_by_label(predicted, t.embeddings, "vec_id", "label")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns if c != "micro_f1"])


@query("a10_mean_vectors", "WITH s AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(v::DOUBLE), 5) AS mean FROM s GROUP BY ALL")
def mean_vectors(t: Tables) -> DataFrame:
    """A10, M3."""
    return V.mean_vectors(t.embeddings, "label", "embedding").withColumn("mean", F.round("mean", 5))


@query("a11_standardise", "WITH s AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(v::DOUBLE) AS mean FROM s GROUP BY ALL) SELECT label, CAST(i AS INT) AS i, round((mean - avg(mean) OVER (PARTITION BY i)) / stddev_pop(mean) OVER (PARTITION BY i), 4) AS z FROM m")
def standardise(t: Tables) -> DataFrame:
    """A11."""
    return V.standardise(V.mean_vectors(t.embeddings, "label", "embedding"), "i", "mean").select("label", "i", F.round("z", 4).alias("z"))


@query("m3_views", "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_avg(v[1:8]), 5) AS row0, round((v[1] + v[9] + v[17] + v[25] + v[33] + v[41] + v[49] + v[57]) / 8, 5) AS col0, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm FROM s")
def matrix_views(t: Tables) -> DataFrame:
    """M3, M1."""
    row, col, flat = V.views(F.col("embedding"), 8, 8)
    return t.embeddings.select("vec_id", F.round(F.get(row, F.lit(0)), 5).alias("row0"), F.round(F.get(col, F.lit(0)), 5).alias("col0"), F.round(V.norm(flat), 4).alias("norm"))
