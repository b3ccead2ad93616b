"""Aggregates, correlations, tests, metrics, resampling and key states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.functions import exact
from varistra.operators import pairs, relational as R, resample, stats
from varistra.plans.catalog import Tables, query
from varistra.plans.relational_queries import edges
from varistra.sources import shared
from varistra.streaming import state


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not keep or c in keep])


@query("a5_group_counts", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY 1")
def group_counts(t: Tables) -> DataFrame:
    """A5, A6, A27."""
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.avg(q), 4).alias("mean"), F.round(F.median(q), 4).alias("med"))


@query("a7_conditional", "SELECT l_shipdate, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, round(avg(l_discount) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_r, round(stddev_samp(l_discount) FILTER (WHERE l_returnflag <> 'R'), 6) AS std_o, round(median(l_tax) FILTER (WHERE l_returnflag <> 'R'), 6) AS med_o FROM lineitem GROUP BY 1")
def conditional(t: Tables) -> DataFrame:
    """A7, A13, A14."""
    r = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_shipdate").agg(F.count_if(r).alias("n_r"), F.round(F.avg(F.when(r, F.col("l_discount"))), 6).alias("mean_r"), F.round(F.stddev_samp(F.when(~r, F.col("l_discount"))), 6).alias("std_o"), F.round(F.median(F.when(~r, F.col("l_tax"))), 6).alias("med_o"))


@query("a16_thresholds", "SELECT threshold, round(avg((l_discount > threshold)::INT) FILTER (WHERE l_returnflag = 'R'), 6) AS a, round(avg((l_discount > threshold)::INT) FILTER (WHERE l_returnflag <> 'R'), 6) AS b, round(CASE WHEN avg((l_discount > threshold)::INT) FILTER (WHERE l_returnflag <> 'R') <> 0 THEN avg((l_discount > threshold)::INT) FILTER (WHERE l_returnflag = 'R') / avg((l_discount > threshold)::INT) FILTER (WHERE l_returnflag <> 'R') END, 6) AS ratio FROM lineitem, (SELECT unnest([CAST(0.025 AS DOUBLE), 0.055, 0.5]) AS threshold) GROUP BY threshold")
def thresholds(t: Tables) -> DataFrame:
    """A16."""
    return rounded(stats.thresholds(t.lineitem, F.col("l_returnflag") == "R", "l_discount", [0.025, 0.055, 0.5]))


@query("a17_lineage_means", "WITH c AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 5) SELECT c_nationkey, o_orderpriority, round(avg(o_totalprice), 4) AS v, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT c_nationkey FROM c) GROUP BY ALL HAVING count(*) >= 3")
def lineage(t: Tables) -> DataFrame:
    """A17, A18."""
    big = t.customer.groupBy("c_nationkey").count().filter("count >= 5").select("c_nationkey")
    df = t.orders.join(t.customer.join(big, "c_nationkey", "left_semi"), F.col("c_custkey") == F.col("o_custkey"))
    return df.groupBy("c_nationkey", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("v"), F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("a18_dependency", "SELECT p_brand, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS std, round(avg((l_quantity < 10)::INT), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 10")
def dependency(t: Tables) -> DataFrame:
    """A18."""
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"), F.avg((F.col("l_quantity") < 10).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).filter("n >= 10")
    return df.select("p_brand", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("share", 6).alias("share"))


@query("a19_peak_spread", "WITH p AS (SELECT user_id, max(abs(value - 50)) AS peak FROM events GROUP BY 1) SELECT e.user_id, round(any_value(peak), 6) AS peak, min(event_id) FILTER (WHERE abs(value - 50) = peak) AS at_event, count(*) FILTER (WHERE abs(value - 50) > 0.2 * peak) AS spread FROM events e JOIN p ON p.user_id = e.user_id GROUP BY e.user_id")
def peak(t: Tables) -> DataFrame:
    """A19."""
    d = F.abs(F.col("value") - 50)
    top = t.events.groupBy("user_id").agg(F.max(F.struct(d.alias("d"), (-F.col("event_id")).alias("e"))).alias("m"))
    return t.events.join(top, "user_id").groupBy("user_id").agg(F.round(F.max("m.d"), 6).alias("peak"), (-F.max("m.e")).alias("at_event"), F.count_if(d > 0.2 * F.col("m.d")).alias("spread"))


@query("a20_window_means", """
WITH c AS (SELECT user_id, min(event_id) AS center FROM events GROUP BY 1)
SELECT c.user_id, round(avg(value) FILTER (WHERE abs(event_id - center) <= 1), 5) AS w0, round(avg(value) FILTER (WHERE abs(event_id - center) <= 200), 5) AS w200 FROM events e JOIN c ON c.user_id = e.user_id GROUP BY c.user_id""")
def window_means(t: Tables) -> DataFrame:
    """Radius 0 counts as 1."""
    c = t.events.groupBy("user_id").agg(F.min("event_id").alias("center"))
    near = lambda r: F.round(F.avg(F.when(F.abs(F.col("event_id") - F.col("center")) <= max(1, r), F.col("value"))), 5)
    return t.events.join(c, "user_id").groupBy("user_id").agg(near(0).alias("w0"), near(200).alias("w200"))


@query("a22_recurrence", "WITH h AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS s, l_discount - 0.05 AS e FROM lineitem WHERE l_quantity > 48) SELECT l_suppkey, count(*) AS sets, round(avg(e), 6) + 0 AS mean_effect, round(count(*) * avg(abs(e)), 6) AS score FROM h GROUP BY 1")
def recurrence(t: Tables) -> DataFrame:
    """A22, A23."""
    h = t.lineitem.filter("l_quantity > 48").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("s"), (F.col("l_discount") - 0.05).alias("e")).distinct()
    return rounded(pairs.recurrence(h, "l_suppkey", "s", "e").drop("names"))


@query("a26_margins", """
WITH m AS (SELECT 'l_returnflag' AS axis, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2)
SELECT axis, key, n, round(avg(n) OVER (PARTITION BY axis), 4) AS expected, round(pow(n - avg(n) OVER (PARTITION BY axis), 2) / avg(n) OVER (PARTITION BY axis), 4) AS chi2 FROM m""")
def margins(t: Tables) -> DataFrame:
    """A26, M21."""
    return rounded(stats.margins(t.lineitem, "l_returnflag", "l_linenumber"), digits=4).withColumn("axis", F.when(F.col("key").rlike("^[0-9]+$"), "l_linenumber").otherwise("l_returnflag"))


@query("m4_pearson_guarded", "SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 50 THEN corr(l_quantity, l_extendedprice) END, 6) AS r FROM lineitem GROUP BY 1")
def pearson(t: Tables) -> DataFrame:
    """M4: null under 50 values."""
    return rounded(stats.guarded_corr(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice"))


@query("m5_spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS r FROM r GROUP BY 1""")
def spearman(t: Tables) -> DataFrame:
    """M5, W5."""
    return rounded(stats.spearman(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("m6_welch", """
WITH s AS (SELECT p_brand, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
x AS (SELECT *, sum(n) OVER () - n AS rn, sum(s) OVER () - s AS rs, sum(q) OVER () - q AS rq FROM s), v AS (SELECT *, (q - s * s / n) / (n - 1) AS v1, (rq - rs * rs / rn) / (rn - 1) AS v2, s / n - rs / rn AS diff FROM x)
SELECT p_brand, round(diff / sqrt(v1 / n + v2 / rn), 4) AS t, round(pow(v1 / n + v2 / rn, 2) / (pow(v1 / n, 2) / (n - 1) + pow(v2 / rn, 2) / (rn - 1)), 2) AS dof, round(diff / sqrt(((n - 1) * v1 + (rn - 1) * v2) / (n + rn - 2)), 4) AS d FROM v""")
def welch(t: Tables) -> DataFrame:
    """M6, A28, J14."""
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return stats.welch(df, "p_brand", "l_quantity").select("p_brand", F.round("t", 4).alias("t"), F.round("dof", 2).alias("dof"), F.round("d", 4).alias("d"))


@query("m6_enrichment_fdr")
def enrichment(t: Tables) -> DataFrame:
    """P by the t law, which SQL doesn't have."""
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return stats.enrichment(df, "p_brand", "l_quantity")


@query("m7_matched_controls", f"""
WITH c AS (SELECT p_type, p_partkey AS control, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS size FROM part),
tried AS (SELECT p_type, control AS key, nth, {resample.sql_draw(11, "control", "nth")} % size AS place FROM c, (SELECT unnest(range(20)) AS nth))
SELECT key AS p_partkey, arg_min(c.control, nth) AS control FROM tried JOIN c USING (p_type, place) WHERE c.control <> key GROUP BY key""")
def controls(t: Tables) -> DataFrame:
    """M7: places drawn by arithmetic."""
    return resample.matched_controls(t.part.select("p_type", "p_partkey"), t.part.select("p_type", "p_partkey"), ["p_type"], "p_partkey", 11)


TIMES = "CASE " + " ".join(f"WHEN {{u}} < {cut!r} THEN {i}" for i, cut in enumerate(resample.POISSON)) + f" ELSE {len(resample.POISSON)} END"


@query("m9_bootstrap_ci", f"""
WITH g AS (SELECT l_suppkey AS g, avg(l_discount) AS m FROM lineitem GROUP BY 1),
r AS (SELECT rep, m, {resample.sql_draw(3, "g", "rep")} / {resample.PRIME}.0::DOUBLE AS u FROM g, (SELECT unnest(range(1, 501)) AS rep)),
b AS (SELECT rep, sum({TIMES.format(u="u")} * m) / greatest(1, sum({TIMES.format(u="u")})) AS b FROM r GROUP BY rep)
SELECT (SELECT count(*) FROM g) AS groups, (SELECT round(avg(m), 8) FROM g) AS mean, round(quantile_cont(b, 0.025), 8) AS lo, round(quantile_cont(b, 0.975), 8) AS hi FROM b""")
def bootstrap(t: Tables) -> DataFrame:
    """M9."""
    return rounded(resample.bootstrap(t.lineitem, "l_suppkey", "l_discount", 500, 3), digits=8)


@query("m10_collapse", f"""
WITH r AS (SELECT rep, p_size, p_partkey, {resample.sql_draw(5, "rep", "p_partkey")} AS d FROM part, (SELECT unnest(range(30)) AS rep)), o AS (SELECT *, row_number() OVER (PARTITION BY rep, p_size ORDER BY d, p_partkey) AS nth FROM r)
SELECT rep::INT AS repeat, p_size, p_partkey FROM o WHERE nth = 1""")
def collapse(t: Tables) -> DataFrame:
    """M10."""
    return resample.collapse(t.part, "p_size", "p_partkey", 30, 5)


def sql_shuffle(source: str) -> str:
    """CTEs that send x of source(rep, node, x, n) to its place in the permutation of rep, as ``shuffled_places`` does."""
    out, last = [], source
    for r in range(resample.ROUNDS):
        partner = f"(({resample.sql_draw(7, 'rep', str(r))} - x) % n + n) % n"
        out.append(f"p{r} AS (SELECT rep, node, n, x, {partner} AS y FROM {last})")
        out.append(f"x{r} AS (SELECT rep, node, n, CASE WHEN {resample.sql_draw(7, 'rep', str(r), 'greatest(x, y)')} // 64 % 2 = 1 THEN y ELSE x END AS x FROM p{r})")
        last = f"x{r}"
    return ", ".join([*out, f"sent AS (SELECT rep, node, x FROM {last})"])


REPLICATES = 1000


@query("m11_permutation_null", f"""
WITH nodes AS (SELECT vec_id AS node, label, row_number() OVER (ORDER BY vec_id) - 1 AS place, row_number() OVER (ORDER BY label, vec_id) - 1 AS spot, count(*) OVER () AS n FROM embeddings),
t0 AS (SELECT rep, node, place AS x, n FROM nodes, (SELECT unnest(range(1, {REPLICATES + 1})) AS rep)),
{sql_shuffle("t0")},
given AS (SELECT s.rep, s.node, l.label FROM sent s JOIN nodes l ON l.spot = s.x),
vec AS (SELECT vec_id AS node, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT u, v FROM (SELECT p.node AS u, q.node AS v, row_number() OVER (PARTITION BY p.node ORDER BY round(list_cosine_similarity(p.v, q.v), 6) DESC, q.node) AS k FROM vec p JOIN vec q ON p.node <> q.node) WHERE k <= 5),
null_shares AS (SELECT p.rep, avg((p.label = q.label)::INT) AS s FROM e JOIN given p ON p.node = e.u JOIN given q ON q.node = e.v AND q.rep = p.rep GROUP BY p.rep),
seen AS (SELECT avg((p.label = q.label)::INT) AS observed FROM e JOIN nodes p ON p.node = e.u JOIN nodes q ON q.node = e.v)
SELECT round(observed, 8) AS observed, round(avg(s), 8) AS null_mean, round(stddev_pop(s), 8) AS null_std, round((observed - avg(s)) / stddev_pop(s), 6) AS z, round((count(*) FILTER (WHERE s >= observed) + 1) / (count(*) + 1), 8) AS p FROM null_shares, seen GROUP BY observed""")
def permutation(t: Tables) -> DataFrame:
    """1,000 replicates."""
    e = edges(t, 5).select(F.col("source").alias("u"), F.col("target").alias("v"))
    found = resample.permutation_null(e, t.embeddings, "vec_id", "label", REPLICATES, 7)
    return found.select(*[F.round(c, 6 if c == "z" else 8).alias(c) for c in found.columns])


@query("m14_mann_whitney", """
WITH r AS (SELECT l_returnflag = 'R' AS f, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS k FROM lineitem),
s AS (SELECT count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, sum(k) FILTER (WHERE f) AS r1 FROM r)
SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 8) AS rank_biserial FROM s""")
def mann_whitney(t: Tables) -> DataFrame:
    """M14."""
    found = stats.mann_whitney(t.lineitem, "l_quantity", F.col("l_returnflag") == "R")
    return found.select("n1", "n2", F.round("u", 4).alias("u"), F.round("rank_biserial", 8).alias("rank_biserial"))


@query("m14_fisher", f"""
WITH s AS (SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
x AS (SELECT *, sum(a) OVER ()::BIGINT - a AS c, sum(b) OVER ()::BIGINT - b AS d FROM s)
SELECT p_brand, a, b, c, d, round({exact.sql_overlap_tail("a", "(a + b)", "(a + c)", "(a + b + c + d)")}, 7) AS p FROM x""")
def fisher(t: Tables) -> DataFrame:
    """Is the share of returned items larger in a brand than in all others? Exact, one-sided."""
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    r = F.col("l_returnflag") == "R"
    cells = df.groupBy("p_brand").agg(F.count_if(r).alias("a"), F.count_if(~r).alias("b"))
    whole = cells.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))  # one row
    cells = cells.join(F.broadcast(whole), F.lit(True)).select("p_brand", "a", "b", (F.col("all_a") - F.col("a")).alias("c"), (F.col("all_b") - F.col("b")).alias("d"))
    return cells.select("*", F.round(exact.fisher_greater(*map(F.col, "abcd")), 7).alias("p"))


@query("m12_overlap", f"""
WITH s AS (SELECT l_partkey AS k, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS e FROM lineitem GROUP BY 1),
r AS (SELECT k, row_number() OVER (ORDER BY q DESC, k) AS rq, row_number() OVER (ORDER BY e DESC, k) AS re, count(*) OVER () AS n FROM s),
x AS (SELECT top, any_value(n) AS n, count(*) FILTER (WHERE rq <= top AND re <= top) AS shared FROM r, (SELECT unnest([10, 50, 200]) AS top) GROUP BY top)
SELECT top::INT AS top, n, shared, round(top * top / n, 6) AS expected, round({exact.sql_overlap_tail("shared", "top", "top", "n")}, 9) AS p FROM x""")
def overlap_null(t: Tables) -> DataFrame:
    """How many parts are in the top by quantity and by price, and the exact chance of as many in random rankings."""
    sums = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("e"))
    return pairs.top_overlap(sums, "l_partkey", "q", "e", [10, 50, 200]).withColumns({"expected": F.round("expected", 6), "p": F.round("p", 9)})


EVAL = "SELECT l_linestatus AS g, l_discount * 10 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem"


@query("m23_eval_binary", f"""
WITH s AS ({EVAL}), b AS (SELECT g, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM b WINDOW w AS (PARTITION BY g ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT g, sum(pos) AS P, sum(neg) AS N, sum(neg * (tp - pos / 2)) AS area, sum(pos * tp / (tp + fp)) AS ap, sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS TP_, sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS FP_ FROM c GROUP BY g)
SELECT g, CAST(P + N AS BIGINT) AS n, round(P / (P + N), 6) AS prevalence, round(area / (P * N), 6) AS auc, round(ap / P, 6) AS auprc, round((TP_ + N - FP_) / (P + N), 6) AS accuracy, round(2 * TP_ / (2 * TP_ + FP_ + P - TP_), 6) AS f1,
round((TP_ * (N - FP_) - FP_ * (P - TP_)) / sqrt((TP_ + FP_)::DOUBLE * P * N * (P - TP_ + N - FP_)), 6) AS mcc FROM m""")
def eval_binary(t: Tables) -> DataFrame:
    """M23."""
    df = t.lineitem.select(F.col("l_linestatus").alias("g"), (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(stats.eval_binary(df, ["g"], "p", "y").drop("nauprc"))


@query("m24_eval_continuous", "SELECT l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice / 1000), 6) AS pearson, round(1 - avg(pow(l_quantity - l_extendedprice / 1000, 2)) / var_pop(l_extendedprice / 1000), 5) AS r2, round(avg(abs(l_quantity - l_extendedprice / 1000)), 5) AS mae FROM lineitem GROUP BY 1")
def eval_continuous(t: Tables) -> DataFrame:
    """M24, A30."""
    df = t.lineitem.select("l_linestatus", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return stats.eval_continuous(df, ["l_linestatus"], "l_quantity", "y").select("l_linestatus", "n", F.round("pearson", 6).alias("pearson"), F.round("r2", 5).alias("r2"), F.round("mae", 5).alias("mae"))


@query("m25_head_kinds", "WITH long AS (UNPIVOT (SELECT l_quantity, l_discount, (l_returnflag = 'R')::INT::DOUBLE AS is_r, l_linenumber::DOUBLE AS num FROM lineitem) ON l_quantity, l_discount, is_r, num INTO NAME head VALUE v) SELECT head, count(*) AS n, CASE WHEN count(DISTINCT v) = 2 THEN 'binary' WHEN bool_and(v = floor(v)) AND max(v) < 100 THEN 'categorical' ELSE 'continuous' END AS kind FROM long GROUP BY head")
def head_kinds(t: Tables) -> DataFrame:
    """M25."""
    from varistra.operators.schema import unpivot

    wide = t.lineitem.select("l_quantity", "l_discount", (F.col("l_returnflag") == "R").cast("double").alias("is_r"), F.col("l_linenumber").cast("double").alias("num"))
    return stats.head_kinds(unpivot(wide, [], wide.columns), "head", "value")


@query("m26_disjoint_split", f"SELECT l_orderkey, l_linenumber, CASE WHEN {resample.sql_draw(1, 'l_orderkey', '1')} / {resample.PRIME}.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split FROM lineitem")
def split(t: Tables) -> DataFrame:
    """No order on both sides."""
    return resample.disjoint_split(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", 0.2, 1)


@query("m27_rarest_group", "WITH m AS (SELECT p_brand AS g, l_suppkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45), s AS (SELECT g, count(*) AS size FROM m GROUP BY 1 ORDER BY size DESC, g LIMIT 14) SELECT k, arg_min(g, {'s': size, 'g': g}) AS g FROM m JOIN s USING (g) GROUP BY k")
def rarest(t: Tables) -> DataFrame:
    """M27."""
    m = t.lineitem.filter("l_quantity > 45").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("k"), F.col("p_brand").alias("g"))
    return pairs.rarest_group(m, "k", "g", 14)


@query("w5_average_ranks", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2 AS r FROM orders")
def average_ranks(t: Tables) -> DataFrame:
    """W5."""
    return R.average_rank(t.orders, "o_orderdate", ["o_orderpriority"], "r").select("o_orderkey", "r")


@query("t1_state_machine", """
WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'not_started' AS state, 0 AS moves FROM events UNION ALL
SELECT f.user_id, e.i, CASE WHEN (state, s) IN (('not_started', 'pending'), ('pending', 'processing'), ('processing', 'complete'), ('processing', 'failed'), ('failed', 'pending')) THEN s ELSE state END,
moves + CAST((state, s) IN (('not_started', 'pending'), ('pending', 'processing'), ('processing', 'complete'), ('processing', 'failed'), ('failed', 'pending')) AS INT) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, arg_max(state, i) AS state, max(moves) AS moves FROM f GROUP BY 1""")
def machine(t: Tables) -> DataFrame:
    """T1 as a batch."""
    asked = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "complete").otherwise("failed")
    return state.final_states(t.events.withColumn("asked", asked), "user_id", "asked", ["ts", "event_id"])


STALE_MS, LATE_MS = 12 * 3600 * 1000, 3600 * 1000
ALLOWED = "('not_started', 'pending'), ('pending', 'processing'), ('processing', 'complete'), ('processing', 'failed'), ('failed', 'pending')"


@query("t1_timed_stream", f"""
WITH RECURSIVE h AS (SELECT epoch_us(max(ts)) // 1000 - {LATE_MS} - 1 AS h FROM events),
e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events, h WHERE epoch_us(ts) // 1000 < h),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'not_started' AS state, 0 AS moves, 0::BIGINT AS since FROM events
  UNION ALL
  SELECT user_id, i, CASE WHEN (now, s) IN ({ALLOWED}) THEN s ELSE now END, m + CAST((now, s) IN ({ALLOWED}) AS INT), CASE WHEN (now, s) IN ({ALLOWED}) THEN t ELSE since END
  FROM (SELECT f.user_id, e.i, e.s, e.t, CASE WHEN f.state = 'processing' AND f.since + {STALE_MS} < e.t THEN 'failed' ELSE f.state END AS now,
    f.moves + CAST(f.state = 'processing' AND f.since + {STALE_MS} < e.t AS INT) AS m,
    CASE WHEN f.state = 'processing' AND f.since + {STALE_MS} < e.t THEN f.since + {STALE_MS} ELSE f.since END AS since
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)),
l AS (SELECT user_id, arg_max(state, i) AS state, max(moves) AS moves, arg_max(since, i) AS since FROM f GROUP BY 1)
SELECT user_id, CASE WHEN state = 'processing' AND since + {STALE_MS} < h THEN 'failed' ELSE state END AS state,
  moves + CAST(state = 'processing' AND since + {STALE_MS} < h AS INT) AS moves,
  CASE WHEN state = 'processing' AND since + {STALE_MS} < h THEN since + {STALE_MS} ELSE since END AS at FROM l, h WHERE moves > 0""")
def timed_machine(t: Tables) -> DataFrame:
    """T1 on a stream that gets the events in four parts of a time each; its last moves are those of the batch."""
    source, out, log = (shared.scratch(t.spark, tag) for tag in ("events", "moves", "log"))
    asked = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "complete").otherwise("failed")
    events = t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), asked.alias("asked"))
    first, last = events.agg(F.coalesce(F.unix_seconds(F.min("ts")), F.lit(0)), F.coalesce(F.unix_seconds(F.max("ts")), F.lit(0))).first()
    part = F.least(F.lit(3), F.floor(4 * (F.unix_seconds("ts") - first) / max(1, last - first)))
    for i in range(4):
        events.filter(part == i).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    moves = state.timed_stream_states(stream, "user_id", "asked", "ts", "event_id", STALE_MS, f"{LATE_MS} milliseconds")
    moves.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()
    out = t.spark.read.schema("user_id long, state string, moves int, at long").parquet(out)
    return out.groupBy("user_id").agg(F.max(F.struct("moves", "state", "at")).alias("m")).select("user_id", "m.state", "m.moves", "m.at")


@query("t2_redelivery", "WITH a AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events QUALIFY nth <= 3), s AS (SELECT user_id, min(nth) FILTER (WHERE ok) AS won, count(*) AS n FROM a GROUP BY 1) SELECT user_id, CAST(coalesce(won, n) AS INT) AS tries, CASE WHEN won IS NOT NULL THEN 'done' WHEN n >= 3 THEN 'dead' ELSE 'open' END AS fate FROM s")
def redelivery(t: Tables) -> DataFrame:
    """T2, T4."""
    return state.redelivered(t.events.withColumn("ok", F.col("event_type") == "purchase"), "user_id", "ok", ["ts", "event_id"])
