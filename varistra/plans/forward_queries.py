"""Forward tests: parts that share an order, with the finished orders as the first version and all orders as the second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.functions import exact
from varistra.operators import forward, resample
from varistra.plans.catalog import Tables, query
from varistra.plans.relational_queries import KNN, edges
from varistra.sources import shared

KS = [5, 10]
SEED, REPLICATES = 23, 200
WEIGHTS = [1.0 if i % 3 == 0 else 0.0 for i in range(64)]

PAIRS = f"""m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m, o_orderstatus = 'F' AS old FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = l_partkey),
pos AS (SELECT x.m AS a, y.m AS b, CASE WHEN bool_or(x.old) THEN 'old' ELSE 'novel' END AS kind FROM m x JOIN m y ON x.g = y.g AND x.m < y.m GROUP BY 1, 2),
place AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings),
tries AS (SELECT a, b, nth, {resample.sql_draw(SEED, "a", "b", "nth")} % (SELECT count(*) FROM embeddings) AS place FROM pos, (SELECT unnest(range({forward.TRIES})) AS nth) WHERE kind = 'novel'),
cand AS (SELECT t.a, t.b, t.nth, least(t.a, p.vec_id) AS ca, greatest(t.a, p.vec_id) AS cb FROM tries t JOIN place p USING (place) WHERE p.vec_id <> t.a),
control AS (SELECT c.a, c.b, arg_min({{'ca': ca, 'cb': cb}}, nth) AS c FROM cand c LEFT JOIN pos ON pos.a = c.ca AND pos.b = c.cb WHERE pos.a IS NULL GROUP BY c.a, c.b),
pairs AS (SELECT a, b, kind FROM pos UNION ALL SELECT c.ca, c.cb, 'random' FROM control)"""


def versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Members of each version: (g, vec_id)."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("vec_id"))
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("g"))
    every = lines.join(t.orders.select(F.col("o_orderkey").alias("g")), "g", "left_semi")
    return every.join(done, "g", "left_semi"), every


def pairs_of(t: Tables) -> DataFrame:
    found = forward.versioned_pairs(*versions(t), "g", "vec_id", t.embeddings)
    found, _ = shared.stored(found, "pairs")
    return shared.stored(forward.with_controls(found, t.embeddings, "vec_id", SEED), "pairs")[0]


@query("m15_pairs", f"WITH {PAIRS} SELECT a, b, kind FROM pairs")
def all_pairs(t: Tables) -> DataFrame:
    """Old and novel pairs, and controls."""
    return pairs_of(t)


@query("m15_neighbour_hits", f"""
WITH {KNN}, {PAIRS},
best AS (SELECT least(source, target) AS a, greatest(source, target) AS b, min(rank) AS rank FROM top GROUP BY 1, 2),
each AS (SELECT k, pairs.a, pairs.b, kind, coalesce(rank <= k, false)::INT AS hit FROM pairs LEFT JOIN best USING (a, b), (SELECT unnest({KS}) AS k)),
s AS (SELECT k, {", ".join(f"count(*) FILTER (WHERE kind = '{x}' AND hit = 1) AS {x}_hit, count(*) FILTER (WHERE kind = '{x}') AS {x}_total" for x in ("novel", "old", "random"))} FROM each GROUP BY k),
nodes AS (SELECT k, node, sum(hit) AS h, count(*) AS t FROM (SELECT k, unnest([a, b]) AS node, hit FROM each WHERE kind = 'novel') GROUP BY ALL),
reps AS (SELECT k, rep, h, t, {resample.sql_draw(SEED, "node", "rep")} / {resample.PRIME}.0::DOUBLE AS u FROM nodes, (SELECT unnest(range(1, {REPLICATES + 1})) AS rep)),
timed AS (SELECT k, rep, h, t, CASE {" ".join(f"WHEN u < {c!r} THEN {i}" for i, c in enumerate(resample.POISSON))} ELSE {len(resample.POISSON)} END AS m FROM reps),
shares AS (SELECT k, rep, sum(m * h) / greatest(1, sum(m * t)) AS x FROM timed GROUP BY k, rep), ci AS (SELECT k, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM shares GROUP BY k)
SELECT k::INT AS k, novel_hit, novel_total, old_hit, old_total, random_hit, random_total,
       round(novel_hit * (random_total - random_hit) / nullif((novel_total - novel_hit) * random_hit, 0), 8) AS odds_ratio,
       round({exact.sql_overlap_tail("novel_hit", "novel_total", "(novel_hit + random_hit)", "(novel_total + random_total)")}, 8) AS p, round(lo, 8) AS lo, round(hi, 8) AS hi FROM s JOIN ci USING (k)""")
def neighbour_hits(t: Tables) -> DataFrame:
    """M15, test A, M14."""
    found = forward.neighbour_hits(pairs_of(t), edges(t, max(KS)), KS, SEED, REPLICATES)
    return found.select(*[F.round(c, 8).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


def sql_compare(score: str) -> str:
    kinds = ("novel", "old", "random")
    return f"""
WITH {PAIRS}, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT kind, {score} AS score FROM pairs JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b),
r AS (SELECT kind, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s WHERE kind <> 'old'),
u AS (SELECT sum(k) FILTER (WHERE kind = 'novel') - count(*) FILTER (WHERE kind = 'novel') * (count(*) FILTER (WHERE kind = 'novel') + 1) / 2 AS u FROM r),
a AS (SELECT {", ".join(f"count(*) FILTER (WHERE kind = '{x}') AS {x}_n, avg(score) FILTER (WHERE kind = '{x}') AS {x}_mean, median(score) FILTER (WHERE kind = '{x}') AS {x}_median, var_samp(score) FILTER (WHERE kind = '{x}') AS {x}_var" for x in kinds)} FROM s)
SELECT {", ".join(f"{x}_n, round({x}_mean, 6) AS {x}_mean, round({x}_median, 6) AS {x}_median" for x in kinds)}, round(u, 1) AS u, round(1 - 2 * u / (novel_n * random_n), 6) AS rank_biserial,
       round((novel_mean - random_mean) / sqrt(((novel_n - 1) * novel_var + (random_n - 1) * random_var) / (novel_n + random_n - 2)), 6) AS cohens_d FROM a, u"""


def compared(t: Tables, score) -> DataFrame:
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    scored = forward.scored_pairs(pairs_of(t), vectors, "vec_id", score).withColumn("score", F.round("score", 9))
    found = forward.compare_kinds(scored).drop("p")
    return found.select(*[F.round(c, 1 if c == "u" else 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


@query("m15_likeness", sql_compare("round(list_cosine_similarity(x.v, y.v), 9)"))
def likeness(t: Tables) -> DataFrame:
    """M15, test B: cosines of novel pairs against controls."""
    return compared(t, forward.cosine)


@query("m15_feature_scores", sql_compare(f"round(list_sum([abs(x.v[i] + y.v[i]) * ({WEIGHTS})[i] FOR i IN range(1, 65)]) / {sum(WEIGHTS)}, 9)"))
def feature_scores(t: Tables) -> DataFrame:
    """M15, test C, M16: sums over chosen features."""
    return compared(t, forward.weighted_sum(F.array(*map(F.lit, WEIGHTS))))


@query("m15_new_groups")
def new_groups(t: Tables) -> DataFrame:
    """M15, test D: features of customers' parts, for customers who only have unfinished orders."""
    old, new = (df.join(t.orders.select(F.col("o_orderkey").alias("g"), "o_custkey"), "g") for df in versions(t))
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    found = forward.new_group_features(old, new, "o_custkey", "vec_id", vectors, "vec_id", 3)
    return found.withColumn("mean_abs_effect", F.round("mean_abs_effect", 8))
