"""Ridge regression, principal components, clustering: over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.operators import clustering, linear
from varistra.plans.catalog import Tables, query

FOLDS = 5
ALPHAS = [10 ** (-2 + 8 * i / 49) for i in range(50)]


@query("m18_product_sums", """
WITH x AS (SELECT CAST(vec_id % 5 AS INT) AS fold, unnest(list_concat(embedding::DOUBLE[], [label::DOUBLE, 1.0])) AS x, unnest(range(len(embedding) + 2)) AS i, vec_id FROM embeddings)
SELECT a.fold, a.i::INT AS i, b.i::INT AS j, round(sum(a.x * b.x), 5) AS s FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def product_sums(t: Tables) -> DataFrame:
    """The sums that all fits come from."""
    df = t.embeddings
    tiles = linear.product_sums(df, "embedding", "label", F.pmod("vec_id", F.lit(FOLDS)))
    entries = linear.product_entries(tiles, linear.width_of(df, "embedding") + 2)
    return entries.select("fold", "i", "j", F.round("s", 5).alias("s"))


@query("m18_ridge")
def ridge(t: Tables) -> DataFrame:
    """5 folds, 50 alphas from 0.01 to a million, and the weights of the best."""
    fits = linear.ridge(t.embeddings, "embedding", "label", F.pmod("vec_id", F.lit(FOLDS)), FOLDS, ALPHAS)
    return fits.select("fold", F.round("alpha", 6).alias("alpha"), F.round("r2", 8).alias("r2"), F.transform("weights", lambda w: F.round(w, 8)).alias("weights"))


@query("m20_variance_kept", """
WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT count(*) AS rows, round(sum(v), 6) AS total, round(sum(v), 6) AS along FROM (SELECT i, var_samp(x) AS v FROM x GROUP BY i), (SELECT 1) GROUP BY ALL""".replace("count(*) AS rows", "(SELECT count(*) FROM embeddings) AS rows"))
def variance_kept(t: Tables) -> DataFrame:
    """The components' variances add up to the columns', and so do those of the rows projected on all of them."""
    parts = linear.principal_components(t.embeddings, "embedding", 1 << 20)
    scores = linear.projected(t.embeddings, "embedding", parts).select(F.posexplode("scores").alias("component", "x"))
    along = scores.groupBy("component").agg(F.var_samp("x").alias("v")).agg(F.round(F.sum("v"), 6).alias("along"))
    total = parts.agg(F.round(F.sum("variance"), 6).alias("total"))
    return t.embeddings.agg(F.count(F.lit(1)).alias("rows")).join(total, F.lit(True)).join(along, F.lit(True))  # a row each


@query("m20_components")
def components(t: Tables) -> DataFrame:
    """50 components."""
    parts = linear.principal_components(t.embeddings, "embedding", 50)
    return parts.select("component", F.round("variance", 8).alias("variance"), F.round("share", 8).alias("share"), F.transform("loadings", lambda x: F.round(x, 6)).alias("loadings"))


@query("m19_hierarchy")
def hierarchy(t: Tables) -> DataFrame:
    """The tree of each label's vectors, Ward's method on cosine distances."""
    return clustering.hierarchy(t.embeddings, "label", "vec_id", "embedding", "ward").withColumn("height", F.round("height", 8))


@query("m19_first_merges", """
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS d FROM x a JOIN x b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, round(min(d), 6) AS height, arg_min(a, d) AS a, arg_min(b, d) AS b FROM d GROUP BY label""")
def first_merges(t: Tables) -> DataFrame:
    """Each tree begins with its closest two vectors."""
    tree = clustering.hierarchy(t.embeddings, "label", "vec_id", "embedding", "average")
    leaves = tree.filter("kind = 'leaf'")
    first = tree.filter("kind = 'merge' and place = 0").select("label", F.round("height", 6).alias("height"), F.col("left").alias("l"), F.col("right").alias("r"))
    name = lambda c, as_: leaves.select(F.col("label"), F.col("left").alias(c), F.col("key").alias(as_))
    return first.join(name("l", "a"), ["label", "l"]).join(name("r", "b"), ["label", "r"]).select("label", "height", "a", "b")


@query("m19_clusters")
def clusters(t: Tables) -> DataFrame:
    """Each label's tree of average distances cut in four."""
    return clustering.cut(clustering.hierarchy(t.embeddings, "label", "vec_id", "embedding", "average"), "label", 4)
