"""Forward tests: do neighbours and features found with one version of group membership foretell what a later version adds?

Pairs of members that share a group are old if the first version has them, novel if only the second has. Each novel
pair has a control: its first member with another node, drawn by arithmetic, that it shares no group with in either version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistra.functions import exact
from varistra.operators import resample, stats
from varistra.operators.relational import benjamini_hochberg, group_pairs, medians
from varistra.sources import shared

TRIES = 20


def versioned_pairs(old: DataFrame, new: DataFrame, group: str, member: str, universe: DataFrame) -> DataFrame:
    """(a, b, kind) with a < b: 'old' or 'novel' pairs of members of the universe (a column ``member``)."""
    within = lambda df: df.select(group, member).distinct().join(universe.select(member).distinct(), member, "left_semi")
    pairs = lambda df, is_old: group_pairs(within(df), group, member).select("a", "b").withColumn("old", F.lit(is_old))
    both = pairs(old, 1).union(pairs(new, 0)).groupBy("a", "b").agg(F.max("old").alias("old"))
    return both.select("a", "b", F.when(F.col("old") == 1, "old").otherwise("novel").alias("kind"))


def with_controls(pairs: DataFrame, universe: DataFrame, member: str, seed: int) -> DataFrame:
    """Pairs and, for each novel one, a pair of kind 'random': the first of TRIES draws that is neither a pair nor one node.

    A novel pair all of whose draws fail has none. A control drawn for two novel pairs stands twice."""
    places, _ = shared.stored(resample.dense_places(universe.select(F.col(member).alias("other")).distinct(), "other"), "places")
    n = places.count()
    taken = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    draw = lambda t: resample.draw(seed, F.col("a"), F.col("b"), t) % max(1, n)

    def named(tried: DataFrame) -> DataFrame:
        tried = tried.join(places, "place").filter("other <> a")
        return tried.select("a", "b", "nth", F.least("a", "other").alias("ca"), F.greatest("a", "other").alias("cb"))

    # the first draw is good for nearly all, so only the others draw on
    novel = pairs.filter("kind = 'novel'").select("a", "b")
    first = named(novel.select("a", "b", F.lit(0).alias("nth"), draw(F.lit(0)).alias("place"))).join(taken, ["ca", "cb"], "left_anti")
    first, _ = shared.stored(first, "controls")
    rest = novel.join(first, ["a", "b"], "left_anti")
    tried = rest.select("a", "b", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(TRIES - 1)), draw)).alias("at", "place"))
    free = named(tried.select("a", "b", (F.col("at") + 1).alias("nth"), "place")).join(taken, ["ca", "cb"], "left_anti")
    nth = free.groupBy("a", "b").agg(F.min("nth").alias("nth"))
    later = named(nth.withColumn("place", draw(F.col("nth"))))
    control = first.select("ca", "cb").union(later.select("ca", "cb"))
    return pairs.select("a", "b", "kind").union(control.select("ca", "cb", F.lit("random")))


def neighbour_hits(pairs: DataFrame, edges: DataFrame, ks: list[int], seed: int, replicates: int = 200) -> DataFrame:
    """M15, test A: for each k how many novel, old and random pairs are among the k nearest neighbours of either node.

    (k, novel_hit, novel_total, old_hit, old_total, random_hit, random_total, odds_ratio, p, lo, hi): Fisher's one-sided p
    of novel against random, and a percentile interval of the novel share over resampled nodes. edges(source, target, rank)."""
    best = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min("rank").alias("rank"))
    ranked, _ = shared.stored(pairs.join(best, ["a", "b"], "left"), "ranked")
    each = ranked.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("hit", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("long"))
    sums = []
    for kind in ("novel", "old", "random"):
        of = F.col("kind") == kind
        sums += [F.coalesce(F.sum(F.when(of, F.col("hit"))), F.lit(0)).alias(f"{kind}_hit"), F.count_if(of).alias(f"{kind}_total")]
    counts = each.groupBy("k").agg(*sums)
    a, b = F.col("novel_hit"), F.col("novel_total") - F.col("novel_hit")
    c, d = F.col("random_hit"), F.col("random_total") - F.col("random_hit")
    odds = F.when((b * c) > 0, a * d / (b * c)).when(a * d > 0, float("inf"))
    tested = counts.withColumn("odds_ratio", odds).withColumn("p", F.when((a + b > 0) & (c + d > 0), exact.fisher_greater(a, b, c, d)))
    nodes = each.filter("kind = 'novel'").select("k", F.explode(F.array("a", "b")).alias("node"), "hit").groupBy("k", "node").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("t"))
    times = resample.poisson(resample.draw(seed, F.col("node"), F.col("rep")) / resample.PRIME)
    reps = nodes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("m", times)
    shares = reps.groupBy("k", "rep").agg((F.sum(F.col("m") * F.col("h")) / F.greatest(F.lit(1), F.sum(F.col("m") * F.col("t")))).alias("s"))
    ci = shares.groupBy("k").agg(F.percentile("s", F.lit(0.025)).alias("lo"), F.percentile("s", F.lit(0.975)).alias("hi"))
    return tested.join(ci, "k", "left")


def scored_pairs(pairs: DataFrame, vectors: DataFrame, key: str, score) -> DataFrame:
    """pairs(a, b, kind) with ``score`` of both nodes' vectors; pairs of nodes without a vector are left out."""
    side = lambda c: vectors.select(F.col(key).alias(c), F.col("v").alias(f"v{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "kind", score(F.col("va"), F.col("vb")).alias("score"))


def compare_kinds(scored: DataFrame) -> DataFrame:
    """M15, tests B and C: one row: for each kind n, mean and median of score; U, rank-biserial, p and Cohen's d of novel
    against random. Ranks come from counts by ranges of scores, not from one sorting task."""
    scored, _ = shared.stored(scored.filter("score is not null"), "scored")
    columns = []
    for kind in ("novel", "old", "random"):
        value = F.when(F.col("kind") == kind, F.col("score"))
        columns += [F.count(value).alias(f"{kind}_n"), F.avg(value).alias(f"{kind}_mean"), F.var_samp(value).alias(f"{kind}_var")]
    about = scored.agg(*columns)
    middle = medians(scored, "score", ["kind"]).agg(*[F.max(F.when(F.col("kind") == kind, F.col("median"))).alias(f"{kind}_median") for kind in ("novel", "old", "random")])
    two = scored.filter("kind in ('novel', 'random')")
    ranks = stats.mann_whitney(two, "score", F.col("kind") == "novel").select("u", "rank_biserial", "p")
    n1, n2 = F.col("novel_n"), F.col("random_n")
    pooled = F.sqrt(((n1 - 1) * F.col("novel_var") + (n2 - 1) * F.col("random_var")) / (n1 + n2 - 2))
    d = stats.safe_ratio(F.col("novel_mean") - F.col("random_mean"), pooled)
    found = about.join(F.broadcast(middle), F.lit(True)).join(F.broadcast(ranks), F.lit(True)).withColumn("cohens_d", d)  # a row each
    return found.select(*[f"{kind}_{c}" for kind in ("novel", "old", "random") for c in ("n", "mean", "median")], "u", "rank_biserial", "p", "cohens_d")


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is shorter than 1e-10."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-10) | (nb < 1e-10), 0.0).otherwise(dot(a, b) / (na * nb))


def weighted_sum(weights: Column):
    """Of two vectors: sum of w |a + b| by sum of w, for weights of the features that count (0 for others)."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return lambda a, b: F.aggregate(F.zip_with(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") + q.cast("double"))), weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) / total


def new_group_features(old: DataFrame, new: DataFrame, group: str, member: str, vectors: DataFrame, key: str, least: int, fdr: float = 0.05) -> DataFrame:
    """M15, test D: (group, members, n_sig, mean_abs_effect) of groups that only the second version has, with at least ``least`` members
    that have a vector: features whose mean differs from all other nodes' at a false-discovery rate under fdr within the group."""
    only = new.select(group).distinct().join(old.select(group).distinct(), group, "left_anti")
    inside = new.select(group, member).distinct().join(only, group, "left_semi").join(vectors.select(F.col(key).alias(member), "v"), member)
    long = lambda df, *by: df.select(*by, F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = sums(long(vectors), "i").select("i", F.col("n").alias("an"), F.col("s").alias("as"), F.col("q").alias("aq"))  # a row for each feature
    each = sums(long(inside, group), group, "i").filter(F.col("n") >= least).join(whole, "i")
    each = each.withColumns({"rest_n": F.col("an") - F.col("n"), "rest_s": F.col("as") - F.col("s"), "rest_q": F.col("aq") - F.col("q")}).filter("rest_n >= 2 and n >= 2")
    tested = stats.welch_columns(each)
    tested = tested.withColumn("p", F.coalesce(stats.special.t_p(F.col("t"), F.col("dof")), F.lit(1.0)))
    tested, _ = shared.stored(tested, "tested")  # sums of doubles may differ in their last digits when they are worked out again
    rated = benjamini_hochberg(tested, "p", "i", by=[group])
    hit = F.col("fdr") < fdr
    return rated.groupBy(group).agg(F.max("n").alias("members"), F.count_if(hit).alias("n_sig"), F.coalesce(F.avg(F.when(hit, F.abs("diff"))), F.lit(0.0)).alias("mean_abs_effect"))
