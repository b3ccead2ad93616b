"""Retrieval and enrichment over neighbour pairs and group membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varistra.functions import exact
from varistra.operators.stats import safe_ratio
from varistra.sources import shared


def labelled_edges(edges: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """edges(source, target, ...) with source_<label> and neighbor_<label>."""
    a = labels.select(F.col(key).alias("source"), F.col(label).alias(f"source_{label}"))
    b = labels.select(F.col(key).alias("target"), F.col(label).alias(f"neighbor_{label}"))
    return edges.join(a, "source").join(b, "target")


def same_label_enrichment(edges: DataFrame, labels: DataFrame, key: str, label: str, ks: list[int]) -> DataFrame:
    """(k, pairs, observed, base, fold): share of neighbours with the source's label against chance, for each k."""
    joined = labelled_edges(edges, labels, key, label).select("rank", (F.col(f"source_{label}") == F.col(f"neighbor_{label}")).alias("hit"), F.explode(F.array(*map(F.lit, ks))).alias("k")).filter("rank <= k")
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    base = sizes.agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("base"))
    s = joined.groupBy("k").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("hit").cast("double")).alias("observed"))
    return s.crossJoin(F.broadcast(base)).select("k", "pairs", "observed", "base", safe_ratio(F.col("observed"), F.col("base")).alias("fold"))  # one row


def per_class_lift(edges: DataFrame, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(label, members, precision, base, lift); base (n - 1) / (M - 1)."""
    joined = labelled_edges(edges.filter(F.col("rank") <= k), labels, key, label)
    sizes = labels.groupBy(F.col(label)).agg(F.count(F.lit(1)).alias("members"))
    sizes = sizes.withColumn("base", (F.col("members") - 1) / (F.sum("members").over(Window.partitionBy()) - 1))
    got = joined.groupBy(F.col(f"source_{label}").alias(label)).agg(F.avg((F.col(f"source_{label}") == F.col(f"neighbor_{label}")).cast("double")).alias("precision"))
    return got.join(sizes, label).select(label, "members", "precision", "base", safe_ratio(F.col("precision"), F.col("base")).alias("lift"))


def retrieval(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Micro and macro precision, recall and F1 of pairs(a, b) against true ones; macro over the nodes of true pairs."""
    p, t = predicted.select("a", "b").distinct(), truth.select("a", "b").distinct()
    hits = p.join(t, ["a", "b"], "left_semi")
    both = lambda df: df.select(F.col("a").alias("node")).union(df.select("b"))
    count = lambda df, name: both(df).groupBy("node").agg(F.count(F.lit(1)).alias(name))
    nodes = count(t, "t").join(count(p, "p"), "node", "left").join(count(hits, "h"), "node", "left").fillna(0)
    pr, re = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0), F.col("h") / F.col("t")
    f1 = F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0)
    macro = nodes.agg(F.avg(pr).alias("macro_precision"), F.avg(re).alias("macro_recall"), F.avg(f1).alias("macro_f1"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias(name))
    one = n(p, "np").crossJoin(n(t, "nt")).crossJoin(n(hits, "nh")).crossJoin(macro)  # one row each
    return one.select(safe_ratio(F.col("nh"), F.col("np")).alias("micro_precision"), safe_ratio(F.col("nh"), F.col("nt")).alias("micro_recall"), safe_ratio(2 * F.col("nh"), F.col("np") + F.col("nt")).alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")


def retrieval_by_label(predicted: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """As ``retrieval``, where all pairs of nodes with one label are true: they are counted, never made.

    A node is in as many true pairs as its label has other nodes, and a predicted pair is true if its nodes' labels are equal.
    Keys of labels are unique; nodes with a null label, and pairs of a node with itself, are in no true pair."""
    named = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("node"), F.col(label).alias("lab"))
    members = named.groupBy("lab").agg((F.count(F.lit(1)) - 1).alias("t"))
    p = predicted.select("a", "b").distinct()
    side = lambda c: named.select(F.col("node").alias(c), F.col("lab").alias(f"lab_{c}"))
    hit = (F.col("lab_a") == F.col("lab_b")) & (F.col("a") != F.col("b"))
    judged = p.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce(hit, F.lit(False)).cast("long").alias("h"))
    judged, _ = shared.stored(judged, "judged")
    by_node = judged.select(F.explode(F.array("a", "b")).alias("node"), "h").groupBy("node").agg(F.count(F.lit(1)).alias("p"), F.sum("h").alias("h"))
    nodes = named.join(members.filter("t > 0"), "lab").join(by_node, "node", "left").fillna(0, ["p", "h"])
    pr, re = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0), F.col("h") / F.col("t")
    f1 = F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0)
    macro = nodes.agg(F.avg(pr).alias("macro_precision"), F.avg(re).alias("macro_recall"), F.avg(f1).alias("macro_f1"), (F.sum("t") / 2).alias("nt"))
    micro = judged.agg(F.count(F.lit(1)).cast("double").alias("np"), F.coalesce(F.sum("h"), F.lit(0)).cast("double").alias("nh"))
    one = micro.join(F.broadcast(macro), F.lit(True))  # one row each
    return one.select(safe_ratio(F.col("nh"), F.col("np")).alias("micro_precision"), safe_ratio(F.col("nh"), F.col("nt")).alias("micro_recall"), safe_ratio(2 * F.col("nh"), F.col("np") + F.col("nt")).alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")


def compare_sets(old: DataFrame, new: DataFrame, group: str, member: str) -> DataFrame:
    """(group, shared, added, removed, jaccard) of two versions of group members."""
    o, n = old.select(group, member).distinct().withColumn("o", F.lit(1)), new.select(group, member).distinct().withColumn("n", F.lit(1))
    s = o.join(n, [group, member], "full").groupBy(group).agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("shared"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"))
    return s.withColumn("jaccard", F.col("shared") / (F.col("shared") + F.col("added") + F.col("removed")))


def rarest_group(members: DataFrame, member: str, group: str, top: int) -> DataFrame:
    """(member, group): of a member's groups among the ``top`` largest, the rarest; ties by name."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), group).limit(top)
    return members.join(sizes, group).groupBy(member).agg(F.min_by(group, F.struct("size", group)).alias(group))


def recurrence(hits: DataFrame, entry: str, group: str, effect: str) -> DataFrame:
    """(entry, sets, mean_effect, score, names): in how many sets an entry recurs, and sets times mean absolute effect."""
    s = hits.groupBy(entry).agg(F.count(F.lit(1)).alias("sets"), F.avg(effect).alias("mean_effect"), F.avg(F.abs(effect)).alias("a"), F.sort_array(F.collect_set(group)).alias("names"))
    return s.select(entry, "sets", "mean_effect", (F.col("sets") * F.col("a")).alias("score"), "names")


def top_overlap(df: DataFrame, key: str, first: str, second: str, tops: list[int]) -> DataFrame:
    """(top, n, shared, expected, p): for each of tops how many of the first rows by two scores are the same, how many would be by
    chance, and the exact chance of as many or more.

    Higher scores come first, ties by key; null scores count as the lowest. Only the largest top of either score is kept and
    joined, so no ranking of all rows is made."""
    most = max(tops)
    ranked = []
    for score in (first, second):
        best = df.select(key, F.col(score).alias("s")).orderBy(F.desc_nulls_last("s"), key).limit(most)  # at most ``most`` rows
        ranked.append(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("s"), key))).select(key, "place"))
    both = ranked[0].join(ranked[1].withColumnRenamed("place", "other"), key).select(F.greatest("place", "other").alias("needs"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    sized = total.select("n", F.explode(F.array(*map(F.lit, tops))).alias("top"))
    hits = both.groupBy().agg(F.collect_list("needs").alias("needs"))  # at most ``most`` numbers
    out = sized.join(F.broadcast(hits), F.lit(True)).withColumn("shared", F.size(F.filter("needs", lambda x: x <= F.col("top"))).cast("long"))
    top = F.least(F.col("top").cast("long"), F.col("n"))
    return out.select("top", "n", "shared", (top * top / F.col("n")).alias("expected"), exact.overlap_tail(F.col("shared"), top, top, F.col("n")).alias("p"))
