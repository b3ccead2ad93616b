"""Mixing sources to target weights: subset-sum budget fitting.

Each source gets a target number of words (shares by weight, none above ``cap`` times the source). Whole passes over
the source are taken first. For what is left, documents are counted by exact length: each length gives the same share
of its documents, lengths with the largest remainder one more, until the open budget is at most ``WINDOW`` words; a
bounded knapsack over the remaining counts then comes as near to the budget as any choice of documents can. Which
documents of a length are taken follows a seeded hash of doc_id, so reruns agree.

Only counts by (source, length) meet in one task; documents are ranked within (source, length, one of ``BUCKETS``
hash ranges), whose counts tell how many each range gives, so no task sorts a whole source or a whole length.

Defined results. A null or empty text has size 0 and takes no words. A null source is a source of its own, last in
order. Sources of size 0 have target 0. Repeated rows are documents of their own; which of two equal rows is taken
cannot be told apart. Columns named ``mix_...`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varistra.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
WINDOW = 1 << 16
BUCKETS = 256


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Words for each source: share of all sizes by weight; what goes over cap times a size is shared out again."""
    out, active, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        active -= set(over)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near below budget as the knapsack finds."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    exact = counts * (budget / total)
    taken = np.where(lengths > 0, np.floor(exact).astype(np.int64), 0)
    left = budget - int((taken * lengths).sum())
    while left < 0:  # only by rounding of floats
        at = int(np.flatnonzero(taken * (lengths > 0))[0])
        taken[at] -= 1
        left += int(lengths[at])
    for i in np.argsort(-(exact - taken), kind="stable"):
        if left <= window:
            break
        if 0 < lengths[i] <= left and taken[i] < counts[i]:
            taken[i] += 1
            left -= int(lengths[i])
    left = min(left, int(((counts - taken) * lengths).sum()))
    reached, via = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64)
    reached[0] = True
    items: list[tuple[int, int]] = []
    order = np.random.default_rng(seed).permutation(np.flatnonzero((lengths > 0) & (lengths <= left) & (taken < counts)))
    for i in order:
        rest, size = min(int(counts[i] - taken[i]), left // int(lengths[i])), 1
        while rest and not reached[left]:
            many = min(size, rest)
            weight = many * int(lengths[i])
            if weight <= left:
                new = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
                via[new] = len(items)
                reached[new] = True
                items.append((int(i), many))
            rest -= many
            size *= 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, many = items[via[at]]
        taken[i] += many
        at -= many * int(lengths[i])
    return taken


def with_size(docs: DataFrame) -> DataFrame:
    """docs and mix_size, the number of words of each text."""
    return docs.withColumn("mix_size", F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long"))


def mix_sized(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """rows(doc_id, source, mix_size, ...) with mix_source_size, mix_target and mix_copies (0, 1, ...). weights repeat over the sources in order."""
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("mix_key")
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"))
    keyed = rows.drop("mix_key", "mix_hash", "mix_bucket", "mix_source_size", "mix_target", "mix_copies").select("*", key, spread.alias("mix_hash")).withColumn("mix_bucket", F.pmod("mix_hash", F.lit(BUCKETS)).cast("int"))
    counts = common.materialise(keyed.groupBy("mix_key", "mix_size", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_n")), "lengths")

    sizes = counts.groupBy("mix_key").agg(F.sum(F.col("mix_size") * F.col("mix_n")).alias("size")).collect()  # a row for each source
    sizes.sort(key=lambda r: (r.mix_key == "null", r.mix_key))
    goals = targets([r.size for r in sizes], [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    plan = []
    for r, goal in zip(sizes, goals):
        passes = int(goal // r.size) if r.size else 0
        plan.append((r.mix_key, r.size, float(goal), passes, round(goal - passes * r.size)))
    goals = spark.createDataFrame(plan, "mix_key string, mix_source_size long, mix_target double, mix_passes int, mix_budget long")

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("mix_size")
        table["mix_take"] = fit(table.mix_size.to_numpy(), table.mix_n.to_numpy(), int(table.mix_budget.iloc[0]), seed)
        return table[["mix_key", "mix_size", "mix_source_size", "mix_target", "mix_passes", "mix_take"]]

    hist = counts.groupBy("mix_key", "mix_size").agg(F.sum("mix_n").alias("mix_n")).join(F.broadcast(goals), "mix_key")  # a row for each source
    chosen = hist.groupBy("mix_key").applyInPandas(choose, "mix_key string, mix_size long, mix_source_size long, mix_target double, mix_passes int, mix_take long")
    before = F.sum("mix_n").over(Window.partitionBy("mix_key", "mix_size").orderBy("mix_bucket")) - F.col("mix_n")
    quota = counts.withColumn("mix_before", before).join(chosen, ["mix_key", "mix_size"])
    quota = quota.withColumn("mix_quota", F.greatest(F.lit(0), F.least("mix_n", F.col("mix_take") - F.col("mix_before")))).drop("mix_n", "mix_before", "mix_take")
    place = F.row_number().over(Window.partitionBy("mix_key", "mix_size", "mix_bucket").orderBy("mix_hash", "doc_id"))
    found = keyed.join(quota, ["mix_key", "mix_size", "mix_bucket"]).withColumn("mix_place", place)
    copies = F.when(F.col("mix_size") > 0, F.col("mix_passes") + (F.col("mix_place") <= F.col("mix_quota")).cast("int")).otherwise(F.lit(0))
    return found.withColumn("mix_copies", copies).select(*[c for c in rows.columns if c not in ("mix_source_size", "mix_target", "mix_copies")], "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents: every row of docs as many times as the mix takes it, with the columns of docs, whatever their names."""
    # docs' columns travel as one, so that none meets a helper's name
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("mix_row"))
    mixed = mix_sized(with_size(rows).drop("text"), weights, share, cap, seed)
    repeated = mixed.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies"))))
    return repeated.select("mix_row.*")
