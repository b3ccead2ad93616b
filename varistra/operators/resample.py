"""Matched controls, bootstrap and permutation by arithmetic draws: seeded, order-free, the same on every cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Draws are numbers under this prime.
PRIME = 2147483647
#: Multipliers and addends of a draw.
FACTOR, SLOPE, SHIFT, STEP = 48271, 40692, 12345, 11


def draw(seed: int, *columns: Column) -> Column:
    """A number from 0 to PRIME - 1 of whole-number columns: each turns the number so far by a product modulo PRIME."""
    s = F.lit(seed).cast("long")
    for c in columns:
        c = F.pmod(c.cast("long"), F.lit(PRIME))
        s = ((s + c) % PRIME * ((c * SLOPE + SHIFT) % PRIME) % PRIME * FACTOR + STEP) % PRIME
    return s


def sql_draw(seed: int, *columns: str) -> str:
    """The same as SQL."""
    s = str(seed)
    for c in columns:
        s = f"(((({s} + {c}) % {PRIME}) * ((({c}) * {SLOPE} + {SHIFT}) % {PRIME}) % {PRIME} * {FACTOR} + {STEP}) % {PRIME})"
    return s


def number(df: DataFrame, column: str) -> Column:
    """A column as a whole number to draw by: itself, or a hash of values of other types."""
    return F.col(column) if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column)


def matched_controls(sources: DataFrame, candidates: DataFrame, bucket: list[str], key: str, seed: int, tries: int = 20) -> DataFrame:
    """M7: (key, control): for each source one other candidate of its bucket, by a hashed place among the bucket's candidates.

    A source's tries are places drawn one after another; the first that isn't the source itself counts, so only
    sources alone in their bucket have none. Candidates are numbered within their bucket and joined by place."""
    w = Window.partitionBy(*bucket).orderBy(key)
    table = candidates.select(*bucket, F.col(key).alias("control"), (F.row_number().over(w) - 1).alias("place"))
    sizes = candidates.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"))
    tried = sources.join(sizes, bucket).select(*bucket, key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: draw(seed, number(sources, key), i) % F.col("size"))).alias("nth", "place"))
    ok = tried.join(table, [*bucket, "place"]).filter(F.col("control") != F.col(key))
    return ok.groupBy(key).agg(F.min_by("control", "nth").alias("control"))


def collapse(df: DataFrame, group: str, key: str, repeats: int, seed: int) -> DataFrame:
    """(repeat, group, key): one row of each group in each repeat."""
    many = df.select(group, key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    drawn, kind = draw(seed, F.col("repeat"), number(df, key)), dict(df.dtypes)[key]
    if kind in ("tinyint", "smallint", "int"):  # one number for draw and key, so that rows are hashed, not sorted
        place = F.shiftleft(drawn, 32) + F.col(key) + (1 << 31)
    elif kind == "bigint":
        place = drawn.cast("decimal(10,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col(key).cast("decimal(20,0)")
    else:
        place = F.struct(drawn, key)
    return many.groupBy("repeat", group).agg(F.min_by(key, place).alias(key))


def disjoint_split(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Df with split: train or test; all rows of a group go the same way, about ``share`` of the groups to test."""
    return df.withColumn("split", F.when(draw(seed, number(df, group), F.lit(1)) / PRIME < share, "test").otherwise("train"))


#: The chances that a Poisson(1) number is at most 0, 1, ... 8.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402]


def poisson(u: Column) -> Column:
    """The Poisson(1) number of a uniform one."""
    times = F.lit(len(POISSON))
    for i in range(len(POISSON) - 1, -1, -1):
        times = F.when(u < POISSON[i], i).otherwise(times)
    return times


def bootstrap(df: DataFrame, group: str, value: str, replicates: int, seed: int, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """A row for each stratum (one row without ``by``): groups, mean, lo, hi: percentile interval of the mean over resampled
    groups; no interval under ``least`` groups.

    Groups are reduced to sums first. Each replicate takes each group a Poisson(1) number of times by a hash, so the
    replicates are sums over groups in one aggregate and nothing is collected."""
    by = by or []
    sums = df.filter(F.col(value).isNotNull()).groupBy(*by, group).agg(F.avg(F.col(value).cast("double")).alias("m"))
    times = poisson(draw(seed, number(df, group), F.col("rep")) / PRIME)
    reps = sums.select(*by, group, "m", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("k", times)
    means = reps.groupBy(*by, "rep").agg((F.sum(F.col("k") * F.col("m")) / F.greatest(F.lit(1), F.sum("k"))).alias("b"))
    ci = means.groupBy(*by).agg(F.percentile("b", F.lit(0.025)).alias("lo"), F.percentile("b", F.lit(0.975)).alias("hi"))
    point = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.avg("m").alias("mean"))
    both = point.join(ci, by) if by else point.crossJoin(ci)  # one row each
    return both.select(*by, "groups", "mean", *[F.when(F.col("groups") >= least, F.col(c)).alias(c) for c in ("lo", "hi")])


def pair_score(pairs: DataFrame, z: DataFrame, weights: DataFrame) -> DataFrame:
    """(u, v, score) of pairs(u, v): sum of w * |z_u + z_v| over weighted features, by sum of w; z(node, feature, z), weights(feature, w)."""
    chosen = z.join(weights, "feature")
    x = chosen.select(F.col("node").alias("u"), "feature", "w", F.col("z").alias("zu"))
    y = chosen.select(F.col("node").alias("v"), "feature", F.col("z").alias("zv"))
    both = pairs.select("u", "v").join(x, "u").join(y, ["v", "feature"])
    return both.groupBy("u", "v").agg((F.sum(F.col("w") * F.abs(F.col("zu") + F.col("zv"))) / F.sum("w")).alias("score"))


def split_halves(long: DataFrame, group: str, feature: str, value: str, repeats: int, half: Column | None = None, seed: int = 0) -> DataFrame:
    """(repeat, features, rho): groups fall into two halves anew in each repeat; Spearman correlation of the halves' mean by feature.

    half: true for the first half, an expression of the group and ``repeat``; a hash of both where none is given. Means are stored
    before they are ranked: sums of doubles differ in their last digits when they are worked out again."""
    from varistra.operators.stats import spearman
    from varistra.sources import shared

    half = draw(seed, number(long, group), F.col("repeat")) % 2 == 0 if half is None else half
    means = long.groupBy(group, feature).agg(F.avg(F.col(value).cast("double")).alias("m"))
    many = means.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("half", half)
    sides = many.groupBy("repeat", feature).agg(F.avg(F.when(F.col("half"), F.col("m"))).alias("a"), F.avg(F.when(~F.col("half"), F.col("m"))).alias("b"))
    both, _ = shared.stored(sides.filter("a is not null and b is not null"), "halves")
    return spearman(both, ["repeat"], "a", "b", 2).select("repeat", F.col("n").alias("features"), F.col("r").alias("rho"))


#: Turns of a permutation.
ROUNDS = 24


def draws(seed: int, *columns):
    """``draw`` over numpy arrays."""
    import numpy as np

    s = np.int64(seed)
    for c in columns:
        c = np.asarray(c, np.int64) % PRIME
        s = ((s + c) % PRIME * ((c * SLOPE + SHIFT) % PRIME) % PRIME * FACTOR + STEP) % PRIME
    return s


def shuffled_places(places, n: int, seed: int, reps):
    """Where places from 0 to n - 1 go in a permutation of their own for each of reps: worked out for each place alone, not sorted.

    In a turn every place has a partner, the one that adds up with it to a number drawn for the turn, and both change
    places or neither does, by a draw of the larger one. So no two places ever meet."""
    import numpy as np

    x, reps = np.broadcast_arrays(np.asarray(places, np.int64)[:, None], np.asarray(reps, np.int64)[None, :])
    for r in range(ROUNDS):
        partner = (draws(seed, reps[:1], r) - x) % n
        x = np.where(draws(seed, reps, r, np.maximum(x, partner)) // 64 % 2 == 1, partner, x)
    return x


def dense_places(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """df with ``place``: 0 for the smallest key, 1 for the next, ... of distinct numeric keys, without one task that sorts all."""
    from varistra.operators.relational import overall_rank

    return overall_rank(df, key, "place", parts).withColumn("place", (F.col("place") - 1).cast("long"))


def permutation_null(pairs: DataFrame, labels: DataFrame, key: str, label: str, replicates: int, seed: int) -> DataFrame:
    """One row: observed, null_mean, null_std, z, p: share of pairs(u, v) with equal labels against shuffled labels.

    Nodes have dense places by key, labels stand in their order in one list, and in each replicate a place is sent to another by
    ``shuffled_places``: a true permutation of the labels, worked out for each node on its own. A node has a list of
    its labels in all replicates; both nodes' lists meet at the pair, and the pairs are counted by replicate in each task
    first. Classes' counts go to all tasks, a number for each class. Nodes with a null key or label are left out, and pairs with
    them; keys are whole numbers under 2^53."""
    nodes = labels.select(F.col(key).cast("long").alias("node"), F.col(label).alias("lab")).filter("node is not null and lab is not null")
    classes = nodes.groupBy("lab").agg(F.count(F.lit(1)).alias("c"))
    ends = classes.groupBy().agg(F.array_sort(F.collect_list(F.struct("lab", "c"))).alias("cs"))  # one row, an entry for each class
    ends = ends.select(F.aggregate("cs", F.array().cast("array<bigint>"), lambda s, e: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + e["c"])).alias("ends"), F.transform("cs", lambda e: e["lab"]).alias("labs"))
    placed = dense_places(nodes, "node").join(F.broadcast(ends), F.lit(True))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, min(512, batch.num_rows - at))
                ends = np.array(part.column(2)[0].as_py(), np.int64)
                sent = shuffled_places(part.column(1).to_numpy(), int(ends[-1]), seed, np.arange(1, replicates + 1))
                known = np.searchsorted(ends, sent, "right").astype(np.int32)
                own = part.column(3).to_numpy().astype(np.int32)
                lists = np.concatenate([own[:, None], known], 1)  # first the true one
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists.reshape(-1)))], ["node", "labs"])

    own = F.array_position("labs", F.col("lab")).cast("int") - 1
    given = placed.select("node", "place", "ends", own.alias("own")).mapInArrow(run, "node long, labs array<int>")
    x, y = given.select(F.col("node").alias("u"), F.col("labs").alias("lu")), given.select(F.col("node").alias("v"), F.col("labs").alias("lv"))
    same = pairs.select("u", "v").join(x, "u").join(y, "v").select(F.posexplode(F.zip_with("lu", "lv", lambda a, b: (a == b).cast("int"))).alias("rep", "same"))
    shares = same.groupBy("rep").agg(F.avg("same").alias("s"))
    both = shares.agg(F.max(F.when(F.col("rep") == 0, F.col("s"))).alias("observed"), F.array_agg(F.when(F.col("rep") > 0, F.col("s"))).alias("null"))  # a number for each replicate
    both = both.select("observed", F.explode("null").alias("s")).groupBy("observed").agg(F.avg("s").alias("null_mean"), F.stddev_pop("s").alias("null_std"), F.count_if(F.col("s") >= F.col("observed")).alias("r"), F.count(F.lit(1)).alias("n"))
    return both.select("observed", "null_mean", "null_std", F.when(F.col("null_std") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_std")).alias("z"), ((F.col("r") + 1) / (F.col("n") + 1)).alias("p"))
