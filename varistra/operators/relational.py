"""Joins, neighbour edges, window ranks, searches and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varistra.sources import shared


def band_join(left: DataFrame, right: DataFrame, key: list[str], lpos: str, rpos: str, radius: int) -> DataFrame:
    """Inner join of rows with equal key whose positions differ by at most radius (0 counts as 1).

    Positions are cut into bins as wide as the radius; the right side goes to its own bin and both beside it, so the
    join is an equi-join on (key, bin) with a filter, and a hot key is split by position."""
    r = max(1, radius)
    left = left.withColumn("band_bin", F.floor(F.col(lpos) / r))
    right = right.withColumn("band_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(rpos) / r) + d)))
    return left.join(right, [*key, "band_bin"]).filter(F.abs(F.col(lpos) - F.col(rpos)) <= r).drop("band_bin")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; order must break ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def first_names(sets: DataFrame, counts: DataFrame, key: str, name: str, count: str, order: list[Column], n: int) -> DataFrame:
    """N rows of sets with different names: those that counts (key, count) has come first, the largest count first; where
    they are too few, the others follow in order. Ties go by order, then key. Rows without a name share one; fewer names
    than n give as many rows. One aggregate by name and a top n: no window, and no name's rows in one task."""
    place = F.struct(F.col(count).isNull().alias("without"), (-F.col(count)).alias("minus"), *[c.alias(f"by{i}") for i, c in enumerate(order)], F.col(key).alias("key"))
    best = sets.join(counts.select(key, count), key, "left").groupBy(name).agg(F.min(place).alias("place"))
    return best.orderBy("place").limit(n).select(F.col("place.key").alias(key), name, (-F.col("place.minus")).alias(count))


def row_heads(heads: list[str], score=lambda z, i: z) -> Column:
    """A row's heads as structs (minus, head, score), the largest score first, ties by head; null and NaN scores are left out.

    score turns a head's value and its place among heads into the number to rank by. All of it stays in the row."""
    values = F.array(*[F.col(h).cast("double") for h in heads])
    scored = F.transform(values, lambda z, i: F.struct((-score(z, i)).alias("minus"), F.get(F.array(*map(F.lit, heads)), i).alias("head"), score(z, i).alias("score")))
    return F.sort_array(F.filter(scored, lambda e: e["score"].isNotNull() & ~F.isnan(e["score"])))


def attribute(df: DataFrame, keys: list[str], heads: list[str], group, k: int, floor: float = 0.5) -> DataFrame:
    """(keys, head, grp, z, rank): of each row's 3k largest heads, those over the floor, the first of each group, then k of them.

    group turns a head's name into its group. A row's heads are ranked within the row: nothing is shuffled."""
    best = F.filter(F.slice(row_heads(heads), 1, 3 * k), lambda e: e["score"] > floor)

    def pick(taken: Column, e: Column) -> Column:
        new = ~F.exists(taken, lambda x: x["grp"] == group(e["head"])) & (F.size(taken) < k)
        return F.when(new, F.array_append(taken, F.struct(e["head"].alias("head"), group(e["head"]).alias("grp"), e["score"].alias("z")))).otherwise(taken)

    picked = F.aggregate(best, F.array().cast("array<struct<head:string,grp:string,z:double>>"), pick)
    return df.select(*keys, F.posexplode(picked).alias("at", "e")).select(*keys, "e.head", "e.grp", "e.z", (F.col("at") + 1).alias("rank"))


def attribute_keys(df: DataFrame, keys: list[str], heads: list[str], group, k: int, floor: float = 0.5) -> DataFrame:
    """As ``attribute``, but over the heads of all rows that share keys together: of their 3k largest ones those over the floor,
    the first of each group, then k of them. A row gives 3k heads at most, and what is left of a key is cut again before it is shuffled."""
    best = F.slice(F.filter(row_heads(heads), lambda e: e["score"] > floor), 1, 3 * k)
    each = df.select(*keys, F.explode(best).alias("e")).select(*keys, "e.head", group(F.col("e.head")).alias("grp"), F.col("e.score").alias("z"))
    order = [F.desc("z"), F.asc("head")]
    first = top_k(top_k(each, keys, order, 3 * k, "place"), [*keys, "grp"], order, 1, "nth")
    return top_k(first, keys, order, k).select(*keys, "head", "grp", "z", "rank")


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks from 1, ties share their mean rank; nulls of a group come first. Ranks over the whole table (no ``by``) need a
    numeric value. Numbers, dates and times are ranked by ranges, so that no task sorts a whole group; others group by group.
    The value is worked out more than once and must be the same each time: store it first where it comes from sums of doubles."""
    if not by:
        return overall_rank(df, value, name)
    if not by_ranges(df, value):
        w = Window.partitionBy(*by)
        return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)
    ranks = counts_before(df, value, by).select("cb_g", "cb_value", (F.col("cb_before") + (F.col("cb_n") + 1) / 2).alias(name))
    return df.join(ranks, (grouped(by) == F.col("cb_g")) & F.col(value).eqNullSafe(F.col("cb_value")), "left").select(*df.columns, name)


def grouped(by: list[str]) -> Column:
    """Groups as a struct, in which nulls are equal."""
    return F.struct(F.lit(0).alias("all"), *by)


def by_ranges(df: DataFrame, value: str) -> bool:
    kind = dict(df.dtypes)[value]
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal")


def counts_before(df: DataFrame, value: str, by: list[str], parts: int = 64) -> DataFrame:
    """(cb_g, cb_value, cb_n, cb_before): of each group's distinct values, nulls first, how many rows have it and how many come before.

    Values are counted, cut in ranges at approximate quantiles and summed up within each range; a range's own count, a few rows a
    group, carries on. So a task sorts the distinct values of a range of one group at most."""
    counts = df.groupBy(grouped(by).alias("cb_g"), F.col(value).alias("cb_value")).agg(F.count(F.lit(1)).alias("cb_n"))
    day = dict(df.dtypes)[value] in ("date", "timestamp", "timestamp_ntz")
    counts = counts.withColumn("cb_at", (F.unix_date(F.col("cb_value").cast("date")) if day else F.col("cb_value")).cast("double"))
    counts, _ = shared.stored(counts, "counts")  # read more than once
    cuts = sorted(set(counts.filter("cb_at is not null and not isnan(cb_at)").approxQuantile("cb_at", [i / parts for i in range(1, parts)], 0.005)))
    ranged, on = counts.withColumn("cb_range", F.when(F.col("cb_at").isNull(), -1).otherwise(range_of(F.col("cb_at"), cuts))), ["cb_g", "cb_range"]
    sums = ranged.groupBy(*on).agg(F.sum("cb_n").alias("cb_sum"))
    sums = sums.select(*on, (F.sum("cb_sum").over(Window.partitionBy("cb_g").orderBy("cb_range")) - F.col("cb_sum")).alias("cb_earlier"))
    within = F.sum("cb_n").over(Window.partitionBy(*on).orderBy("cb_value")) - F.col("cb_n")
    return ranged.withColumn("cb_within", within).join(sums, on).select("cb_g", "cb_value", "cb_n", (F.col("cb_earlier") + F.col("cb_within")).alias("cb_before"))


def medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): exact medians of groups without a task that holds a group's values. Groups of nulls only have none."""
    known = df.filter(F.col(value).isNotNull())
    total = known.groupBy(grouped(by).alias("md_g")).agg(F.count(F.lit(1)).alias("md_n"))
    both = counts_before(known, value, by).join(total, F.col("cb_g") == F.col("md_g"))
    holds = lambda place: ((F.col("cb_before") <= place) & (place < F.col("cb_before") + F.col("cb_n"))).cast("int")
    times = holds(F.floor((F.col("md_n") - 1) / 2)) + holds(F.floor(F.col("md_n") / 2))
    found = both.withColumn("md_times", times).filter("md_times > 0")
    return found.groupBy("cb_g").agg((F.sum(F.col("md_times") * F.col("cb_value").cast("double")) / 2).alias("median")).select(*[F.col(f"cb_g.{c}").alias(c) for c in by], "median")


def range_of(value: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the rising cuts are under the value, by halving: a generated expression of few comparisons."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(value <= cuts[mid], range_of(value, cuts[:mid], first)).otherwise(range_of(value, cuts[mid + 1 :], first + mid + 1))


def overall_rank(df: DataFrame, value: str, name: str, parts: int = 64) -> DataFrame:
    """Average-tie ranks over a whole table without one task that sorts it: distinct values are counted, cut in ranges at
    approximate quantiles, summed up within each range, and joined back. Only the cuts and the ranges' sums are small."""
    counts = df.groupBy(F.col(value).cast("double").alias("or_value")).agg(F.count(F.lit(1)).alias("or_n")).filter("or_value is not null")
    cuts = sorted(set(counts.approxQuantile("or_value", [i / parts for i in range(1, parts)], 0.005)))
    place = range_of(F.col("or_value"), cuts)
    ranged = counts.withColumn("or_range", place)
    sums = ranged.groupBy("or_range").agg(F.sum("or_n").alias("or_sum"))
    before = sums.select("or_range", (F.sum("or_sum").over(Window.orderBy("or_range")) - F.col("or_sum")).alias("or_before"))  # at most ``parts`` rows
    within = F.sum("or_n").over(Window.partitionBy("or_range").orderBy("or_value")) - F.col("or_n")
    ranks = ranged.withColumn("or_within", within).join(F.broadcast(before), "or_range").select("or_value", (F.col("or_before") + F.col("or_within") + (F.col("or_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value).cast("double") == F.col("or_value"), "left").drop("or_value")


def benjamini_hochberg(df: DataFrame, p: str, key: str, by: list[str] | None = None, name: str = "fdr", parts: int = 64) -> DataFrame:
    """Adjusted p, monotone from the largest p down, within 0 and 1; null where p is null. key isn't needed: equal p share a value.
    p is worked out twice and must be the same both times: store it first where it comes from sums of doubles.

    Distinct p are counted and cut in ranges at approximate quantiles, so that no task sorts a whole group: counts run up
    and minima run down within a range, and the ranges' own counts and minima, a few rows a group, carry both on."""
    group = F.struct(F.lit(0).alias("all"), *(by or []))  # in a struct null groups are equal
    counts = df.filter(F.col(p).isNotNull()).groupBy(group.alias("bh_g"), F.col(p).alias("bh_p")).agg(F.count(F.lit(1)).alias("bh_c"))
    counts, _ = shared.stored(counts, "fdr")  # p may be costly, and is needed more than once
    cuts = sorted(set(counts.approxQuantile("bh_p", [i / parts for i in range(1, parts)], 0.005)))
    place = range_of(F.col("bh_p"), cuts)
    ranged, on = counts.withColumn("bh_range", place), ["bh_g", "bh_range"]
    sums = ranged.groupBy(*on).agg(F.sum("bh_c").alias("bh_sum"))
    before = F.sum("bh_sum").over(Window.partitionBy("bh_g").orderBy("bh_range")) - F.col("bh_sum")
    sums = sums.select(*on, before.alias("bh_before"), F.sum("bh_sum").over(Window.partitionBy("bh_g")).alias("bh_n"))
    up, down = Window.partitionBy(*on).orderBy("bh_p"), Window.partitionBy(*on).orderBy(F.desc("bh_p"))
    raw = F.col("bh_p") * F.col("bh_n") / (F.col("bh_before") + F.sum("bh_c").over(up))
    ranked = ranged.join(sums, on).withColumn("bh_raw", raw).withColumn("bh_low", F.min("bh_raw").over(down))
    later = ranked.groupBy(*on).agg(F.min("bh_raw").alias("bh_least"))
    after = Window.partitionBy("bh_g").orderBy(F.desc("bh_range")).rowsBetween(Window.unboundedPreceding, -1)
    later = later.select(*on, F.min("bh_least").over(after).alias("bh_later"))
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "bh_low", "bh_later"))
    out = ranked.join(later, on).select("bh_g", "bh_p", low.alias(name))
    return df.join(out, (F.col(p) == F.col("bh_p")) & (group == F.col("bh_g")), "left").select(*df.columns, name)


def locus_range(df: DataFrame, contig: str, position: str, key: str, at: tuple[str, int], pad: int, limit: int, not_id: int | None = None) -> DataFrame:
    """Rows on the contig within pad of the place, nearest first; pad is held within 1 and 500,000, limit within 1 and 50."""
    pad, limit = min(500_000, max(1, pad)), min(50, max(1, limit))
    found = df.filter((F.col(contig) == at[0]) & F.col(position).between(at[1] - pad, at[1] + pad))
    if not_id is not None:
        found = found.filter(F.col(key) != not_id)
    return found.withColumn("distance", F.abs(F.col(position) - at[1])).orderBy("distance", key).limit(limit)


def tiered_search(df: DataFrame, column: str, query: str, score: str, key: str, most: int = 30) -> DataFrame:
    """Exact matches (any case) first, then those that begin so, best score first, each row once, at most ``most``."""
    name, q = F.upper(F.col(column)), query.upper()
    tier = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1)
    return df.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.desc(score), key).limit(most)


def search(df: DataFrame, query: str, rs_id: str, numbers: list[str], name: str, score: str, key: str, most: int = 30) -> DataFrame:
    """The mode follows the query: ``rs`` and digits look up rs_id, digits alone look up any of numbers, anything else the
    name by tiers; queries of fewer than two characters find nothing. Best score first, each row once, at most ``most``."""
    q = query.strip()
    if len(q) < 2:
        return df.limit(0).withColumn("tier", F.lit(0))
    if q.isascii() and q.isdigit():
        found = df.filter(F.exists(F.array(*(F.col(c).cast("string") for c in numbers)), lambda x: x == q))
    elif q[:2].lower() == "rs" and q.isascii() and q[2:].isdigit():
        found = df.filter(F.col(rs_id) == q.lower())
    else:
        return tiered_search(df, name, q, score, key, most)
    return found.withColumn("tier", F.lit(0)).orderBy(F.desc(score), key).limit(most)


def position_lookup(asked: DataFrame, table: DataFrame, keys: list[str], values: list[str], fill: float) -> DataFrame:
    """Asked with the values that stand in table under exactly its keys, fill where there are none. Keys of table are unique."""
    marked = table.select(*keys, *values, F.lit(True).alias("pl_hit"))
    out = asked.join(marked, keys, "left")
    return out.withColumns({v: F.when(F.col("pl_hit"), F.col(v)).otherwise(F.lit(fill)) for v in values}).drop("pl_hit")


def ranked_heads(df: DataFrame, keys: list[str], heads: list[str], score, least: float, k: int) -> DataFrame:
    """(keys, head, score, rank): each row's k heads with the largest score, none under least, ranked within the row."""
    best = F.slice(F.filter(row_heads(heads, score), lambda e: e["score"] >= least), 1, k)
    return df.select(*keys, F.posexplode(best).alias("at", "e")).select(*keys, "e.head", "e.score", (F.col("at") + 1).alias("rank"))


def ranked_keys(df: DataFrame, keys: list[str], heads: list[str], score, least: float, k: int) -> DataFrame:
    """as ``ranked_heads``, but over the heads of all rows that share keys together."""
    each = ranked_heads(df, keys, heads, score, least, k).drop("rank")
    return top_k(each, keys, [F.desc("score"), F.asc("head")], k).select(*keys, "head", "score", "rank")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N rows without replacement, those with the smallest draw by seed and key, in order of key."""
    from varistra.operators.resample import draw, number

    return df.withColumn("ss_draw", draw(seed, number(df, key), F.lit(0))).orderBy("ss_draw", key).limit(n).drop("ss_draw").orderBy(key)


def canonical_pairs(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Undirected pairs (u, v), u < v, each with its smallest value."""
    return df.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.min(value).alias(value))


def ego_groups(edges: DataFrame, a: str, b: str, score: str, least_score: float, least_size: int, most: int) -> DataFrame:
    """(node, size): nodes with enough strong partners, the largest groups first."""
    strong = edges.filter(F.col(score) >= least_score)
    both = strong.select(F.col(a).alias("node"), F.col(b).alias("partner")).union(strong.select(b, a)).filter("node <> partner").distinct()
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least_size).orderBy(F.desc("size"), "node").limit(most)


def group_pairs(members: DataFrame, group: str, member: str, block: int = 32768, most: int = 256, coded: int = 65536) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a group. Pairs are never shuffled: one is made only in the smallest group
    that both are in, which each membership knows from its member's smaller groups.

    A large group is dealt in blocks of about ``block`` members, and each two of its blocks meet in one place, so no task
    gets more than a block's square of its pairs. Memberships are shuffled twice: by member, and by place, where both sides of
    the pairs are the same shuffle; up to ``coded`` (65,536 at most) groups go by numbers of two bytes. Members of over ``most`` groups
    would need long lists: pairs with one of those are made in every group and then made distinct. Memberships are read more than once
    and must be the same each time."""
    held = members.select(F.col(group).alias("gp_g"), F.col(member).alias("gp_m")).filter("gp_g is not null and gp_m is not null")
    groups = held.select("gp_g").distinct()
    if groups.limit(coded + 1).count() <= coded:
        codes = groups.select("gp_g", (F.row_number().over(Window.orderBy("gp_g")) - 32769).cast("smallint").alias("gp_code"))  # at most ``coded`` rows
        held = held.join(F.broadcast(codes), "gp_g").select(F.col("gp_code").alias("gp_g"), "gp_m")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes make many pairs: Spark would take too few tasks
    own = Window.partitionBy("gp_m")
    rising = own.orderBy("gp_g")  # one sort for all of it
    held = held.repartition(parts, "gp_m").withColumn("gp_last", F.lag("gp_g").over(rising)).filter("gp_last is null or gp_last <> gp_g").drop("gp_last")
    held = held.withColumn("gp_many", F.count(F.lit(1)).over(own) > most)
    less = F.collect_list(F.when(~F.col("gp_many"), F.col("gp_g"))).over(rising.rowsBetween(Window.unboundedPreceding, -1))  # under ``most`` groups
    held, _ = shared.stored(held.withColumn("gp_less", less), "members")
    counts = held.groupBy("gp_g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("gp_blocks")).filter("gp_blocks > 1")  # at most a row for each block
    bit = lambda g, seed: F.expr(f"aggregate({g}, 0L, (s, x) -> s | shiftleft(1L, cast(pmod(xxhash64({seed}, x), 64) as int)))")

    def met(df: DataFrame, more: dict[str, Column], only: Column) -> DataFrame:
        df = df.join(F.broadcast(counts), "gp_g", "left").withColumn("gp_blocks", F.coalesce("gp_blocks", F.lit(1)))
        df = df.withColumn("gp_own", F.pmod(F.xxhash64("gp_m"), F.col("gp_blocks")).cast("int")).withColumn("gp_with", F.explode(F.sequence(F.lit(0), F.col("gp_blocks") - 1)))
        place, rest = ["gp_g", "gp_i", "gp_j"], [c for c in df.columns if c in ("gp_many", "gp_less")]
        df = df.select("gp_g", F.least("gp_own", "gp_with").alias("gp_i"), F.greatest("gp_own", "gp_with").alias("gp_j"), "gp_m", (F.col("gp_own") > F.col("gp_with")).alias("gp_last"), *rest)
        df = df.repartition(parts, *place)  # one shuffle for both sides
        x, y = (df.select(*place, F.col("gp_m").alias(m), F.col("gp_last").alias(f"gp_last_{m}"), *[c.alias(f"{n}_{m}") for n, c in more.items()]) for m in "ab")
        once = F.when(F.col("gp_i") == F.col("gp_j"), F.col("a") < F.col("b")).otherwise(~F.col("gp_last_a") & F.col("gp_last_b"))
        return x.join(y, place).filter(once & only).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    maybe = (F.col("gp_bits_a").bitwiseAND(F.col("gp_bits_b")) != 0) & (F.col("gp_more_a").bitwiseAND(F.col("gp_more_b")) != 0)
    first = ~maybe | ~F.arrays_overlap("gp_less_a", "gp_less_b")
    light = met(held.filter("not gp_many").drop("gp_many"), {"gp_less": F.col("gp_less"), "gp_bits": bit("gp_less", 1), "gp_more": bit("gp_less", 2)}, first)
    if not held.filter("gp_many").limit(1).collect():
        return light
    return light.union(met(held.drop("gp_less"), {"gp_many": F.col("gp_many")}, F.col("gp_many_a") | F.col("gp_many_b")).distinct())


def clip_interval(start: Column, end: Column, lo: int, hi: int) -> tuple[Column, Column, Column]:
    """The parts of closed intervals within [lo, hi], and whether they overlap it."""
    return F.greatest(start, F.lit(lo)), F.least(end, F.lit(hi)), (start <= hi) & (end >= lo)
