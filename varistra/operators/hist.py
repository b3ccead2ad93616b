"""Class-conditional histograms, heatmaps, head statistics and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(value: Column, n: int, lo: float, hi: float) -> Column:
    """The bin of a value: truncated towards zero, then held within 0 and n - 1."""
    x = (value - lo) / (hi - lo) * n
    cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), cut)).cast("int")


def histogram(df: DataFrame, keys: list[str], value: str, n: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(keys, bin, frac, total) for non-empty bins; null and NaN values don't count; totals are at least 1."""
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = valid.groupBy(*keys, bin_of(F.col(value), n, lo, hi).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = F.greatest(F.lit(1), F.sum("c").over(Window.partitionBy(*keys)))
    return counts.select(*keys, "bin", F.round(F.col("c") / total, 4).alias("frac"), total.cast("long").alias("total"))


def dense_histogram(df: DataFrame, key: str, value: str, n: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """A1 as an array of n fractions for each key, zero for empty bins."""
    sparse = histogram(df, [key], value, n, lo, hi)
    at = F.map_from_entries(F.collect_list(F.struct("bin", "frac")))
    return sparse.groupBy(key).agg(at.alias("m"), F.max("total").alias("total")).select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("hist"), "total")


def heatmap(df: DataFrame, keys: list[str], x: str, y: str, positive: Column, n: int = 10, least: int = 10) -> DataFrame:
    """A2: (keys, xb, yb, n, pct): rows and share of positive ones in each cell; keys with at most ``least`` valid rows are left out."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    valid = df.filter(ok(x) & ok(y))
    cells = valid.groupBy(*keys, bin_of(F.col(x), n, 0, 1).alias("xb"), bin_of(F.col(y), n, 0, 1).alias("yb")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"))
    all_rows = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    return cells.withColumn("all", all_rows).filter(F.col("all") > least).select(*keys, "xb", "yb", "n", F.round(100 * F.col("p") / F.col("n"), 1).alias("pct"))


def head_stats(long: DataFrame, head: str = "head", value: str = "value", least: int = 10) -> DataFrame:
    """A3: (head, n, mean, std): sample deviation, 5 places; heads with at most ``least`` values are left out."""
    valid = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return valid.groupBy(head).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 5).alias("mean"), F.round(F.stddev_samp(value), 5).alias("std")).filter(F.col("n") > least)


def abs_z(long: DataFrame, stats: DataFrame, head: str = "head", value: str = "value") -> DataFrame:
    """|value - mean| / std to 2 places; null where the deviation is 0. stats has a row for each head and is broadcast."""
    return long.join(F.broadcast(stats.select(head, "mean", "std")), head).withColumn("z", F.when(F.col("std") > 0, F.round(F.abs(F.col(value) - F.col("mean")) / F.col("std"), 2)))


def density(df: DataFrame, cohort: str, value: str, n: int, lo: float, hi: float) -> DataFrame:
    """(cohort, bin, density): counts over rows and width, so each cohort's densities times the width sum to 1; empty bins aren't there."""
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(cohort, bin_of(F.col(value), n, lo, hi).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(cohort).agg(F.sum("c").alias("total"))
    return counts.join(total, cohort).select(cohort, "bin", (F.col("c") / (F.col("total") * ((hi - lo) / n))).alias("density"))


def cell_fraction(df: DataFrame, cells: DataFrame, x: str, y: str, n: int = 10, missing: float = 0.5) -> DataFrame:
    """df with fraction: the positive share of the heatmap cell (xb, yb, pct) that a row falls in, ``missing`` without one."""
    keyed = df.withColumns({"xb": bin_of(F.col(x), n, 0.0, 1.0), "yb": bin_of(F.col(y), n, 0.0, 1.0)})
    return keyed.join(cells.select("xb", "yb", (F.col("pct") / 100).alias("fraction")), ["xb", "yb"], "left").fillna(missing, ["fraction"]).drop("xb", "yb")
