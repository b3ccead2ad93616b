"""Correlations, group tests, evaluation metrics and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varistra.functions import special
from varistra.operators.relational import average_rank, benjamini_hochberg
from varistra.sources import shared


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def guarded_corr(df: DataFrame, by: list[str], x: str, y: str, least: int = 50, flat: float = 1e-10) -> DataFrame:
    """M4: (by, n, r): Pearson correlation of rows where both values are there; null for few rows or a flat side."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("cov"), F.stddev_pop(a).alias("sx"), F.stddev_pop(b).alias("sy"))
    fine = (F.col("n") >= least) & (F.col("sx") > flat) & (F.col("sy") > flat)
    return sums.select(*by, "n", F.when(fine, F.col("cov") / (F.col("sx") * F.col("sy"))).alias("r"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """M5: (by, n, r): Pearson correlation of average-tie ranks."""
    ranked = average_rank(average_rank(df, x, by, "rank_x"), y, by, "rank_y")
    return guarded_corr(ranked, by, "rank_x", "rank_y", least)


def corr_p(r: Column, n: Column) -> Column:
    """M5: two-sided p of a correlation by its t statistic."""
    return special.t_p(r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r)), n - 2)


def welch(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """Each group against all other rows: (group, n, rest_n, diff, t, dof, d). The rest is totals less the group's sums."""
    v = F.col(value).cast("double")
    sums = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    total = Window.partitionBy()
    sums = sums.select("*", *[(F.sum(c).over(total) - F.col(c)).alias(f"rest_{c}") for c in ("n", "s", "q")]).filter((F.col("n") >= least) & (F.col("rest_n") >= least))
    return welch_columns(sums).select(group, "n", "rest_n", "diff", "t", "dof", "d")


def welch_columns(sums: DataFrame) -> DataFrame:
    """sums (n, s, q of a sample, rest_n, rest_s, rest_q of the other: count, sum, sum of squares) with diff, t, dof and d."""
    var = lambda n, s, q: F.greatest(F.lit(0.0), (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1))
    out = sums.withColumns({"v1": var("n", "s", "q"), "v2": var("rest_n", "rest_s", "rest_q"), "diff": F.col("s") / F.col("n") - F.col("rest_s") / F.col("rest_n")})
    a, b = F.col("v1") / F.col("n"), F.col("v2") / F.col("rest_n")
    dof = F.greatest(F.lit(1.0), F.pow(a + b, 2) / F.greatest(F.lit(1e-300), a * a / (F.col("n") - 1) + b * b / (F.col("rest_n") - 1)))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v1") + (F.col("rest_n") - 1) * F.col("v2")) / (F.col("n") + F.col("rest_n") - 2))
    return out.withColumns({"t": safe_ratio(F.col("diff"), F.sqrt(a + b)), "dof": dof, "d": safe_ratio(F.col("diff"), pooled)}).drop("v1", "v2")


def enrichment(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """M6 with p and false-discovery rate."""
    tested = welch(df, group, value, least).withColumn("p", F.coalesce(special.t_p(F.col("t"), F.col("dof")), F.lit(1.0)))
    tested, _ = shared.stored(tested, "tested")  # sums of doubles may differ in their last digits when they are worked out again
    return benjamini_hochberg(tested, "p", group)


def mann_whitney(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """One row: n1, n2, U of the first sample, rank-biserial 1 - 2U/(n1 n2), two-sided p by the normal law with ties."""
    known = df.filter(F.col(value).isNotNull()).withColumn("mw_first", in_first)
    ranked = average_rank(known, value, [], "mw_rank")
    t = F.col("t").cast("double")
    ties = known.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(t * (t * t - 1)).alias("ties"))
    s = ranked.agg(F.count_if("mw_first").alias("n1"), F.count_if(~F.col("mw_first")).alias("n2"), F.sum(F.when(F.col("mw_first"), F.col("mw_rank"))).alias("r1"))
    s = s.join(F.broadcast(ties), F.lit(True))  # a row each
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select("n1", "n2", "u", safe_ratio(n1 * n2 - 2 * F.col("u"), n1 * n2).alias("rank_biserial"), special.normal_p(safe_ratio(F.col("u") - n1 * n2 / 2, sd)).alias("p"))


def eval_binary(df: DataFrame, by: list[str], pred: str, truth: str, at: float = 0.5) -> DataFrame:
    """Per group n, prevalence, auc, auprc, nauprc, mcc, accuracy, f1; tied scores count as one step."""
    ok = df.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull()).withColumn("pos", (F.col(truth) > 0.5).cast("long"))
    steps = ok.groupBy(*by, F.col(pred).alias("s")).agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w)})
    hit = F.col("s") >= at
    m = steps.groupBy(*by).agg(
        F.sum("p").alias("P"), F.sum("q").alias("N"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0)).cast("double").alias("TP"), F.coalesce(F.sum(F.when(hit, F.col("q"))), F.lit(0)).cast("double").alias("FP"),
    )
    P, N, TP, FP = F.col("P").cast("double"), F.col("N").cast("double"), F.col("TP"), F.col("FP")
    FN, TN, n = P - TP, N - FP, P + N
    auprc = safe_ratio(F.col("ap"), P)
    return m.select(*by, n.cast("long").alias("n"), (P / n).alias("prevalence"), safe_ratio(F.col("area"), P * N).alias("auc"), auprc.alias("auprc"), safe_ratio(auprc - P / n, 1 - P / n).alias("nauprc"), safe_ratio(TP * TN - FP * FN, F.sqrt((TP + FP) * (TP + FN) * (TN + FP) * (TN + FN))).alias("mcc"), ((TP + TN) / n).alias("accuracy"), safe_ratio(2 * TP, 2 * TP + FP + FN).alias("f1"))


def eval_continuous(df: DataFrame, by: list[str], pred: str, truth: str) -> DataFrame:
    """Per group n, pearson, spearman, r2, mse, mae; correlations and r2 null for a flat side."""
    ok = df.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    p, t = F.col(pred).cast("double"), F.col(truth).cast("double")
    e = p - t
    base = ok.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(t).alias("vt"))
    pear = guarded_corr(ok, by, pred, truth, 2).select(*by, "n", F.col("r").alias("pearson"))
    spear = spearman(ok, by, pred, truth, 2).select(*by, F.col("r").alias("spearman"))
    joined = base.join(pear, by).join(spear, by) if by else base.crossJoin(pear).crossJoin(spear)  # one row each
    return joined.select(*by, "n", "pearson", "spearman", F.when(F.col("vt") > 1e-20, 1 - F.col("mse") / F.col("vt")).alias("r2"), "mse", "mae")


def head_kinds(long: DataFrame, head: str, value: str, least: int = 20) -> DataFrame:
    """(head, n, kind): binary with 2 values, categorical with more whole ones under 100, else continuous; few values: skipped."""
    v = F.col(value)
    s = long.filter(v.isNotNull() & ~F.isnan(v)).groupBy(head).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(v).alias("u"), F.max(v).alias("m"), F.bool_and(v == F.floor(v)).alias("whole"))
    return s.select(head, "n", F.when(F.col("n") < least, "skipped").when(F.col("u") == 2, "binary").when(F.col("whole") & (F.col("m") < 100) & (F.col("u") > 2), "categorical").otherwise("continuous").alias("kind"))


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column for each."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(q)).alias(f"p{q * 100:g}".replace(".", "_")) for q in at])


def thresholds(df: DataFrame, cohort: Column, value: str, at: list[float]) -> DataFrame:
    """(threshold, a, b, ratio): shares over each threshold in the cohort and outside, their ratio null where b is 0."""
    rows = df.filter(F.col(value).isNotNull()).select(cohort.alias("c"), F.col(value).alias("v"), F.explode(F.array(*map(F.lit, at))).alias("threshold"))
    over = (F.col("v") > F.col("threshold")).cast("double")
    s = rows.groupBy("threshold").agg(F.avg(F.when(F.col("c"), over)).alias("a"), F.avg(F.when(~F.col("c"), over)).alias("b"))
    return s.select("threshold", "a", "b", safe_ratio(F.col("a"), F.col("b")).alias("ratio"))


def margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """(axis, key, n, expected, chi2 part): marginal counts of both axes against uniform ones, from one pass."""
    s = df.groupingSets([[row], [col]], row, col).agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("g"))
    s = s.select(F.when(F.col("g") == 0, row).otherwise(col).alias("axis"), F.coalesce(F.col(row).cast("string"), F.col(col).cast("string")).alias("key"), "n")
    expected = F.avg("n").over(Window.partitionBy("axis"))
    return s.select("axis", "key", "n", expected.alias("expected"), (F.pow(F.col("n") - expected, 2) / expected).alias("chi2"))


def lift(fold_a: Column, fold_b: Column) -> Column:
    """M8: enrichment ratio; infinite where only the base is 0, null where both are."""
    return F.when(fold_b > 0, fold_a / fold_b).when(fold_a > 0, F.lit(float("inf")))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(b * c > 0, a * d / (b * c)).when(a * d > 0, F.lit(float("inf")))
