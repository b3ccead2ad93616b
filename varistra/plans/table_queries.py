"""Scans, sinks, projections, scalar columns and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.functions import scalar as S
from varistra.operators import hist, schema
from varistra.plans.catalog import Tables, query
from varistra.sources import readers, shared, sinks

HEADS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCORED = "CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE l_discount * 10 END"


def scratch(t: Tables, tag: str) -> str:
    """A fresh folder in the shared one."""
    return shared.scratch(t.spark, tag)


# ---------------------------------------------------------------- histograms and statistics of heads


@query("hist_class_norm", """
WITH s AS (SELECT l_returnflag AS cls, l_discount * 10 AS v FROM lineitem WHERE l_discount IS NOT NULL),
b AS (SELECT cls, CAST(least(19, greatest(0, CASE WHEN v * 20 < 0 THEN ceil(v * 20) ELSE floor(v * 20) END)) AS INT) AS bin, count(*) AS c FROM s GROUP BY ALL)
SELECT cls, bin, round(c / greatest(1, sum(c) OVER (PARTITION BY cls)), 4) AS frac, CAST(greatest(1, sum(c) OVER (PARTITION BY cls)) AS BIGINT) AS total FROM b""")
def hist_class_norm(t: Tables) -> DataFrame:
    """Class-normalised fixed-bin histogram."""
    df = t.lineitem.select(F.col("l_returnflag").alias("cls"), (F.col("l_discount") * 10).alias("v"))
    return hist.histogram(df, ["cls"], "v", 20)


@query("a1_dense_hist", """
WITH b AS (SELECT c_mktsegment AS seg, CAST(least(9, greatest(0, CASE WHEN (c_acctbal + 1000) / 11000 * 10 < 0 THEN ceil((c_acctbal + 1000) / 11000 * 10) ELSE floor((c_acctbal + 1000) / 11000 * 10) END)) AS INT) AS bin, count(*) AS c FROM customer GROUP BY ALL),
t AS (SELECT seg, sum(c) AS total FROM b GROUP BY seg), g AS (SELECT seg, total, unnest(range(10)) AS bin FROM t)
SELECT g.seg, g.bin, round(coalesce(c, 0) / total, 4) AS frac, CAST(total AS BIGINT) AS total FROM g LEFT JOIN b ON g.seg = b.seg AND g.bin = b.bin""")
def dense(t: Tables) -> DataFrame:
    """A1 with empty bins."""
    df = t.customer.select(F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return hist.dense_histogram(df, "seg", "c_acctbal", 10, -1000, 10000).select("seg", F.posexplode("hist").alias("bin", "frac"), "total").select("seg", F.col("bin").cast("long").alias("bin"), "frac", "total")


@query("a2_heatmap", """
WITH s AS (SELECT least(9, greatest(0, floor(l_discount * 100))) AS xb, least(9, greatest(0, floor(l_tax * 100))) AS yb, l_returnflag = 'R' AS p FROM lineitem)
SELECT CAST(xb AS INT) AS xb, CAST(yb AS INT) AS yb, count(*) AS n, round(100 * count(*) FILTER (WHERE p) / count(*), 1) AS pct FROM s GROUP BY xb, yb""")
def heatmap(t: Tables) -> DataFrame:
    """Heatmap with the share of positive rows."""
    df = t.lineitem.select((F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), "l_returnflag")
    return hist.heatmap(df, [], "x", "y", F.col("l_returnflag") == "R")


@query("a4_head_fanout", """
WITH long AS (UNPIVOT (SELECT l_returnflag AS cls, l_discount * 10 AS disc, l_tax * 10 AS tax, l_quantity / 50 AS qty FROM lineitem) ON disc, tax, qty INTO NAME head VALUE v),
b AS (SELECT head, cls, CAST(least(19, greatest(0, floor(v * 20))) AS INT) AS bin, count(*) AS c FROM long GROUP BY ALL)
SELECT head, cls, bin, round(c / sum(c) OVER (PARTITION BY head, cls), 4) AS frac, CAST(sum(c) OVER (PARTITION BY head, cls) AS BIGINT) AS total FROM b""")
def fanout(t: Tables) -> DataFrame:
    """A4: all heads' distributions from one unpivot."""
    wide = t.lineitem.select(F.col("l_returnflag").alias("cls"), (F.col("l_discount") * 10).alias("disc"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_quantity") / 50).alias("qty"))
    return hist.histogram(schema.unpivot(wide, ["cls"], ["disc", "tax", "qty"], value="v"), ["head", "cls"], "v", 20)


@query("a3_head_stats", """
WITH long AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME head VALUE v)
SELECT head, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM long GROUP BY head HAVING count(*) > 10""")
def head_stats(t: Tables) -> DataFrame:
    """A3, P17."""
    return hist.head_stats(schema.unpivot(t.lineitem, [], HEADS))


@query("p20_metadata_heads", """
WITH long AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME head VALUE v)
SELECT head, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM long GROUP BY head HAVING count(*) > 10""")
def metadata_heads(t: Tables) -> DataFrame:
    """P20."""
    wide = t.lineitem.withColumns({"exon_number": F.col("l_linenumber").cast("double"), "residue_number": F.col("l_partkey").cast("double")})
    return hist.head_stats(schema.without_metadata(schema.unpivot(wide, [], [*HEADS, "exon_number", "residue_number"])))


@query("w12_abs_zscore", """
WITH s AS (SELECT round(avg(l_quantity), 5) AS m, round(stddev_samp(l_quantity), 5) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity AS value, round(abs(l_quantity - m) / d, 2) AS z FROM lineitem, s""")
def abs_z(t: Tables) -> DataFrame:
    """W12, F9, J15."""
    long = schema.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity"])
    return hist.abs_z(long, hist.head_stats(long)).select("l_orderkey", "l_linenumber", "value", "z")


@query("a15_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 4) AS p2_5, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.975), 4) AS p97_5 FROM orders GROUP BY 1")
def percentiles(t: Tables) -> DataFrame:
    """A15, A6."""
    from varistra.operators.stats import percentiles as of

    return of(t.orders, ["o_orderpriority"], "o_totalprice", [0.025, 0.5, 0.975]).select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("p2_5", "p50", "p97_5")])


# ---------------------------------------------------------------- scans and sinks


@query("s1_projection", "SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def projection(t: Tables) -> DataFrame:
    """S1, S4."""
    return readers.parquet(t.spark, f"{t.sf_dir}/part.parquet", ["p_partkey", "p_brand", "p_size"]).filter("p_size > 25").drop("p_size")


@query("s3_annotations", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def annotations(t: Tables) -> DataFrame:
    """Rows whose key is needed."""
    need = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return readers.annotations(t.spark, f"{t.sf_dir}/part.parquet", "p_partkey", need, ["p_brand", "not_there"])


@query("s5_wide_matrix", "SELECT o_orderstatus AS cell, CASE WHEN TRUE THEN o_orderpriority END AS gene, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL")
def wide_matrix(t: Tables) -> DataFrame:
    """A wide CSV matrix written, read back and made long."""
    genes = [r[0] for r in t.orders.select("o_orderpriority").distinct().orderBy(F.col("o_orderpriority")).collect()]  # five priorities
    wide = t.orders.groupBy(F.col("o_orderstatus").alias("cell")).pivot("o_orderpriority", genes).agg(F.avg("o_totalprice"))
    path = sinks.materialise_views(t.spark, {"matrix": wide}, scratch(t, "csv"), "csv")[0]
    return readers.wide_csv(t.spark, path, ["cell"], "gene", "v").withColumn("v", F.round("v", 4))


@query("s9_nested_sets", "SELECT DISTINCT p_size AS set_id, upper(p_brand) AS gene FROM part")
def nested_sets(t: Tables) -> DataFrame:
    """Nested JSON sets."""
    sets = t.part.groupBy(F.col("p_size").cast("long").alias("complex_id")).agg(F.max("p_type").alias("complex_name"), F.collect_set("p_brand").alias("b"))
    docs = sets.select("complex_id", "complex_name", F.transform("b", lambda x: F.struct(F.struct(x.alias("gene_name")).alias("swissprot"))).alias("subunits"))
    path = scratch(t, "json")
    docs.write.json(path)
    rows = t.spark.read.schema(docs.schema).json(path)
    return rows.select(F.col("complex_id").alias("set_id"), F.explode("subunits").alias("s")).select("set_id", F.upper(F.trim("s.swissprot.gene_name")).alias("gene")).distinct()


@query("s18_census", """
SELECT 'o_' AS family, t AS type, count(*) AS columns FROM (SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS t FROM (DESCRIBE orders)) GROUP BY ALL""")
def census(t: Tables) -> DataFrame:
    """S16, S18, S11."""
    return readers.census(t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), ("o_", "x_"))


@query("k7_typed_lines", "SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 3 END, 6) AS bal, c_mktsegment AS segment FROM customer")
def typed_lines(t: Tables) -> DataFrame:
    """K7: gzip JSON lines without nulls and NaN, read back."""
    df = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 3).alias("bal"), "c_mktsegment")
    path = scratch(t, "lines")
    sinks.write_lines(sinks.typed_lines(df, "c_custkey", {"c_mktsegment": "segment"}), path)
    return t.spark.read.schema("c_custkey long, bal double, segment string").json(path)


@query("k8_publish", "SELECT o_orderkey, o_totalprice FROM orders")
def publish(t: Tables) -> DataFrame:
    """Staged, verified and swapped."""
    path = scratch(t, "served")
    for _ in range(2):
        sinks.publish(schema.require_clean(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]), path, "o_orderkey")
    return t.spark.read.parquet(path)


@query("k10_insert_absent", "SELECT c_custkey, c_name FROM customer")
def insert_absent(t: Tables) -> DataFrame:
    """Appending twice leaves each key once."""
    path = scratch(t, "cache")
    sinks.insert_absent(t.customer.filter("c_custkey % 2 = 0").select("c_custkey", "c_name"), path, "c_custkey")
    sinks.insert_absent(t.customer.select("c_custkey", "c_name"), path, "c_custkey")
    return t.spark.read.parquet(path)


@query("k9_label_arrays", """
WITH v AS (SELECT o_orderstatus AS head, o_custkey, count(*) AS v FROM orders GROUP BY ALL), g AS (SELECT head, c_custkey AS place FROM (SELECT DISTINCT head FROM v), customer)
SELECT g.head, list(v.v ORDER BY place) AS labels FROM g LEFT JOIN v ON v.head = g.head AND v.o_custkey = g.place GROUP BY g.head""")
def label_arrays(t: Tables) -> DataFrame:
    """Labels of each head in the order of the ids, missing ones null."""
    long = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("v")).select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("head"), "v")
    ids = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"))
    return sinks.label_arrays(long, ids, "id", "head", "v")


# ---------------------------------------------------------------- projections


@query("p1_column_families", "SELECT l_orderkey, l_linenumber, l_quantity AS eff_quantity, l_tax AS ref_tax FROM lineitem")
def families(t: Tables) -> DataFrame:
    """Families filtered and renamed, longest prefix first."""
    wide = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score_quantity"), F.col("l_discount").alias("score_discount"), F.col("l_tax").alias("ref_score_tax"))
    kept = schema.filter_heads(wide, ("score_", "ref_score_"), {"quantity", "tax"})
    return schema.order_columns(schema.rewrite_prefixes(kept, {"score_": "eff_", "ref_score_": "ref_"}, "gt_"), ["l_orderkey"])


@query("p10_coding_filter", "SELECT p_partkey, p_name FROM part WHERE trim(p_brand) <> '' AND trim(p_type) <> '' AND (p_type IN ('STANDARD', 'PROMO') OR lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%' OR lower(p_type) LIKE '%eco%')")
def coding(t: Tables) -> DataFrame:
    """P11, P19."""
    name = F.lower(F.coalesce("p_name", F.lit("")))
    some = F.col("p_type").isin("STANDARD", "PROMO") | name.contains("red") | name.contains("blue") | F.lower("p_type").contains("eco")
    return t.part.filter(schema.non_blank(F.col("p_brand")) & schema.non_blank(F.col("p_type"), ("?", "[]")) & some).select("p_partkey", "p_name")


@query("p13_regex_filter", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^a-z])the [a-z]+ing[ .,]') AND NOT regexp_matches(text, '[0-9]{4}')")
def regex_filter(t: Tables) -> DataFrame:
    """Include and exclude, with a lookbehind."""
    return t.documents.filter(F.col("text").rlike("(?<![a-z])the [a-z]+ing[ .,]") & ~F.col("text").rlike("[0-9]{4}")).select("doc_id")


@query("p18_column_health", f"SELECT c AS \"column\", n, nulls FROM (SELECT 'half' AS c, count(*) AS n, count(*) FILTER (WHERE {SCORED} IS NULL) AS nulls FROM lineitem UNION ALL SELECT 'l_tax', count(*), 0 FROM lineitem)")
def health(t: Tables) -> DataFrame:
    """One pass over columns; a constant one is dropped."""
    df = t.lineitem.select(F.when(F.col("l_quantity") % 7 != 0, F.col("l_discount") * 10).alias("half"), "l_tax", F.lit(1.0).alias("flat"))
    kept = schema.drop_degenerate(df, df.columns)
    return schema.column_health(kept, kept.columns).select("column", "n", "nulls")


@query("p15_align", "SELECT n_nationkey, n_name, CAST(NULL AS DOUBLE) AS score, 'unknown' AS label FROM nation")
def align(t: Tables) -> DataFrame:
    """P15."""
    return schema.align(t.nation, {"n_nationkey": "int", "n_name": "string", "score": "double", "label": "string"}, {"label": "unknown"})


# ---------------------------------------------------------------- scalar columns


@query("f1_display_enums", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE upper(o_orderstatus) END AS status, split_part(o_orderpriority, '-', -1) AS short,
lower(regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM orders""")
def enums(t: Tables) -> DataFrame:
    """F1, F5, F12, F34."""
    return t.orders.select("o_orderkey", S.display_enum(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("status"), S.after_last(F.col("o_orderpriority"), "-").alias("short"), S.slug(F.col("o_orderpriority")).alias("slug"))


@query("f2_bands", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS af FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x < 0.35 THEN 'highly constrained' WHEN x < 0.6 THEN 'constrained' WHEN x < 1.0 THEN 'moderate' ELSE 'tolerant' END AS loeuf,
CASE WHEN af > 0 AND af < 1e-4 THEN 'ultra-rare' WHEN af > 0.05 THEN 'common' WHEN af > 0.01 THEN 'low-frequency' END AS freq,
CASE WHEN af IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, af * 10)) END AS clamped, CASE WHEN af IS NULL THEN 'missing' WHEN af * 10 < 0.25 THEN 'q1' WHEN af * 10 < 0.5 THEN 'q2' WHEN af * 10 < 0.75 THEN 'q3' ELSE 'q4' END AS quart,
CASE WHEN x > 0.9 THEN 'very high' WHEN x > 0.75 THEN 'high' WHEN x < 0.1 THEN 'very low' WHEN x < 0.25 THEN 'low' ELSE 'uncertain' END AS tier FROM s""")
def bands(t: Tables) -> DataFrame:
    """F2, F3, F11, F17, F25, F10."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("x"), F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("af"))
    return df.select("l_orderkey", "l_linenumber", S.band_below(F.col("x"), S.CONSTRAINT_BANDS, "tolerant").alias("loeuf"), S.frequency_band(F.col("af")).alias("freq"), S.clamp01(F.col("af") * 10).alias("clamped"), S.quartile_bin(F.col("af") * 10).alias("quart"), S.tier(F.col("x")).alias("tier"))


@query("f4_freq_text", """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount / (l_orderkey + 1) END AS af FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN af IS NULL OR af = 0 THEN 'Not observed' WHEN af < 0.01 THEN '1 in ' || format('{:,}', CAST(round(1 / greatest(af, 1e-12)) AS BIGINT)) ELSE CAST(CAST(round(af * 100, 1) AS DECIMAL(10, 1)) AS VARCHAR) || '%' END AS txt FROM s""")
def freq_text(t: Tables) -> DataFrame:
    """F4."""
    af = F.when(F.col("l_linenumber") != 1, F.col("l_discount") / (F.col("l_orderkey") + 1))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.frequency_text(af).alias("txt"))


@query("f6_lists", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS items FROM documents)
SELECT doc_id, len(items) AS n, items[1] AS first_item, items[-1] AS last_item FROM s""")
def lists(t: Tables) -> DataFrame:
    """Lists in texts; the JSON is parsed again."""
    js = S.list_json(F.col("text"), ",")
    df = t.documents.select("doc_id", F.from_json(js, "array<string>").alias("items"))
    return df.select("doc_id", F.size("items").cast("long").alias("n"), F.try_element_at("items", F.lit(1)).alias("first_item"), F.try_element_at("items", F.lit(-1)).alias("last_item"))


@query("f7_domains", """
WITH s AS (SELECT event_id, 'k' || (user_id % 3) || ':' || event_type || ',bad,x:' || user_id AS raw FROM events),
p AS (SELECT event_id, unnest(list_filter(string_split(raw, ','), lambda x: contains(x, ':'))) AS d FROM s)
SELECT event_id, split_part(d, ':', 1) AS db, split_part(d, ':', 2) AS id FROM p WHERE split_part(d, ':', 1) <> 'k0'""")
def domains(t: Tables) -> DataFrame:
    """F7."""
    raw = F.concat(F.lit("k"), F.col("user_id") % 3, F.lit(":"), F.col("event_type"), F.lit(",bad,x:"), F.col("user_id"))
    return t.events.select("event_id", F.explode(S.domains(raw, ("k0",))).alias("d")).select("event_id", "d.db", "d.id")


@query("f8_decode_calibrate", """
WITH s AS (SELECT p_partkey, p_size - 3 AS i, p_retailprice / 2200 AS v FROM part)
SELECT p_partkey, CASE WHEN i >= 0 AND i < 4 THEN (['A>C', 'A>D', 'A>E', 'A>F'])[i + 1] END AS swap,
CASE WHEN v < 0.1 THEN '0-10' WHEN v < 0.3 THEN '10-30' WHEN v < 0.5 THEN '30-50' WHEN v < 0.7 THEN '50-70' WHEN v < 0.9 THEN '70-90' WHEN v < 1.01 THEN '90-101' ELSE '' END AS band FROM s""")
def decode(t: Tables) -> DataFrame:
    """F8, F22."""
    df = t.part.select("p_partkey", (F.col("p_size") - 3).alias("i"), (F.col("p_retailprice") / 2200).alias("v"))
    text = F.regexp_extract(S.calibration_text(F.col("v")), r"scoring (\d+)\D(\d+)%", 0)
    return df.select("p_partkey", S.decode_class(F.col("i"), S.swap_classes()[:4]).alias("swap"), F.regexp_replace(F.regexp_replace(text, "scoring |%", ""), "–", "-").alias("band"))


@query("f13_keyword_class", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'red|rose') THEN 'warm' WHEN regexp_matches(lower(p_name), 'blue|green') THEN 'cold' ELSE 'other' END AS cls, lower(split_part(p_name, '_', 1)) AS grp, lower(coalesce(nullif(trim(p_type), ''), 'unknown')) AS bucket FROM part")
def keywords(t: Tables) -> DataFrame:
    """F13, F14, F16, F18."""
    return t.part.select("p_partkey", S.keyword_class(F.col("p_name"), [("red|rose", "warm"), ("blue|green", "cold")], "other").alias("cls"), S.head_group(F.col("p_name")).alias("grp"), S.bucket(F.col("p_type")).alias("bucket"))


@query("f20_sameness", "WITH s AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'P' END AS b FROM orders) SELECT o_orderkey, a = b AS same_null, coalesce(a = b, FALSE) AS same_false FROM s")
def sameness(t: Tables) -> DataFrame:
    """F20."""
    a, b = F.nullif(F.col("o_orderstatus"), F.lit("F")), F.when(F.col("o_custkey") % 2 == 0, "O").otherwise("P")
    return t.orders.select("o_orderkey", S.same(a, b, False).alias("same_null"), S.same(a, b, True).alias("same_false"))


@query("f23_likelihood", """
WITH h AS (SELECT CAST(floor(l_discount * 100) AS INT) AS bin, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)
SELECT bin, round(CASE WHEN p + b > 0 THEN p / (p + b) ELSE 0.5 END, 6) AS lr FROM h""")
def likelihood(t: Tables) -> DataFrame:
    """F23, F24, A7."""
    h = t.lineitem.groupBy(F.floor(F.col("l_discount") * 100).cast("int").alias("bin")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("p"), F.count_if(F.col("l_returnflag") == "A").cast("double").alias("b"))
    return h.select("bin", F.round(S.likelihood(F.col("p"), F.col("b")), 6).alias("lr"))


@query("f26_predictors", """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_discount END AS db, l_tax AS own, l_quantity - 25 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 - coalesce(db, own), 6) AS inverted, round(1 - pow(10.0, -coalesce(db, own) * 100 / 10), 6) AS phred,
CASE WHEN d = 0 THEN 'at variant' WHEN abs(d) <= 5 THEN 'local' WHEN abs(d) <= 50 THEN 'regional' ELSE 'distal' END AS where_at, CAST((coalesce(db, own) > 0.05) AS INT) + CAST((own > 0.05) AS INT) AS damaging FROM s""")
def predictors(t: Tables) -> DataFrame:
    """F26, F27."""
    db = F.when(F.col("l_linenumber") <= 3, F.col("l_discount"))
    own, v = F.col("l_tax"), S.predictor(F.when(F.col("l_linenumber") <= 3, F.col("l_discount")), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.predictor(db, own, invert=True), 6).alias("inverted"), F.round(S.predictor(db * 100, own * 100, phred=True), 6).alias("phred"), S.locality(F.col("l_quantity") - 25).alias("where_at"), ((v > 0.05).cast("int") + (own > 0.05).cast("int")).alias("damaging"))


@query("f32_contigs", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MT' ELSE CAST(c_custkey % 23 AS VARCHAR) END AS contig, greatest(1, c_custkey - 100) AS lo, split_part('chr1:' || c_custkey || ':A:T', ':', 2) AS pos FROM customer")
def contigs(t: Tables) -> DataFrame:
    """F32, F34, J18."""
    raw = F.when(F.col("c_custkey") % 3 == 0, "chrM").otherwise(F.concat(F.lit("Chr"), F.col("c_custkey") % 23))
    vid = F.concat(F.lit("chr1:"), F.col("c_custkey"), F.lit(":A:T"))
    return t.customer.select("c_custkey", S.contig(raw).alias("contig"), F.greatest(F.lit(1).cast("long"), F.col("c_custkey") - 100).alias("lo"), S.id_part(vid, 2).alias("pos"))


@query("f33_minmax", "SELECT event_id, round((value - min(value) OVER ()) / nullif(max(value) OVER () - min(value) OVER (), 0), 6) AS u FROM events")
def minmax(t: Tables) -> DataFrame:
    """scaled by the extremes, which are one row."""
    ends = t.events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return t.events.crossJoin(F.broadcast(ends)).select("event_id", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("u"))


@query("f35_expectation", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings), e AS (SELECT vec_id, l, list_transform(l, lambda x: exp(x - list_max(l))) AS w FROM s)
SELECT vec_id, round(list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * (i - 0.5) / len(w))) / list_sum(w), 6) AS expect, list_position(l, list_max(l)) - 1 AS top FROM e""")
def expectation(t: Tables) -> DataFrame:
    """F35."""
    logits = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(S.expectation(logits), 6).alias("expect"), S.argmax(logits).cast("int").alias("top"))


@query("f36_soft_bins", """
WITH s AS (SELECT l_orderkey, l_linenumber, list_transform(range(5), lambda i: exp(-pow((l_discount * 10 - (i + 0.5) / 5) / 0.2, 2) / 2)) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(w[1] / list_sum(w), 6) AS b0, round(w[3] / list_sum(w), 6) AS b2 FROM s""")
def soft(t: Tables) -> DataFrame:
    """F36."""
    bins = S.soft_bins(F.col("l_discount") * 10, 5, 0.2)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.get(bins, F.lit(0)), 6).alias("b0"), F.round(F.get(bins, F.lit(2)), 6).alias("b2"))


@query("f21_fnv1a", r"""
WITH RECURSIVE b AS (SELECT c_custkey, hex(encode(c_name)) AS x FROM customer),
f AS (SELECT c_custkey, x, 14695981039346656037::HUGEINT AS h, 0 AS i FROM b
UNION ALL SELECT c_custkey, x, (xor(h, ('0x' || substr(x, 2 * i + 1, 2))::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, i + 1 FROM f WHERE 2 * i < length(x))
SELECT c_custkey, lpad(lower(to_hex(h::UBIGINT)), 16, '0') AS h FROM f WHERE 2 * i >= length(x)""")
def fnv(t: Tables) -> DataFrame:
    """over UTF-8 bytes."""
    return t.customer.select("c_custkey", S.fnv1a_hex(F.col("c_name")).alias("h"))


@query("map_nested_heads", "SELECT l_orderkey, l_linenumber, round(l_discount, 2) AS disc, CAST(l_discount > 0.05 AS INT) + CAST(l_tax > 0.05 AS INT) AS n_high FROM lineitem")
def nested_heads(t: Tables) -> DataFrame:
    """A flat row as a map by head, filtered and read again."""
    m = F.map_from_arrays(F.array(F.lit("disc"), F.lit("tax")), F.array("l_discount", "l_tax"))
    df = t.lineitem.select("l_orderkey", "l_linenumber", m.alias("m"))
    return df.select("l_orderkey", "l_linenumber", F.round(F.try_element_at("m", F.lit("disc")), 2).alias("disc"), F.size(F.map_filter("m", lambda k, v: v > 0.05)).alias("n_high"))
