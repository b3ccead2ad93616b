"""Queries of the serving layer's operators and of sources that are written and read again, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.functions import scalar as S
from varistra.operators import hist
from varistra.operators import relational as R
from varistra.operators import resample
from varistra.plans.catalog import Tables, query
from varistra.plans.table_queries import scratch
from varistra.sources import readers, sinks

# ---------------------------------------------------------------- searches and look-ups

FOUND = "SELECT p_partkey, p_name, p_retailprice, CAST({tier} AS INT) AS tier FROM part WHERE {where} ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 30"


def part_search(t: Tables, text: str) -> DataFrame:
    parts = t.part.withColumns({"rs": F.concat(F.lit("rs"), F.col("p_partkey") % 500), "other": F.col("p_partkey") + 40})
    found = R.search(parts, text, "rs", ["p_partkey", "other"], "p_name", "p_retailprice", "p_partkey")
    return found.select("p_partkey", "p_name", "p_retailprice", "tier")


@query("p7_search_rs_id", FOUND.format(tier="0", where="p_partkey % 500 = 17"))
def search_rs_id(t: Tables) -> DataFrame:
    """The rsID mode."""
    return part_search(t, " RS17 ")


@query("p7_search_number", FOUND.format(tier="0", where="p_partkey = 50 OR p_partkey + 40 = 50"))
def search_number(t: Tables) -> DataFrame:
    """The numeric mode, over two id columns."""
    return part_search(t, "50")


@query("p8_search_short", FOUND.format(tier="0", where="false"))
def search_short(t: Tables) -> DataFrame:
    """A query of one character finds nothing."""
    return part_search(t, "5 ")


@query("j9_position_lookup", """
WITH e AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS chrom, c_custkey % 97 AS pos FROM customer), t AS (SELECT c_nationkey AS chrom, c_custkey % 97 AS pos, max(c_acctbal) AS v FROM customer WHERE c_acctbal > 5000 GROUP BY ALL)
SELECT e.chrom, e.pos, coalesce(t.v, -100.0) AS v FROM e LEFT JOIN t ON e.chrom = t.chrom AND e.pos = t.pos""")
def position_lookup(t: Tables) -> DataFrame:
    """Values at exact positions, a fill where there are none."""
    keys = [F.col("c_nationkey").cast("long").alias("chrom"), (F.col("c_custkey") % 97).alias("pos")]
    table = t.customer.filter("c_acctbal > 5000").groupBy(*keys).agg(F.max("c_acctbal").alias("v"))
    return R.position_lookup(t.customer.select(*keys).distinct(), table, ["chrom", "pos"], ["v"], -100.0)


# ---------------------------------------------------------------- predicates and display

SERVED = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN NULL ELSE 'MODIFIER' END AS impact,
CASE p_partkey % 7 WHEN 0 THEN 'Missense_variant' WHEN 1 THEN 'start_lost' WHEN 2 THEN 'intron_variant' WHEN 3 THEN NULL WHEN 4 THEN 'synonymous_variant' WHEN 5 THEN 'missense_variant' ELSE '' END AS csq,
CASE p_partkey % 6 WHEN 0 THEN 'Stop Lost' WHEN 1 THEN 'Missense' WHEN 2 THEN 'Splice Donor' WHEN 3 THEN NULL WHEN 4 THEN 'Synonymous' ELSE 'Other' END AS shown,
CASE p_partkey % 11 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE p_brand END AS gene,
CASE p_partkey % 4 WHEN 0 THEN 'p.Arg1=' WHEN 1 THEN 'p.Arg1Gly' WHEN 2 THEN '' ELSE NULL END AS hgvsp,
CASE p_partkey % 6 WHEN 0 THEN 'Likely Pathogenic' WHEN 1 THEN 'benign' WHEN 2 THEN 'Pathogenic/Benign' WHEN 3 THEN NULL WHEN 4 THEN 'Uncertain' ELSE 'Likely_benign' END AS sig FROM part"""


def served(t: Tables) -> DataFrame:
    t.part.createOrReplaceTempView("part")
    return t.spark.sql(SERVED)


@query("p10_coding", f"""
WITH s AS ({SERVED}) SELECT id FROM s WHERE trim(gene) <> '' AND gene IS NOT NULL AND (coalesce(impact IN ('HIGH', 'MODERATE'), false)
OR regexp_matches(coalesce(lower(csq), ''), 'missense|frameshift|stop|splice|inframe|start_lost|stop_lost') OR regexp_matches(coalesce(lower(shown), ''), 'missense|frameshift|stop|splice|inframe|start lost|stop lost'))""")
def coding(t: Tables) -> DataFrame:
    """P10: the coding predicate."""
    return served(t).filter(S.coding([F.col("id"), F.col("gene")], F.col("impact"), F.col("csq"), F.col("shown"))).select("id")


@query("p12_clinical_class", f"""
WITH s AS ({SERVED}), c AS (SELECT id, contains(lower(sig), 'pathogenic') AS p, contains(lower(sig), 'benign') AS b FROM s)
SELECT id, CASE WHEN p AND NOT b THEN 'pathogenic' WHEN b AND NOT p THEN 'benign' END AS class FROM c""")
def clinical(t: Tables) -> DataFrame:
    """Classes that a text names alone."""
    return served(t).select("id", S.clinical_class(F.col("sig")).alias("class"))


@query("f19_consequence_bin", f"""
WITH s AS ({SERVED}) SELECT id, CASE shown WHEN 'Missense' THEN 'missense' WHEN 'Splice Donor' THEN 'splice' WHEN 'Synonymous' THEN 'synonymous' END AS bin FROM s WHERE shown IN ('Missense', 'Splice Donor', 'Synonymous')""")
def consequence_bin(t: Tables) -> DataFrame:
    """five bins; rows with any other consequence go."""
    return served(t).select("id", S.consequence_bin(F.col("shown")).alias("bin")).filter("bin is not null")


@query("f31_hgvs_consistent", f"""
WITH s AS ({SERVED}) SELECT id, NOT ((coalesce(contains(hgvsp, '='), false) AND coalesce(csq = 'missense_variant', false))
OR (NOT coalesce(contains(hgvsp, '='), false) AND coalesce(hgvsp, '') <> '' AND coalesce(csq = 'synonymous_variant', false))) AS consistent FROM s""")
def hgvs(t: Tables) -> DataFrame:
    """protein change against consequence."""
    return served(t).select("id", S.hgvs_consistent(F.col("hgvsp"), F.col("csq")).alias("consistent"))


HEAD_NAMES = [("amino_acid_L", "Amino Acid L"), ("score_cpg_island", "Cpg Island"), ("region_utr3_c", "UTR3"), ("PF00001", "PF00001"), ("known", "A known head"), ("region_plddt", "pLDDT"), ("half2way_iii", "Half2Way III"), ("x", "X")]


@query("f15_head_display", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b.replace('Cpg', 'CpG')}')" for a, b in HEAD_NAMES) + ") AS t(head, shown)")
def head_display(t: Tables) -> DataFrame:
    """display names of heads."""
    heads = t.spark.createDataFrame([(a,) for a, _ in HEAD_NAMES], "head string")
    return heads.select("head", S.head_display(F.col("head"), {"known": "A known head"}, ("amino_acid_", "score_", "region_")).alias("shown"))


@query("f15_domain_names", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'Region ' || (p_partkey % 90 + 10) END AS shown FROM part""")
def domain_names(t: Tables) -> DataFrame:
    """heads of a table; accessions get their domain's name from another, an unknown one keeps its own."""
    k = F.col("p_partkey")
    heads = t.part.select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit("pfam_PF"), F.lpad(k.cast("string"), 7, "0"))).otherwise(F.concat(F.lit("score_region_"), k % 90 + 10)).alias("head"))
    names = t.part.select(F.concat(F.lit("PF"), F.lpad(k.cast("string"), 7, "0")).alias("accession"), F.col("p_brand").alias("name"))
    return S.domain_display(heads, "head", names, "accession", "name", ("pfam_", "score_")).select("p_partkey", "shown")


@query("f30_population_widths", """
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 50) / 1000.0 END AS afr, (c_custkey % 7) / 10.0 AS nfe FROM customer), m AS (SELECT *, greatest(1e-6, coalesce(afr, 0), nfe) AS most FROM s)
SELECT c_custkey, round(CASE WHEN afr > 0 THEN greatest(2, afr / most * 100) ELSE 0 END, 6) AS afr, round(CASE WHEN nfe > 0 THEN greatest(2, nfe / most * 100) ELSE 0 END, 6) AS nfe FROM m""")
def population(t: Tables) -> DataFrame:
    """populations against the largest."""
    k = F.col("c_custkey")
    widths = S.population_widths({"afr": F.when(k % 3 != 0, (k % 50) / 1000.0), "nfe": (k % 7) / 10.0})
    return t.customer.select("c_custkey", *[F.round(c, 6).alias(n) for n, c in widths.items()])


@query("f27_consensus", """
SELECT l_orderkey, l_linenumber, (l_discount > 0.05)::INT + (l_quantity > 30)::INT + CASE WHEN l_tax > 0.04 THEN (l_tax > 0.06)::INT ELSE 0 END AS damaging, 2 + (l_tax > 0.04)::INT AS calls FROM lineitem""")
def consensus(t: Tables) -> DataFrame:
    """damaging calls of predictors, null where one has no call."""
    n, calls = S.consensus([F.col("l_discount") > 0.05, F.col("l_quantity") > 30, F.when(F.col("l_tax") > 0.04, F.col("l_tax") > 0.06)])
    return t.lineitem.select("l_orderkey", "l_linenumber", n.alias("damaging"), calls.alias("calls"))


LONG = "UNPIVOT (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 25 - 1 AS qty, l_discount * 20 - 1 AS disc, l_tax * 25 - 1 AS tax FROM lineitem) ON qty, disc, tax INTO NAME head VALUE v"


HEADS = ["qty", "disc", "tax"]


def heads_wide(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 25 - 1).alias("qty"), (F.col("l_discount") * 20 - 1).alias("disc"), (F.col("l_tax") * 25 - 1).alias("tax"))


@query("f28_disruption_top", f"""
WITH l AS ({LONG}), s AS (SELECT head, stddev_samp(v) AS sd FROM l GROUP BY 1), z AS (SELECT id, l.head, CASE WHEN sd > 0 THEN round(abs(v) / sd, 6) ELSE 0 END AS score FROM l JOIN s USING (head)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, head) AS rank FROM z WHERE score >= 1)
SELECT id, head, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 2""")
def disruption(t: Tables) -> DataFrame:
    """heads whose difference is at least one standard deviation, largest first, over all rows of a key."""
    wide = heads_wide(t)
    sd = wide.agg(F.array(*[F.stddev_samp(h) for h in HEADS]).alias("sd"))  # one row
    score = lambda v, i: F.when(F.get("sd", i) > 0, F.round(F.abs(v) / F.get("sd", i), 6)).otherwise(0.0)
    return R.ranked_keys(wide.join(F.broadcast(sd), F.lit(True)), ["id"], HEADS, score, 1.0, 2)


@query("f29_effect_top", f"""
WITH l AS ({LONG}), k AS (SELECT id, head, abs(v) AS score, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, head) AS rank FROM l) SELECT id, head, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 1""")
def effect(t: Tables) -> DataFrame:
    """the largest effects by size, over all rows of a key."""
    return R.ranked_keys(heads_wide(t), ["id"], HEADS, lambda v, i: F.abs(v), 0.0, 1)


@query("f24_cell_fraction", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS p, CAST(least(9, greatest(0, floor(l_discount * 100))) AS INT) AS xb, CAST(least(9, greatest(0, floor(l_tax * 100))) AS INT) AS yb FROM lineitem),
c AS (SELECT xb, yb, round(100 * count(*) FILTER (WHERE p) / count(*), 1) / 100 AS f FROM s GROUP BY ALL)
SELECT l_orderkey, l_linenumber, coalesce(f, 0.5) AS fraction FROM s LEFT JOIN c USING (xb, yb)""")
def cell_fraction(t: Tables) -> DataFrame:
    """each row's heatmap cell."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), "l_returnflag")
    cells = hist.heatmap(df, [], "x", "y", F.col("l_returnflag") == "R", least=0)
    return hist.cell_fraction(df, cells, "x", "y").select("l_orderkey", "l_linenumber", "fraction")


# ---------------------------------------------------------------- differences, densities, samples and resampling


@query("a12_row_differences", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), p AS (SELECT vec_id, list_slice(a, 1, 32) AS x, list_slice(a, 33, 64) AS y FROM s),
d AS (SELECT *, list_transform(range(1, 33), lambda i: abs(x[i] - y[i])) AS d FROM p)
SELECT vec_id, round(list_avg(d), 6) AS mean_diff, round(list_median(d), 6) AS median_diff, round(sqrt(list_sum(list_transform(d, lambda v: v * v))), 6) AS l2,
round(list_sum(list_transform(range(1, 33), lambda i: x[i] * y[i])) / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v)))), 6) AS cosine FROM d""")
def differences(t: Tables) -> DataFrame:
    """Two column groups of a row."""
    found = S.row_differences(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return t.embeddings.select("vec_id", *[F.round(c, 6).alias(n) for n, c in found.items()])


@query("a31_density", """
WITH s AS (SELECT o_orderstatus = 'F' AS cohort, CAST(least(39, greatest(0, floor(o_totalprice / 600000 * 40))) AS INT) AS bin FROM orders), c AS (SELECT cohort, bin, count(*) AS n FROM s GROUP BY ALL)
SELECT cohort, bin, round(n / (sum(n) OVER (PARTITION BY cohort) * 15000.0), 12) AS density FROM c""")
def density(t: Tables) -> DataFrame:
    """Densities of two cohorts."""
    found = hist.density(t.orders.select((F.col("o_orderstatus") == "F").alias("cohort"), "o_totalprice"), "cohort", "o_totalprice", 40, 0.0, 600000.0)
    return found.withColumn("density", F.round("density", 12))


@query("m16_pair_score", """
WITH z AS (UNPIVOT (SELECT p_partkey AS node, (p_size - 25.0) / 14 AS size, (p_retailprice - 1000) / 300 AS price FROM part) ON size, price INTO NAME feature VALUE z), w AS (SELECT * FROM (VALUES ('size', 2.0), ('price', 0.5)) t(feature, w))
SELECT a.node AS u, b.node AS v, round(sum(w * abs(a.z + b.z)) / sum(w), 6) AS score FROM z a JOIN z b ON b.node = a.node + 1 AND a.feature = b.feature JOIN w ON a.feature = w.feature GROUP BY ALL""")
def pair_score(t: Tables) -> DataFrame:
    """Weighted pair score."""
    z = t.part.select(F.col("p_partkey").alias("node"), ((F.col("p_size") - 25.0) / 14).alias("size"), ((F.col("p_retailprice") - 1000) / 300).alias("price")).unpivot(["node"], ["size", "price"], "feature", "z")
    weights = t.spark.createDataFrame([("size", 2.0), ("price", 0.5)], "feature string, w double")
    pairs = t.part.select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v"))
    return resample.pair_score(pairs, z, weights).withColumn("score", F.round("score", 6))


@query("m17_split_halves", """
WITH m AS (SELECT o_custkey AS g, month(o_orderdate) AS f, avg(o_totalprice) AS m FROM orders GROUP BY ALL), r AS (SELECT *, unnest(range(1, 6)) AS repeat FROM m),
s AS (SELECT repeat, f, avg(m) FILTER (WHERE (g + repeat * (g // 7)) % 2 = 0) AS a, avg(m) FILTER (WHERE (g + repeat * (g // 7)) % 2 <> 0) AS b FROM r GROUP BY ALL),
k AS (SELECT repeat, f, rank() OVER (PARTITION BY repeat ORDER BY a) AS ra, rank() OVER (PARTITION BY repeat ORDER BY b) AS rb FROM s WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT CAST(repeat AS INT) AS repeat, count(*) AS features, round(corr(ra, rb), 6) AS rho FROM k GROUP BY 1""")
def split_halves(t: Tables) -> DataFrame:
    """Stability over halves of the groups."""
    long = t.orders.select(F.col("o_custkey").alias("g"), F.month("o_orderdate").alias("f"), "o_totalprice")
    half = F.expr("(g + repeat * (g div 7)) % 2 = 0")
    return resample.split_halves(long, "g", "f", "o_totalprice", 5, half).withColumn("rho", F.round("rho", 6))


TIMES = "CASE " + " ".join(f"WHEN u < {cut!r} THEN {i}" for i, cut in enumerate(resample.POISSON)) + f" ELSE {len(resample.POISSON)} END"


@query("m13_stratified_bootstrap", f"""
WITH g AS (SELECT c_mktsegment, o_custkey AS g, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT c_mktsegment, rep, m, {resample.sql_draw(7, "g", "rep")} / {resample.PRIME}.0::DOUBLE AS u FROM g, (SELECT unnest(range(1, 201)) AS rep)),
b AS (SELECT c_mktsegment, rep, sum({TIMES} * m) / greatest(1, sum({TIMES})) AS b FROM r GROUP BY ALL),
ci AS (SELECT c_mktsegment, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM b GROUP BY 1), s AS (SELECT c_mktsegment, count(*) AS groups, avg(m) AS mean FROM g GROUP BY 1)
SELECT c_mktsegment, groups, round(mean, 4) AS mean, CASE WHEN groups >= 10 THEN round(lo, 4) END AS lo, CASE WHEN groups >= 10 THEN round(hi, 4) END AS hi FROM s JOIN ci USING (c_mktsegment)""")
def stratified(t: Tables) -> DataFrame:
    """An interval for each stratum."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    found = resample.bootstrap(rows, "o_custkey", "o_totalprice", 200, 7, by=["c_mktsegment"])
    return found.select("c_mktsegment", "groups", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")])


@query("m13_strata", "WITH m AS (SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_mktsegment, count(*) AS groups, round(avg(m), 4) AS mean, true AS inside FROM m GROUP BY 1")
def strata(t: Tables) -> DataFrame:
    """Groups and means of the strata, and that each interval holds its mean."""
    found = stratified(t)
    inside = F.coalesce((F.col("lo") <= F.col("mean")) & (F.col("mean") <= F.col("hi")), F.lit(True))
    return found.select("c_mktsegment", "groups", "mean", inside.alias("inside"))


@query("o6_seeded_sample", f"SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY {resample.sql_draw(3, 'c_custkey', '0')}, c_custkey LIMIT 100)")
def sample(t: Tables) -> DataFrame:
    """A seeded sample in order of its keys."""
    return R.seeded_sample(t.customer.select("c_custkey"), "c_custkey", 100, 3)


# ---------------------------------------------------------------- sources that are written and read again


@query("s6_commented_tsv", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS size FROM supplier")
def commented_tsv(t: Tables) -> DataFrame:
    """Tab-separated text without a header, with comment lines and given names."""
    path = scratch(t, "tsv")
    lines = t.supplier.select(F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey").alias("value"))
    lines.union(t.spark.createDataFrame([("#id\tname\tsize",)], "value string")).write.text(path)
    return readers.delimited(t.spark, path, "\t", ["id", "name", "size"], "#")


@query("s7_edge_list", "SELECT CAST(n_nationkey AS VARCHAR) AS protein1, CAST(n_regionkey AS VARCHAR) AS protein2, '700' AS score FROM nation")
def edge_list(t: Tables) -> DataFrame:
    """Space-separated text with a header, all as strings."""
    path = scratch(t, "edges")
    t.nation.select(F.col("n_nationkey").alias("protein1"), F.col("n_regionkey").alias("protein2"), F.lit("700").alias("score")).write.option("header", True).option("sep", " ").csv(path)
    return readers.delimited(t.spark, path, " ")


@query("s9_gene_sets", "WITH s AS (SELECT DISTINCT p_size AS set_id, 'set ' || p_size AS set_name, upper(p_brand) AS gene FROM part) SELECT * FROM s WHERE set_id IN (SELECT set_id FROM s GROUP BY 1 HAVING count(*) >= 2)")
def gene_sets(t: Tables) -> DataFrame:
    """Nested JSON sets of at least two members."""
    member = lambda x: F.struct(F.struct(F.concat(F.lit(" "), F.lower(x)).alias("gene_name")).alias("swissprot"))
    sets = t.part.groupBy(F.col("p_size").cast("long").alias("complex_id")).agg(F.collect_set("p_brand").alias("b"))
    path = scratch(t, "sets")
    one = F.struct("complex_id", F.concat(F.lit("set "), "complex_id").alias("complex_name"), F.transform("b", member).alias("subunits"))
    sets.agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)  # one JSON list, as such files are
    return readers.gene_sets(t.spark, path).select(F.col("set_id").cast("int").alias("set_id"), "set_name", "gene")


@query("s12_gather", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0")
def gather(t: Tables) -> DataFrame:
    """Values by chunk and offset."""
    rows = t.customer.select((F.col("c_custkey") % 8).alias("chunk"), F.floor(F.col("c_custkey") / 8).alias("offset"), F.col("c_acctbal").alias("v"), "c_custkey")
    index = rows.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), "chunk", "offset")
    return readers.gather(index, rows.select("chunk", "offset", "v"))


@query("s15_cache", "SELECT r_regionkey, r_name, true AS kept FROM region")
def cache(t: Tables) -> DataFrame:
    """A table made once for a content hash of its input; the second call must not make it again."""
    path, key = scratch(t, "cache"), readers.fingerprint(t.region, ["r_regionkey", "r_name"])
    readers.cached(t.spark, path, key, lambda: t.region.select("r_regionkey", "r_name"))

    def again():
        raise AssertionError("it was stored")

    same = key == readers.fingerprint(t.region.orderBy(F.desc("r_name")), ["r_regionkey", "r_name"])
    return readers.cached(t.spark, path, key, again).withColumn("kept", F.lit(same))


@query("s17_vocabulary", """
SELECT p_brand AS head, count(DISTINCT p_type)::INT AS n_classes, CASE WHEN count(DISTINCT p_type) = 2 THEN 'binary' ELSE 'categorical' END AS kind, CASE WHEN max(p_size) > 49 THEN 'large' END AS category, NULL::VARCHAR AS display_name, NULL::VARCHAR AS "group" FROM part GROUP BY 1""")
def vocabulary(t: Tables) -> DataFrame:
    """heads' settings, written as JSON files and read back; a missing setting is null."""
    types = F.count_distinct("p_type").cast("int")
    about = t.part.groupBy(F.col("p_brand").alias("head")).agg(types.alias("n_classes"), F.when(types == 2, "binary").otherwise("categorical").alias("kind"), F.when(F.max("p_size") > 49, "large").alias("category"))
    path = scratch(t, "vocabulary")
    about.select(F.to_json(F.struct(*about.columns)).alias("value")).write.text(path)
    return readers.vocabulary_files(t.spark, path)


@query("k5_settings", """
SELECT o_orderstatus AS key, '{"lo":' || min(o_orderkey) || ',"n":' || count(*) || ',"priorities":["' || list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', '","') || '"]}' AS value FROM orders GROUP BY 1""")
def settings(t: Tables) -> DataFrame:
    """K3, K5: statistics of a table as JSON settings, written and read."""
    found = t.orders.groupBy(F.col("o_orderstatus").alias("key")).agg(F.min("o_orderkey").alias("lo"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))
    path = scratch(t, "settings")
    sinks.settings_of(found, "key").write.parquet(path)
    return t.spark.read.parquet(path)


@query("k11_item_files", "SELECT r_regionkey AS key, r_name AS name FROM region")
def item_files(t: Tables) -> DataFrame:
    """A JSON file for each item, and the items read back from them."""
    path = scratch(t, "items")
    sinks.item_files(t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), path, "key")
    files = t.spark.read.text(f"{path}/*/*", wholetext=True)
    return files.select(F.from_json("value", "key int, name string").alias("j")).select("j.key", "j.name")


@query("s11_table_sql", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def table_sql(t: Tables) -> DataFrame:
    """SQL over a served table."""
    t.orders.createOrReplaceTempView("served_orders")
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM served_orders GROUP BY 1")


