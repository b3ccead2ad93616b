"""The queries of the corpus operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistra.llm import common, decontaminate, divergence, filter_audit, html_text, line_dedup, minhash, mixing, order_minhash, quality, suffix_dedup, token_output, toxicity, warc


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written in order and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    out = token_output.write_tokens(common.read_table(spark, sf_dir, "documents"), common.scratch(spark, "op1"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_output.read_tokens(spark, out, digest=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: sources weigh 3, 1, 2 in turn and share 150 % of all words, each at most twice."""
    docs = mixing.with_size(common.read_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_size")
    mixed = mixing.mix_sized(common.materialise(docs, "sizes"), weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), "source")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted text, and whether it is kept."""
    return quality.classify(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from deduplicated archives."""
    records = warc.deduplicate(common.read_table(spark, sf_dir, "pages"), common.scratch(spark, "op4"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates: 2-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), k=2, percent=80)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    return order_minhash.compare_edited(common.read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those dropped, and a digest of the rest."""
    kept = line_dedup.dedup_lines(common.read_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by its nearest labelled examples."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, common.read_table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html_text.extract(common.read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items that it leaks."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, those removed as repeated strings of 50 bytes, and a digest of the rest."""
    left = suffix_dedup.dedup_bytes(common.read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from every other of its language, and its 200 most typical terms."""
    return divergence.audit(common.read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of five filters removes, for every source."""
    return filter_audit.audit(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op10_decontaminate": op10_decontaminate,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_minhash": op5_minhash,
    "op6_order_minhash": op6_order_minhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_html_text": op9_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common_key AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, common_key.k IS NOT NULL AND doc_id <> common_key.last_id AS gone FROM keyed LEFT JOIN common_key USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lang_all AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
cell AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT d.lang, d.source, coalesce(any_value(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cell GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(cell.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(cell.c, 0) + 1)) // (g.n + l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v)::HUGEINT AS q
      FROM g JOIN kept k USING (lang) JOIN lang_all l USING (lang) LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every_pair
UNION ALL
SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term)::INT AS rank FROM p WHERE c > 0 AND p > q QUALIFY rank <= 200
""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
m AS (SELECT part, doc_id, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > first_id] AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, ascii(substr(filter_order, step, 1)) - 64 AS nth, [ascii(z) - 64 FOR z IN string_split(substr(filter_order, 1, step - 1), '') IF z <> ''] AS earlier FROM steps),
one AS (SELECT part, filter_order, step, x, n, good, toxic, fails[nth] AS bad, list_contains([fails[z] FOR z IN earlier], true) AS gone, len([z FOR z IN fails IF z]) AS bads FROM cells, s),
r AS (SELECT part, filter_order, step, any_value(x) AS x, sum(n) FILTER (WHERE NOT bad AND NOT gone) AS kept, sum(n) FILTER (WHERE bad AND NOT gone) AS removed, sum(n) FILTER (WHERE bad AND gone) AS redundant, sum(n) FILTER (WHERE bad AND bads = 1) AS unique_fails,
      sum(good) FILTER (WHERE bad AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE bad AND NOT gone) AS toxic_lost FROM one GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
""",
}
