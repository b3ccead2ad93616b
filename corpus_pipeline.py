"""A training corpus from documents: toxicity, near-duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps with docs' own columns; the last returns
what the written token shards hold. ``run`` writes each stage's rows to the shared folder and reads them again, so a
lost executor never costs more than one stage.

Defined results, besides those of the operators: null, empty and blank texts are never toxic, repeated or leaked, so
they pass; rows equal in doc_id and text are copies, of which one stays; extra columns pass through all but the last
stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varistra.llm import common, decontaminate, minhash, mixing, token_output, toxicity

TOKENIZER = "byte_bpe_50k.json"
REJECT_AT = 0.5


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under REJECT_AT, and those that have no word to be toxic."""
    found = fresh(docs, "stage_toxicity")
    scored = toxicity.score(docs, common.read_table(spark, sf_dir, "labels"), column=found)
    blank = F.regexp_count(common.text_or_empty(), F.lit(common.WORD)) == 0
    return scored.filter(blank | (F.col(f"{found}.score") < REJECT_AT)).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (five-word shingles, 0.8 or more)."""
    found, name = minhash.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80), fresh(docs, "stage_copy")
    kept = common.materialise(found.filter("kept or doc_id is null and component_id is null").select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    rows = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.col("text").isNull()).orderBy("doc_id"))
    return rows.withColumn(name, copy).filter(F.col(name) == 1).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    items = fresh(docs, "stage_items")
    found = decontaminate.contaminated(docs, common.read_table(spark, sf_dir, "benchmark"), column=items)
    return found.filter(F.size(items) == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 3, 1, 2 in turn and share 150 % of all words, each at most twice."""
    return mixing.mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the written shards."""
    import public_tokenizers

    out = token_output.write_tokens(docs, common.scratch(spark, "corpus"), public_tokenizers.path(TOKENIZER), end_id=0)
    return token_output.read_tokens(spark, out, digest=True)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_copies), ("decontamination", without_leaks), ("mixing", mixed), ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
