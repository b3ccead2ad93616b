"""How five filters of documents interact, in every order: counts from a histogram of failure masks.

Native expressions give each row a mask of the filters that it fails (bit 0 is A): A fewer than 200 words, B fewer than
half of the words distinct, C over 2 % of the code points in A-Z, D holds any of ``#$%&*|``, E the same text as a row with
a smaller doc_id. A-D come from the text alone, in one scan that leaves 32 bytes of digest instead of it; E comes from the
smallest doc_id of each digest, which is summed up in each task first and joined back by digest and doc_id, so that a text
with very many copies is never one key. Labels are joined by doc_id. Each part then has at most 32 cells (mask, rows, good,
toxic), and every order and step is a sum over the cells of a part: what a step removes fails its filter and none before.

Defined results. A null text counts as empty (it fails A alone, and E if a smaller doc_id has one). A null source is the
part ''. Rows are counted one by one: a repeated row with the smallest doc_id of its text is no copy, as no doc_id is
smaller. Null doc_ids are smaller than any other and have no label. Where labels repeat a doc_id, a 1 in any row counts.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistra.llm import common

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
COPY = 1 << FILTERS.index("E")
LOWEST = -(1 << 63)


def text_mask(text: Column) -> Column:
    """The bits of A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text), text.rlike(SIGNS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each row of docs(doc_id, text, source)."""
    text = common.text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text_mask(text).alias("mask"))
    rows = common.materialise(rows, "masks")  # short rows; texts are read once
    first = rows.groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality"), one("toxic"))
    found = rows.join(first, ["key", "id"], "left").join(known, "id", "left")
    copy = F.when(F.col("first").isNull(), COPY).otherwise(0)
    return found.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    cells = masks(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_at = lambda i: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", i, F.lit(1))) - ord("A"))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), bit_at(i)).otherwise(0))
    steps = steps.withColumn("bit", bit_at(F.col("step"))).withColumn("before", before)
    fails, earlier = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0, lambda c: c["mask"].bitwiseAND(F.col("before")) != 0

    def total(value, where=lambda c: F.lit(True)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c), value(c)).otherwise(F.lit(0)).cast("long"))

    rows, removed = lambda c: c["n"], lambda c: fails(c) & ~earlier(c)
    return steps.select(
        "part", "filter_order", "step",
        total(rows, lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total(rows, removed).alias("removed"),
        total(rows, lambda c: fails(c) & earlier(c)).alias("redundant"),
        total(rows, lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        # of the 120 orders, those in which this filter comes before the others that the cell fails
        total(lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("int"), fails).alias("shapley"),
    )
