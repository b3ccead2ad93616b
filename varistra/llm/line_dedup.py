"""Line deduplication with DataFrame functions only.

Lines are cut at ``\\n``. A line's key is the line without ASCII white space at both ends and with A-Z in lower case.
Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold lose their lines everywhere but in
the largest doc_id that holds them. Lines are exploded with their positions and hashed to 128 bits once, into a table in
the shared folder; distinct documents are counted after partial sums in each task, so that a line that stands everywhere
costs a row for each task; keys over the threshold are joined back, and each text is reassembled from the positions
that it keeps.

Defined results. A null or empty text is one empty line. Rows that share a doc_id are one document, each with its own
text; a repeated row gets its copy's result. Rows with the same doc_id as the largest holder keep their lines. Null
doc_ids are one document, smaller than any other. Lines under ``min_chars`` always stay. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistra.llm import common

BLANK = " \t\n\x0b\x0c\r"
LOWEST = -(1 << 63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Trimmed, A-Z in lower case; lower() does that where all is ASCII, and is much faster."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def with_row_key(docs: DataFrame) -> DataFrame:
    """(doc_id, id, tie, text): id and tie are the same for equal rows, and for no others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    tie = F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("n"), F.col("doc_id").isNull().alias("no_id"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), tie.alias("tie"), "text")


def hashed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, tie, pos, a, b): position and 128-bit hash of the key of each line that is long enough."""
    lines = rows.select("id", "tie", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.length("line") >= min_chars)
    keyed = lines.select("id", "tie", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("id", "tie", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), "key").alias("b"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(a, b, last): keys of at least min_docs distinct documents, and the largest of their doc_ids."""
    counted = lines.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
    return counted.filter(F.col("n") >= min_docs).select("a", "b", "last")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: what is left of each row's text."""
    rows = with_row_key(docs)
    lines = common.materialise(hashed_lines(rows, min_chars), "lines")
    over = common.materialise(repeated_lines(lines, min_docs), "over")
    lost = lines.join(over, ["a", "b"]).filter(F.col("id") != F.col("last"))
    lost = lost.groupBy("id", "tie").agg(F.collect_set("pos").alias("gone"))
    cut = rows.join(lost, ["id", "tie"], "left").withColumn("lines", F.split("text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.transform(places, lambda i: F.get("lines", i))))
    n = F.size("lines").cast("long")
    return cut.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))
