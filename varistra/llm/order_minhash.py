"""Order MinHash fingerprints with DataFrame functions only.

A text's words give overlapping k-mers of ``K`` words (a shorter text is one k-mer). Equal k-mers of a text are
numbered by their occurrence, so all of its (k-mer, number) pairs differ. For each of ``TUPLES`` hash functions the
pairs are split in two by one bit of the hash, the minimal pair of each half is taken, and the two are hashed in the
order in which they stand in the text. The fingerprint is the row of those tuple hashes. Two texts agree in a place
if the same pairs are minimal in both and stand in the same order, so the share of equal places falls with edits and
with moved passages, not only with the words that differ.

K-mer hashes hold 40 bits and their places 24, in one long: sorting and minima then run on primitive values.

Defined results. A null text counts as empty; all empty texts have the same fingerprint (likeness 1). The next
document is the following distinct (doc_id, text) in descending order of doc_id (null doc_ids last, equal doc_ids by
a hash of the text), after the last the first; a repeated row gets the same result as its copy. A table of one
document is its own next. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varistra.llm import common

K = 3
TUPLES = 32
PLACE = 24
PLACES = (1 << PLACE) - 1


def bind(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed_kmers(text: Column, k: int = K) -> Column:
    """array<long>: the hash of each k-mer in the upper bits, its place in the lower."""
    words = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def kmers(h: Column) -> Column:
        n = F.size(h)
        whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(n < k, F.transform(whole, lambda x: x.bitwiseAND(F.lit(~PLACES)))).otherwise(
            F.transform(F.slice(h, 1, n - (k - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))).bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACES))))
        )

    return bind(words, kmers)


def numbered(packed: Column) -> Column:
    """array<long>: the same with occurrence numbers hashed in; runs of equal hashes stand together once sorted."""
    kmer = lambda x: F.shiftright(x, PLACE)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (kmer(F.get(s, j)) != kmer(F.get(s, j - 1))))

        def number(b: Column) -> Column:
            one = lambda x, o: F.xxhash64(kmer(x), o).bitwiseAND(F.lit(~PLACES)).bitwiseOR(x.bitwiseAND(F.lit(PLACES)))
            return F.flatten(F.transform(b, lambda start, r: F.transform(F.slice(s, start + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - start), one)))

        return F.when(F.size(s) == 0, s).otherwise(bind(starts, number))

    return bind(F.sort_array(packed), runs)


def minima(tuples: int = TUPLES) -> list[Column]:
    """Aggregates over rows with a column x of numbered k-mers: two minimal places for each hash function."""
    out = []
    for i in range(tuples):
        mixed = F.xxhash64(F.shiftright("x", PLACE), F.lit(i))
        value = mixed.bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.col("x").bitwiseAND(F.lit(PLACES)))
        half = mixed.bitwiseAND(F.lit(1))
        out += [F.min(F.when(half == b, value)).alias(f"m{i}_{b}") for b in (0, 1)]
    return out


def tuple_hashes(tuples: int = TUPLES) -> Column:
    """The fingerprint: eight hexadecimal digits for each tuple."""

    def one(i: int) -> Column:
        a, b = F.col(f"m{i}_0"), F.col(f"m{i}_1")
        p, q = F.shiftright(a, PLACE), F.shiftright(b, PLACE)
        first = F.coalesce(a.bitwiseAND(F.lit(PLACES)) <= b.bitwiseAND(F.lit(PLACES)), F.lit(True))
        mixed = F.when(first, F.xxhash64(p, q, F.lit(i))).otherwise(F.xxhash64(q, p, F.lit(i)))
        return F.lower(F.lpad(F.hex(mixed.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))

    return F.concat(*(one(i) for i in range(tuples)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", k: int = K, tuples: int = TUPLES) -> DataFrame:
    """keys and fingerprint of each row's text; keys tell the rows apart. Needs no shuffle where rows are dealt by some of keys."""
    arrays = texts.select(*keys, numbered(packed_kmers(F.col(text), k)).alias("xs"))
    found = arrays.select(*keys, F.explode_outer("xs").alias("x")).groupBy(*keys).agg(*minima(tuples))
    return found.select(*keys, tuple_hashes(tuples).alias("fingerprint"))


def likeness(a: Column, b: Column, tuples: int = TUPLES) -> Column:
    """The share of equal places of two fingerprints."""
    same = [F.when(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8), 1).otherwise(0) for i in range(tuples)]
    return sum(same[1:], same[0]) / F.lit(float(tuples))


def next_links(docs: DataFrame) -> DataFrame:
    """(id, tie, doc_id, n_chars, need, prev_id, prev_tie): for each distinct document the one before it, in descending order, and half of that one's length.

    Rows are dealt by range and numbered within each range; the ranges' sizes, one row to a range, give the offsets."""
    ids = docs.select("id", "tie", "doc_id", F.length("text").cast("long").alias("n_chars")).distinct()
    ranged = ids.repartitionByRange(F.desc("id"), F.asc("tie")).withColumn("range", F.spark_partition_id())
    ranged = common.materialise(ranged, "ranges")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    local = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("id"), F.asc("tie")))
    ranked = ranged.withColumn("local", local).join(F.broadcast(offsets), "range").withColumn("rank", F.col("before") + F.col("local") - 1)  # a row for each range
    ranked = common.materialise(ranked.select("id", "tie", "doc_id", "n_chars", "rank", "total"), "ranks")
    before = ranked.select(F.col("id").alias("prev_id"), F.col("tie").alias("prev_tie"), F.expr("n_chars div 2").alias("need"), F.expr("(rank + 1) % total").alias("rank"))
    return ranked.select("id", "tie", "doc_id", "n_chars", "rank").join(before, "rank").drop("rank")


def compare_edited(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text: the last half of the code points replaced by as many of the next document's first."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    low = F.lit(-(1 << 63)).cast("long")
    docs = docs.select("doc_id", F.coalesce("doc_id", low).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("tie"), "text")
    links = common.materialise(next_links(docs), "next")
    texts = docs.select("id", "tie", "text")  # the same columns on both sides: texts are shuffled once, and that exchange is read twice
    copy = F.row_number().over(Window.partitionBy("id", "tie").orderBy("need")).alias("copy")
    rows = texts.join(links.drop("doc_id", "n_chars").hint("merge"), ["id", "tie"]).select("*", copy)
    heads = rows.filter("copy = 1").select(F.col("prev_id").alias("id"), F.col("prev_tie").alias("tie"), F.expr("substring(text, 1, cast(need as int))").alias("head"))
    rows = texts.join(links.drop("need").hint("merge"), ["id", "tie"]).withColumn("copy", F.row_number().over(Window.partitionBy("id", "tie").orderBy("n_chars")))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), "head")
    both = rows.join(heads.hint("merge"), ["id", "tie"]).withColumn("edited", edited)
    keys = ["id", "tie", "copy", "prev_id", "prev_tie", "doc_id", "n_chars", "edited_sha256"]
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    marks = fingerprints(both.select(*keys, "v.which", F.col("v.t").alias("text")), [*keys, "which"])
    pick = lambda w: F.max(F.when(F.col("which") == w, F.col("fingerprint")))
    marks = common.materialise(marks.groupBy(*keys).agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint")), "omh")
    after = marks.filter("copy = 1").select(F.col("prev_id").alias("id"), F.col("prev_tie").alias("tie"), F.col("fingerprint").alias("next_fingerprint"))
    return marks.join(after, ["id", "tie"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )
