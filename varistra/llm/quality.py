"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes of UTF-8 with ``ORDER`` - 1 bytes of context, after a start mark and up to an end mark. Symbols
take nine bits, so the marks are none of the bytes that a text may hold, and a gram of ORDER symbols fits in one long:
grams are counted exactly, without hashes. Counts of the trusted documents are partial in each task and meet by gram.
Lower orders count the distinct grams that a shorter one ends (continuation counts); grams that begin with the start
mark, which nothing precedes, keep their raw counts. Discounts for counts of 1, 2 and more come from the counts of counts
of each order. Probabilities are joined order by order, (gram with context) and (gram with its shorter one), and written
to the shared folder as sorted shards of at most about ``SHARD_ROWS`` rows. Scoring reads whole texts where they lie: a
task sorts its grams, takes what each shard holds of them, and backs off where a gram wasn't seen. No text is shuffled,
no table is sent whole.

A document's perplexity is per byte, end mark included. The model learns from the trusted documents but one in ``FOLDS``
(by a hash of doc_id). Those left out are to the model what any other document is, so a language's threshold is the
``QUANTILE`` of their perplexities: about 1 - QUANTILE of good documents that the model never saw are rejected.

Defined results. A null or empty text is the end mark alone and is always kept. A null lang is a language of its own.
A language without trusted documents among those left out has a null threshold and is kept whole. Without any trusted
document all perplexities are those of the uniform law. A doc_id that is labelled twice is trusted if any label says so.
Repeated rows are scored alike, and count each in training. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistra.llm import common

ORDER = 6
BITS = 9
SYMBOLS = 257
QUANTILE = 0.99
FOLDS = 5
#: Bytes of text whose grams are sorted at a time.
CHUNK = 2 << 20
SHARD_ROWS = 1 << 20
#: Trusted ids up to this many (16 MB) go to every task; more are joined by a shuffle.
SENT_IDS = 2_000_000
START, END = 256, 257
TAG = BITS * ORDER


def low(k: int) -> int:
    """The mask of a gram's last k symbols."""
    return (1 << BITS * k) - 1


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all grams of ORDER symbols of the texts between marks, where each text's begin)."""
    x = np.frombuffer(b"".join(bytes(ORDER - 1) + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    n = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(n + ORDER - 1)
    x[ends - 1] = END
    for i in range(ORDER - 1):
        x[ends - n - 1 - i] = START
    g = np.zeros(len(x) - ORDER + 1, np.int64)
    for i in range(ORDER):
        g = (g << BITS) | x[i : len(x) - ORDER + 1 + i]
    keep = np.ones(len(g), bool)  # grams over the seam of two texts go
    for i in range(1, ORDER):
        keep[ends[:-1] - i] = False
    return g[keep], np.cumsum(n) - n


def chunks(texts, size: int = CHUNK):
    held, n = [], 0
    for t in texts:
        held.append(t or b"")
        n += len(held[-1]) + ORDER
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, c) of the texts of a table with a binary column text."""

    def run(batches):
        import pyarrow as pa

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for held in chunks(batch.column(0).to_pylist()):
                k, c = np.unique(grams_of(held)[0], return_counts=True)
                both = np.concatenate([keys, k])
                order = np.argsort(both, kind="stable")
                both, n = both[order], np.concatenate([counts, c])[order]
                at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, int)
                keys, counts = both[at], np.add.reduceat(n, at) if len(at) else n
                if len(keys) > 4 * SHARD_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "c"])
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(counts[at : at + (1 << 17)])], ["gram", "c"])

    return texts.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams counted 1, 2, 3 and 4 times; usual ones where those are too few."""
    if min(n[:3]) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3))


def train(texts: DataFrame) -> DataFrame:
    """(key, v): log probabilities by (order, gram), log back-off weights by (order + 8, context)."""
    counts = common.materialise(count_grams(texts), "grams")
    tables, below = [], None
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = by_order[k + 1].groupBy((F.col("gram").bitwiseAND(F.lit(low(k)))).alias("gram")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("raw"))
        begins = F.shiftright("gram", BITS * (k - 1)) == START
        by_order[k] = common.materialise(shorter.select("gram", F.when(begins, F.col("raw")).otherwise(F.col("kinds")).alias("c")), "grams")
    for k in range(1, ORDER + 1):
        rows = by_order[k]
        n = rows.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
        d = discounts([x or 0 for x in n])
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", BITS).alias("context")
        contexts = rows.select(context, "c", less.alias("less")).groupBy("context").agg(F.sum("c").alias("total"), F.sum("less").alias("spared"))
        contexts = common.materialise(contexts.select("context", "total", (F.col("spared") / F.col("total")).alias("gamma")), "contexts")
        p = rows.select("gram", context, (F.col("c") - less).alias("rest")).join(contexts, "context")
        lower = F.lit(1.0 / SYMBOLS)
        if below is not None:
            p = p.withColumn("short", F.col("gram").bitwiseAND(F.lit(low(k - 1)))).join(below.select(F.col("gram").alias("short"), F.col("p").alias("lower")), "short")
            lower = F.col("lower")
        below = common.materialise(p.select("gram", (F.col("rest") / F.col("total") + F.col("gamma") * lower).alias("p")), "law")
        tables.append(below.select((F.col("gram") + F.lit(k << TAG)).alias("key"), F.log("p").alias("v")))
        tables.append(contexts.select((F.col("context") + F.lit((k + 8) << TAG)).alias("key"), F.log("gamma").alias("v")))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def write_model(model: DataFrame, out: str) -> list[tuple[int, int, str]]:
    """The model in sorted shards under the shared folder out; [(smallest key, largest key, file)] in order, a row for each shard."""
    model = common.materialise(model, "model")
    n = max(1, math.ceil(model.count() / SHARD_ROWS))

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().astype("<f4")) for b in batches if b.num_rows]
        if parts:
            keys, values = (np.concatenate(x) for x in zip(*parts))
            name = f"{out}/shard-{TaskContext.get().partitionId():06d}.kn"
            common.put_file(name, lambda f: f.write(len(keys).to_bytes(8, "little") + keys.astype("<i8").tobytes() + values.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])]), pa.array([int(keys[-1])]), pa.array([name])], ["lo", "hi", "file"])

    found = model.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "lo long, hi long, file string").collect()
    return sorted(tuple(r) for r in found)


class Shards:
    """The shards of a model; the last few read stay in memory."""

    def __init__(self, index: list[tuple[int, int, str]], most: int = 12):
        self.index, self.most, self.held = index, most, {}

    def load(self, file: str) -> tuple[np.ndarray, np.ndarray]:
        if file not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            where, path = common.store(file)
            with where.open_input_stream(path, compression=None) as f:
                raw = f.read()
            n = int.from_bytes(raw[:8], "little")
            self.held[file] = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<f4", n, 8 + 8 * n)
        return self.held[file]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of sorted keys, NaN for those that aren't there."""
        out = np.full(len(keys), np.nan)
        for lo, hi, file in self.index:
            a, b = np.searchsorted(keys, [lo, hi + 1])
            if a < b:
                k, v = self.load(file)
                at = np.minimum(np.searchsorted(k, keys[a:b]), len(k) - 1)
                out[a:b] = np.where(k[at] == keys[a:b], v[at], np.nan)
        return out

    def log_p(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probabilities of sorted distinct grams of k symbols: their own, or the context's weight and the shorter gram's."""
        out = self.find(grams + (k << TAG))
        miss = np.flatnonzero(np.isnan(out))
        if len(miss):
            contexts, back = np.unique(grams[miss] >> BITS, return_inverse=True)
            weight = np.nan_to_num(self.find(contexts + ((k + 8) << TAG)), nan=0.0)[back]
            if k == 1:
                out[miss] = weight - math.log(SYMBOLS)
            else:
                short, back = np.unique(grams[miss] & low(k - 1), return_inverse=True)
                out[miss] = weight + self.log_p(short, k - 1)[back]
        return out


def perplexities(texts: list[bytes], model: Shards) -> list[float]:
    out = []
    for held in chunks(texts):
        grams, begins = grams_of(held)
        distinct, back = np.unique(grams, return_inverse=True)
        total = np.add.reduceat(model.log_p(distinct)[back], begins)
        out += np.exp(-total / np.array([len(t) + 1 for t in held])).tolist()
    return out


def left_out(doc_id: Column) -> Column:
    """Whether a trusted document is for the thresholds, not for the model."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit("fold")), F.lit(FOLDS)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted_id, aside): the ids labelled as good."""
    ids = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("trusted_id")).filter("trusted_id is not null").distinct()
    return common.materialise(ids.select("trusted_id", left_out(F.col("trusted_id")).alias("aside")), "trusted")


def of_trusted(docs: DataFrame, trusted: DataFrame, aside: bool) -> DataFrame:
    """The rows of docs whose ids are trusted and left out, or trusted and not."""
    chosen = trusted.filter(F.col("aside") == aside)
    chosen = F.broadcast(chosen) if chosen.count() <= SENT_IDS else chosen.hint("merge")
    return docs.join(chosen, F.col("doc_id").cast("long") == F.col("trusted_id"), "left_semi")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept of each row of docs(doc_id, lang, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", F.encode(common.text_or_empty(), "UTF-8").alias("text"))
    trusted = trusted_ids(labels)
    index = write_model(train(of_trusted(rows.select("doc_id", "text"), trusted, aside=False)), common.scratch(spark, "kn"))

    def run(batches):
        import pyarrow as pa

        model = common.worker_cache("shards", index[0][2] if index else "", lambda: Shards(index))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(perplexities(texts, model), pa.float64())], ["doc_id", "lang", "n_bytes", "perplexity"])

    kind = dict(docs.dtypes)
    scored = rows.mapInArrow(run, f"doc_id {kind['doc_id']}, lang {kind['lang']}, n_bytes long, perplexity double")
    scored = common.materialise(scored.withColumn("perplexity", F.round("perplexity", 6)), "scored")
    limits = of_trusted(scored.filter("n_bytes > 0"), trusted, aside=True).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"))
    limits = limits.withColumnRenamed("lang", "limit_lang")  # a row for each language
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("limit_lang")), "left").drop("limit_lang")
    return out.withColumn("kept", F.col("threshold").isNull() | (F.col("n_bytes") == 0) | (F.col("perplexity") <= F.col("threshold")))
