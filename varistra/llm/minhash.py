"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

A text's words (A-Z in lower case) give its set of distinct shingles of ``k`` words; fewer words are one shingle. In a
SuperMinHash signature each shingle takes the places in an order of its own (a permutation drawn step by step) with
ranks that rise from step to step, and each place keeps the smallest rank. Once every place of a document is taken no
later step can change it, so most documents stop after two or three steps. Signatures are cut into ``BANDS`` bands.

Equal sets are one class, represented by its smallest doc_id, so copies never meet as pairs. Classes that agree in a
band are candidates. A bucket's members are first compared with one of them. Where a bucket then still spans several
components, the members outside its largest one are compared with one inside, drawn anew, in ``STARS`` rounds, and
what is left with all others of the bucket: pair by pair in small buckets, in blocks of ``BLOCK_TEXTS`` texts by
``BLOCK_TEXTS`` in large ones. Every pair of a bucket is thus either compared on its full sets or already
connected, and nothing is capped. With ``BANDS`` bands of ``ROWS`` places a pair at the threshold shares no bucket
with a probability of 3 in a million.

Defined results. A null, empty or blank text has an empty set and is linked with nothing. Rows that share a doc_id
are one document for component_id, each with its own n_shingles; a null doc_id is smaller than any other and gives a
null component_id. Ties cannot occur. Other columns are ignored, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.llm import common
from varistra.llm.components import components

BANDS, ROWS = 32, 5
BLOCK, BLOCK_TEXTS = 64, 256
STARS = 1
#: Words whose hashes a worker keeps (about 100 bytes each).
CACHE_WORDS = 200_000
#: Words of the documents that are signed at a time.
BATCH_WORDS = 100_000
NULL_ID = -(1 << 63)
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLD = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def word_hashes() -> WordHashes:
    return common.worker_cache("words", None, WordHashes)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's distinct shingles. bytes.lower and bytes.split know A-Z and ASCII white space alone."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(3) + h[i : i + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash: a row of m places for each set (none of them empty). m is under 256."""
    sizes = np.array([len(s) for s in sets])
    e = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * m, FREE)
    order = rows = None
    for step in range(m):
        z = mix(e + np.uint64((step + 1) * GOLD & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((z & np.uint64(0xFFFFFFFF)) % np.uint64(m - step)).astype(np.int64)
        if step == 0:
            place = pick
        else:
            place = order[rows, pick]
            order[rows, pick] = order[:, step]
        rank = (z >> np.uint64(8)) | np.uint64(step << 56)
        np.minimum.at(out, owner * m + place, rank)
        still = (out.reshape(-1, m) == FREE).any(1)
        if not still.any():
            break
        stay = still[owner]
        if step == 0:
            e, owner, first = e[stay], owner[stay], pick[stay]
            rows = np.arange(len(e))
            order = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
            order[rows, first] = 0
        elif stay.mean() < 0.8:
            e, owner, order = e[stay], owner[stay], order[stay]
            rows = np.arange(len(e))
    return out.reshape(-1, m)


def band_keys(signed: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal places of different bands give different keys."""
    cut = signed.reshape(len(signed), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2])
    for i in range(rows):
        key = mix(key ^ cut[:, :, i])
    return key


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, a, b, bands) of each row of docs(doc_id, text): size and 128-bit hash of its set, and its band keys (none for an empty set)."""

    def run(batches):
        import pyarrow as pa

        def signed(ids, sets):
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[i] for i in some], BANDS * ROWS)) if some else np.zeros((0, BANDS), np.uint64)
            lengths = np.zeros(len(sets) + 1, np.int32)
            lengths[np.array(some, int) + 1] = BANDS
            a = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            b = [int(np.bitwise_xor.reduce(mix(s + np.uint64(GOLD))).view(np.int64)) if len(s) else 0 for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["doc_id", "n", "a", "b", "bands"])

        ids, sets, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py(), k)
                ids.append(doc_id)
                sets.append(s)
                held += len(s)
                if held >= BATCH_WORDS or len(ids) >= 2000:
                    yield signed(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield signed(ids, sets)
        common.give_back()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n long, a long, b long, bands array<long>")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose full sets are linked. texts(node, text).

    A text u travels once for up to BLOCK of its partners, each partner's once for each pair."""
    many = common.materialise(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "many")
    dealt = pairs.join(many, "u", "left").select("u", "v", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / BLOCK))).cast("long").alias("part"))
    dealt = common.materialise(dealt, "pairs")
    heads = dealt.select("u", "part").distinct().select(F.col("u").alias("node"), "u", "part", F.lit(None).cast("long").alias("v"))
    wanted = heads.union(dealt.select(F.col("v").alias("node"), "u", "part", "v"))

    def run(batches):
        import pyarrow as pa

        now, sets, found = None, [], []
        for batch in batches:
            for u, part, v, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = shingle_set(text, k)
                if (u, part) != now:
                    now, sets = (u, part), []
                if v is None:
                    sets.append(s)
                elif any(linked(x, s, percent) for x in sets):
                    found.append((u, v))
        common.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

    rows = wanted.join(texts, "node").select("u", "part", "v", "text")
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v")).mapInArrow(run, "u long, v long")


def compare_blocks(few: DataFrame, all_rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between few(key, n, few_n, node, label) and all members all_rows of the same buckets with other labels.

    Both sides are cut in blocks of about BLOCK_TEXTS texts; each pair of blocks of a bucket meets in one task."""
    columns, lines = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int"), F.ceil(F.col("few_n") / BLOCK_TEXTS).cast("int")
    of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    x = few.select("key", "node", "label", F.lit(True).alias("asks"), of(lines).alias("i"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"))
    y = all_rows.select("key", "node", "label", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), lines - 1)).alias("i"), of(columns).alias("j"))

    def run(table):
        import pandas as pd

        sets = [shingle_set(t, k) for t in table["text"]]
        vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        at = [np.searchsorted(vocabulary, s) for s in sets]
        sizes, labels, asks, nodes = np.array([len(s) for s in sets]), table["label"].to_numpy(), table["asks"].to_numpy(bool), table["node"].to_numpy()
        both = np.zeros((int(asks.sum()), int((~asks).sum())), np.float32)
        for begin in range(0, len(vocabulary), 1 << 15):
            part = np.zeros((len(sets), min(1 << 15, len(vocabulary) - begin)), np.float32)
            for row, x in enumerate(at):
                lo, hi = np.searchsorted(x, [begin, begin + part.shape[1]])
                part[row, x[lo:hi] - begin] = 1
            both += part[asks] @ part[~asks].T
        both = both.astype(np.int64)
        near = (100 * both >= percent * (sizes[asks][:, None] + sizes[~asks][None, :] - both)) & (labels[asks][:, None] != labels[~asks][None, :])
        u, v = np.nonzero(near)
        u, v = nodes[asks][u], nodes[~asks][v]
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return x.union(y).join(texts, "node").groupBy("key", "i", "j").applyInPandas(run, "u long, v long")


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links."""
    more = common.materialise(links, "links")
    if more.isEmpty():
        return labels
    return common.materialise(components(more.union(labels.select(F.col("label").alias("u"), F.col("node").alias("v")).filter("u < v"))), "labels")


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, node, label, main, few_n): the members of buckets that span several components; main is the largest one's label."""
    labelled = common.materialise(members.join(labels, "node", "left").select("key", "n", "node", F.coalesce("label", "node").alias("label")), "labelled")
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("top")).filter("labels > 1")
    main = common.materialise(main.select("key", F.col("top.label").alias("main"), F.col("top.c").alias("main_n")), "main")
    return common.materialise(labelled.join(main, "key").withColumn("few_n", F.col("n") - F.col("main_n")).drop("main_n"), "rest")


def star(members: DataFrame, seed: int) -> DataFrame:
    """(u, v): each bucket's member that draws the smallest hash with each of those that ask."""
    center = F.min(F.when(F.col("serves"), F.struct(F.xxhash64(F.lit(seed), "node").alias("draw"), "node")))["node"].alias("center")
    centers = common.materialise(members.groupBy("key").agg(center), "centers")
    both = members.filter("asks").join(centers, "key").filter("node <> center")
    return both.select(F.least("node", "center").alias("u"), F.greatest("node", "center").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each row of docs(doc_id, text)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = common.materialise(sketch(docs, k), "sketches")
    classes = sketches.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    keys = classes.select("node", F.explode("bands").alias("key")).distinct()
    full = common.materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = common.materialise(keys.join(full, "key"), "members")
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
    texts = common.materialise(texts.join(members.select("node").distinct(), "node", "left_semi"), "texts")

    done = common.materialise(star(members.select("key", "node", F.lit(True).alias("asks"), F.lit(True).alias("serves")), 0), "star")
    labels = common.materialise(components(compare(done, texts, k, percent)), "labels")
    for seed in range(1, STARS + 1):
        rest = open_buckets(members, labels)
        if rest.isEmpty():
            break
        members = rest.select("key", "n", "node")
        texts = common.materialise(texts.join(rest.select("node").distinct(), "node", "left_semi"), "texts")
        asked = star(rest.select("key", "node", (F.col("label") != F.col("main")).alias("asks"), (F.col("label") == F.col("main")).alias("serves")), seed)
        asked = common.materialise(asked.join(done, ["u", "v"], "left_anti"), "star")
        labels = grown(labels, compare(asked, texts, k, percent))
        done = done.union(asked)
    rest = open_buckets(members, labels)
    if not rest.isEmpty():
        few = rest.filter("label <> main")
        x = few.filter(F.col("n") <= BLOCK).select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
        y = rest.filter(F.col("n") <= BLOCK).select("key", F.col("node").alias("y"), F.col("label").alias("ly"))
        pairs = x.join(y, "key").filter("lx <> ly").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().join(done, ["u", "v"], "left_anti")
        large = [side.filter(F.col("n") > BLOCK) for side in (few, rest)]
        labels = grown(labels, compare(pairs, texts, k, percent).union(compare_blocks(*large, texts, k, percent)))

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(common.SALTS)).cast("int")
    rows = sketches.filter("n > 0").select("doc_id", "n", "a", "b", salt.alias("salt"))
    tops = rows.groupBy("a", "b", "salt").agg(F.min("doc_id").alias("node")).groupBy("a", "b").agg(F.min("node").alias("node"), F.collect_list("salt").alias("salts"))
    tops = tops.join(labels, "node", "left").select("a", "b", F.coalesce("label", "node").alias("component_id"), F.explode("salts").alias("salt"))
    found = rows.join(tops.hint("merge"), ["a", "b", "salt"]).select("doc_id", "n", "component_id").union(sketches.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return found.select(real("doc_id"), F.col("n").alias("n_shingles"), real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
