"""How far the vocabularies of sources of a language lie apart: chi-square divergence of every source from every other.

Tasks count terms of their texts by (lang, source) and the counts meet by term. Terms in at least ``LEAST_DOCS`` documents
of a language are kept, dealt by hash in shards of about ``SHARD_TERMS`` and numbered in their order within a shard. A
group's counts in a shard are one vector: term numbers as differences, counts, compressed.

The vectors meet as in a round-robin tournament. Groups of a language form blocks; a block of a shard is resident in
one task, which holds it in full, while the compressed vectors of its peers come by one after another in the order of
the circle method's rounds (``meeting``): in a round every block meets one other, and over all rounds each pair of blocks
meets once, at one of the two. Both directions are worked out at a meeting. A vector is only walked where it isn't zero: all
terms that a group lacks have the same p. Sums over shards are added up afterwards. The language's own vector comes by
first, and each resident keeps a bounded list of its best terms against it in that shard.

All arithmetic is in whole numbers of 64 bits: 10^9 (c + 1) is divided in two steps (`share`), exact up to 2 * 10^14
terms a group; a squared difference of two shares is at most 10^18, and a sum over terms under 4 * 10^18.

Defined results. Null text, lang and source count as ''. Every row is a document of its own, repeated doc_ids and rows
included; doc_id isn't read. A language without kept terms gives value 0 for all its pairs and no terms; a language with
one source gives no pairs. Ties are ranked by item in UTF-8 order. Other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varistra.llm import common

LEAST_DOCS, TOP_TERMS = 3, 200
SCALE_A, SCALE_B = 31250, 32000  # their product is 10^9
SHARD_TERMS = 1 << 16
MOST_BLOCK = 64
#: Distinct (group, term) that a task holds before it passes its counts on.
HELD_TERMS = 400_000
TERM = rb"[A-Za-z\x80-\xff]+"  # of UTF-8 bytes: the same runs as [^\x00-\x40\x5B-\x60\x7B-\x7F]+ of code points


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_docs): partial counts of each task; a row with a null term for each group."""

    def run(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        find = re.compile(TERM).findall
        counts, in_docs, held = {}, {}, 0

        def flush():
            for (lang, source), c in counts.items():
                d = in_docs[lang, source]
                terms = list(c)
                for at in range(0, len(terms), 100_000):
                    some = terms[at : at + 100_000]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())], names)
            groups = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.nulls(len(groups), pa.string()), pa.array([0] * len(groups), pa.int64()), pa.array([0] * len(groups), pa.int64())], names)

        names = ["lang", "source", "term", "n", "in_docs"]
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = find(text.as_py().lower())  # bytes.lower knows A-Z alone
                c = counts.setdefault((lang, source), Counter())
                d = in_docs.setdefault((lang, source), Counter())
                held -= len(c)
                c.update(words)
                d.update(set(words))
                held += len(c)
                if held >= HELD_TERMS:
                    yield from flush()
                    counts, in_docs, held = {}, {}, 0
        if counts:
            yield from flush()

    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty), F.coalesce("source", empty), common.text_or_empty().cast("binary"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, in_docs long")


def packed(vectors: DataFrame) -> DataFrame:
    """vectors with v(id, n), sorted by id, as compressed bytes ``pack``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            ends, values = v.offsets.to_numpy(), v.values  # offsets count from the whole child
            ids, n = values.field("id").to_numpy(), values.field("n").to_numpy()
            out = [pack(ids[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "pack"])

    rest = [c for c in vectors.columns if c != "v"]
    kinds = dict(vectors.dtypes)
    return vectors.select(*rest, "v").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", pack binary")


def pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Rising ids as 32-bit differences and counts of 64 bits, by byte places, compressed."""
    import zstandard

    planes = np.diff(ids, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(ids).to_bytes(4, "little") + zstandard.compress(planes, 3)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    k = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(zstandard.decompress(data[4:]), np.uint8)
    gaps = np.ascontiguousarray(raw[: 4 * k].reshape(4, k).T).view("<u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.int64), np.ascontiguousarray(raw[4 * k :].reshape(8, k).T).view("<i8").reshape(-1)


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / total): long division with 10^9 in two factors, so that nothing passes 64 bits."""
    whole, rest = np.divmod(n.astype(np.int64) + 1, total)
    a, rest = np.divmod(rest * SCALE_B, total)
    return 1 + (whole * SCALE_B + a) * SCALE_A + rest * SCALE_A // total


def apart(p, q):
    """floor((p - q)^2 / q)."""
    d = p - q
    return d * d // q


def meeting(i: Column, j: Column, blocks: Column) -> tuple[Column, Column]:
    """(round, host) of the meeting of blocks i < j: the circle method over an even number of places, and the block that stays."""
    last = blocks + F.pmod(blocks, F.lit(2)) - 1
    return F.pmod(F.when(j == last, 2 * i).otherwise(i + j), last), F.when(F.pmod(i + j, F.lit(2)) == 1, i).otherwise(j)


class Resident:
    """A group's shares over all terms of a shard."""

    def __init__(self, source: str, data: bytes, terms: int, zero: int, total: int):
        self.source, (self.ids, n), self.zero, self.terms = source, unpack(data), zero, terms
        self.p = np.full(terms, zero, np.int64)
        self.p[self.ids] = share(n, total) if len(n) else n
        self.some = self.p[self.ids]

    def best(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and values of the TOP_TERMS best of this shard against the language's shares."""
        over = self.some > q[self.ids]
        ids, value = self.ids[over], apart(self.some[over], q[self.ids[over]])
        order = np.lexsort((ids, -value))[:TOP_TERMS]
        return ids[order], value[order]

    def meet(self, ids: np.ndarray, p: np.ndarray, zero: int) -> tuple[int, int]:
        """(this from the peer, the peer from this): a peer of constant share ``zero``, corrected where it has terms of its own."""
        none, at = self.terms - len(self.ids), self.p[ids]
        mine = apart(self.some, zero).sum() + none * apart(self.zero, zero) + (apart(at, p) - apart(at, zero)).sum()
        theirs = apart(zero, self.some).sum() + none * apart(zero, self.zero) + (apart(p, at) - apart(zero, at)).sum()
        return int(mine), int(theirs)


def tournament(rows: DataFrame) -> DataFrame:
    """(lang, source, item, shard, id, value): pairs (id null) and terms (item null) of each shard.

    rows: lang, shard, host, round (-2 the language, -1 residents, else visitors), source, terms, total, pack."""

    def run(batches):
        import pyarrow as pa

        now, language, residents, out = None, None, [], []

        def flush():
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "source", "item", "shard", "id", "value"])
            out.clear()
            return batch

        for batch in batches:
            for lang, shard, host, turn, source, terms, total, data in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if (lang, shard, host) != now:
                    now, language, residents = (lang, shard, host), None, []
                zero = int(share(np.zeros(1, np.int64), total)[0]) if total else 1
                if turn == -2:
                    ids, n = unpack(data)
                    language = share(n, total)  # every kept term occurs in its language
                    continue
                if turn == -1:
                    own = Resident(source, data, terms, zero, total)
                    if terms:
                        out += [(lang, source, None, shard, int(i), int(v)) for i, v in zip(*own.best(language))]
                    ids, p = own.ids, own.some
                else:
                    ids, n = unpack(data)
                    p = share(n, total) if len(n) else n
                for r in residents:
                    mine, theirs = r.meet(ids, p, zero) if terms else (0, 0)
                    out += [(lang, r.source, source, shard, None, mine), (lang, source, r.source, shard, None, theirs)]
                if turn == -1:
                    residents.append(own)
                if len(out) >= 20_000:
                    yield flush()
        yield flush()

    dealt = rows.repartition("lang", "shard", "host").sortWithinPartitions("lang", "shard", "host", "round", "source")
    return dealt.mapInArrow(run, "lang string, source string, item string, shard long, id long, value long")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source)."""
    cells = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))
    cells = common.materialise(cells, "cells")
    groups = cells.filter("term is null").select("lang", "source")
    kept = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("in_docs").alias("d")).filter(F.col("d") >= LEAST_DOCS).drop("d")
    kept = common.materialise(kept, "kept")
    shards = max(1, -(-kept.count() // SHARD_TERMS))
    number = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")).cast("long") - 1
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards))).withColumn("id", number)
    kept = common.materialise(kept, "terms")

    vector = lambda n: F.array_sort(F.collect_list(F.struct("id", F.col(n).alias("n")))).alias("v")  # noqa: E731  at most a shard's terms
    vectors = cells.join(kept, ["lang", "term"]).groupBy("lang", "shard", "source").agg(F.sum("n").alias("own"), vector("n"))
    vectors = common.materialise(packed(vectors), "vectors")
    spans = kept.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("own"), vector("all_n"))
    spans = common.materialise(packed(spans), "spans")

    langs = spans.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("own").alias("lang_n"))
    sizes = vectors.groupBy("lang", "source").agg(F.sum("own").alias("group_n"))
    by_name = Window.partitionBy("lang")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").withColumn("place", F.row_number().over(by_name.orderBy("source")) - 1).withColumn("n_groups", F.count(F.lit(1)).over(by_name))
    width = F.least(F.lit(MOST_BLOCK), F.ceil(F.sqrt("n_groups")).cast("int"))  # as many blocks as groups in a block
    groups = groups.withColumn("block", F.floor(F.col("place") / width).cast("int")).withColumn("blocks", F.ceil(F.col("n_groups") / width).cast("int"))
    groups = groups.withColumn("total", F.coalesce("group_n", F.lit(0)) + F.coalesce("v", F.lit(0))).withColumn("lang_total", F.col("lang_n") + F.col("v"))
    groups = common.materialise(groups.select("lang", "source", "block", "blocks", "total", "lang_total"), "groups")

    nothing = F.lit(pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    units = groups.join(spans.select("lang", "shard", "terms"), "lang", "left").withColumn("shard", F.coalesce("shard", F.lit(0).cast("long"))).fillna(0, ["terms"])
    units = units.join(vectors.drop("own"), ["lang", "shard", "source"], "left").withColumn("pack", F.coalesce("pack", nothing))
    stay = units.select("lang", "shard", F.col("block").alias("host"), F.lit(-1).alias("round"), "source", "terms", "total", "pack")
    peers = units.filter("blocks > 1").withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("peer <> block")
    turn, host = meeting(F.least("block", "peer"), F.greatest("block", "peer"), F.col("blocks"))
    visit = peers.filter(host == F.col("peer")).select("lang", "shard", F.col("peer").alias("host"), turn.alias("round"), "source", "terms", "total", "pack")
    homes = groups.groupBy("lang", "block").agg(F.first("lang_total").alias("total"))
    first = spans.join(homes, "lang").select("lang", "shard", F.col("block").alias("host"), F.lit(-2).alias("round"), F.lit("").alias("source"), "terms", "total", "pack")
    met = common.materialise(tournament(first.union(stay).union(visit)), "met")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.filter("id is null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = met.filter("id is not null").drop("item").join(kept.select("lang", "shard", "id", F.col("term").alias("item")), ["lang", "shard", "id"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= TOP_TERMS)
    return pairs.union(terms)
