"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF vectors over all terms, weighted votes.

Features are words (letters only, lower case) and their beginnings of 5 to 7 letters, so that inflected forms meet.
Every feature in at least ``MIN_DF`` of the labelled rows is kept; none is left out for being rare or for telling little.
Each weighs by TF-IDF times 1 + |log ratio of its rates in both labels| * sqrt(chi-square), so a rare word that stands
in rows of one label only outweighs common words that only go with the length of a text. Labelled texts become vectors
of unit length with one constant place, so texts without any feature are nearest to labelled texts without any. Equal
vectors are one example with its counts of labels.

The examples stand in a block-max inverted index: alike ones together in blocks of at most ``BLOCK``, each block with
its own postings and each feature's largest weight in it. A query visits the ``FIRST`` blocks by the largest cosine they
could hold (the sum over its features of weight times block maximum), then those that could hold one over the k-th found.
Within a visited block features of at least 1/``COMMON`` of all examples are products with a matrix, all others come
from postings. Cosines are exact, in double precision; ties at the k-th are all taken. Texts are asked ``CHUNK`` at a
time, block by block. Votes count by a power of the cosine and by how many labelled rows each
kept one stands for. The arrays of the index lie in a file as they do in memory, and scoring processes map them instead
of holding a copy each. The share of toxic votes is mapped to a probability by isotonic regression on the labelled rows,
each left out of its own vote. Evidence: the nearest examples' doc_ids and cosines.

The labelled sample is bounded: at most ``PER_LABEL`` rows of each label, those with the smallest hash of doc_id;
everything else reads whole texts of all rows. doc_id, lang, source and labels are no inputs of a score.

Defined results. A null or empty text has no feature and gets the score of labelled texts without any. Labels other
than 0 and 1, or null, or without a document are left out; a doc_id that is labelled both ways counts as both. Without
any labelled row every score is 0. Repeated rows are scored alike. A column of docs that is called like the result is an
error, any other stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import re
import struct
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistra.llm import common

PER_LABEL = 4000
MIN_DF = 3
K = 15
BLOCK = 256
COMMON = 16
FIRST = 2
#: Texts that are asked together, block by block.
CHUNK = 256
#: Bytes at whose multiples the arrays of a written model begin.
ALIGN = 64
#: Postings that are summed at once, so that what they need stays in cache.
SLICE = 1 << 15
POWER = 4
STARTS = (5, 6, 7)


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels may not be learnt from: crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STARTS if len(word) > n)]


class Letters(dict):
    """For str.translate: letters stay, anything else becomes a space."""

    def __missing__(self, code: int) -> int:
        out = self[code] = code if re.match(r"[^\W\d_]", chr(code)) else 32
        return out


LETTERS = Letters()


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(LETTERS).split()


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, toxic, share, text) of the bounded sample; share: the part of the label's rows that it holds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    chosen = [rows.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).withColumn("share", F.lit(min(1.0, per_label / n))) for t, n in sorted(counts.items())]
    if not chosen:
        return docs.limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("toxic"), F.lit(1.0).alias("share"), F.lit("").alias("text"))
    sample = chosen[0]
    for more in chosen[1:]:
        sample = sample.union(more)
    return F.broadcast(sample).join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")  # at most PER_LABEL rows a label


def select_features(sample: DataFrame, min_df: int = MIN_DF) -> list[tuple[str, int, float]]:
    """[(feature, rows that have it, weight by label)] of every feature in at least min_df rows, by name."""

    def run(batches):
        import pyarrow as pa

        common.forget()
        df = (Counter(), Counter())
        seen = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic] += 1
                df[toxic].update({f for w in set(words_of(text)) for f in features_of(w)})
        names = list(df[0].keys() | df[1].keys())
        columns = [names, [df[0][x] for x in names], [df[1][x] for x in names]]
        yield pa.RecordBatch.from_arrays([pa.array(["", *columns[0]], pa.string()), pa.array([seen[0], *columns[1]], pa.int64()), pa.array([seen[1], *columns[2]], pa.int64())], ["f", "n0", "n1"])

    counted = sample.select("toxic", "text").mapInArrow(run, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b"))
    found = counted.filter((F.col("f") == "") | (F.col("a") + F.col("b") >= min_df)).orderBy("f").toPandas()  # at most the words of PER_LABEL rows a label
    total, found = found[found["f"] == ""], found[found["f"] != ""]
    if not len(total) or not total["a"].iloc[0] or not total["b"].iloc[0]:
        return []
    a, b, n0, n1 = found["a"].to_numpy(), found["b"].to_numpy(), total["a"].iloc[0], total["b"].iloc[0]
    margins = (a + b) * (n0 + n1 - a - b) * n0 * n1
    chi = np.where(margins > 0, (n0 + n1) * (a * (n1 - b) - b * (n0 - a)) ** 2 / np.maximum(margins, 1), 0.0)
    ratio = np.abs(np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1)))
    return list(zip(found["f"].tolist(), (a + b).astype(int).tolist(), (1 + ratio * np.sqrt(chi)).tolist()))


class WordPlaces(dict):
    """The places of a word's features as bytes of 32-bit integers, none where it has none; worked out once.

    A row with a word has its beginnings too, so where one is in too few rows neither longer ones nor the word are features."""

    def __init__(self, places: dict[str, int], most: int = 200_000):
        super().__init__()
        self.places, self.most = places, most

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        get, length, found = self.places.get, len(word), b""
        for n in STARTS:
            at = get(word[:n] + "-") if length > n else get(word)
            if at is None:
                break
            found += PLACE(at)
            if length <= n:
                break
        else:
            at = get(word)
            found += PLACE(at) if at is not None else b""
        self[word] = found
        return found


PLACE = struct.Struct("i").pack


class Vectors:
    """Vectors of unit length over the features and a constant place."""

    def __init__(self, features: list[tuple[str, int, float]], rows: int):
        self.places = WordPlaces({f: i for i, (f, _, _) in enumerate(features)})
        df, label = np.array([x[1] for x in features], np.float64), np.array([x[2] for x in features], np.float64)
        self.idf = np.append((np.log((rows + 1) / (df + 1)) + 1) * label, 0.5)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, times) of a text's features, places ascending."""
        at = np.sort(np.frombuffer(b"".join(map(self.places.__getitem__, words_of(text))), np.int32))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return at[first], np.diff(first, append=len(at))

    def of(self, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights), places ascending."""
        at = np.append(at, np.int32(len(self.idf) - 1))
        weight = np.append(1 + np.log(times), 1.0) * self.idf[at]
        return at, weight / np.sqrt(weight @ weight)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.of(*self.counts(text))


def alike(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of a matrix in groups of at most most, by halving along each group's main direction."""
    out, open_groups = [], [np.arange(len(rows))]
    while open_groups:
        group = open_groups.pop()
        if len(group) <= most:
            out.append(group)
            continue
        x = rows[group] - rows[group].mean(0)
        way = x[np.argmax((x * x).sum(1))].copy()
        for _ in range(8):
            way = x.T @ (x @ way)
            way /= max(np.linalg.norm(way), 1e-30)
        along = x @ way
        left = along > 0
        if not 0.1 <= left.mean() <= 0.9:
            left = np.zeros(len(group), bool)
            left[np.argsort(along, kind="stable")[: len(group) // 2]] = True
        open_groups += [group[left], group[~left]]
    return out


class BlockIndex:
    """Sparse rows as a block-max inverted index."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int, most: int = BLOCK):
        df = np.zeros(width, np.int64)
        for at, _ in rows:
            df[np.asarray(at)] += 1
        often = np.flatnonzero(df * COMMON >= max(1, len(rows)))
        self.place = np.full(width, -1, np.int32)
        self.place[often] = np.arange(len(often))
        wide = np.zeros((len(rows), len(often)), np.float32)
        for row, (at, weight) in zip(wide, rows):
            place = self.place[np.asarray(at)]
            row[place[place >= 0]] = np.asarray(weight)[place >= 0]
        groups = alike(wide, most) if rows else []
        #: Rows in the order of their blocks, where each block's begin, and each block's matrix of common features.
        self.names = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        self.edges = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int64)
        self.wide = [np.ascontiguousarray(wide[g].T) for g in groups]
        #: Largest weights by feature and block; postings by block and feature (place of the row, weight), and where those of each begin.
        self.most = np.zeros((width, len(groups)), np.float32)
        self.begin = np.zeros((len(groups), width + 1), np.int32)
        postings, held = [np.zeros(0, np.int64)], 0
        for b, group in enumerate(groups):  # one at a time, so that only its postings are held in several forms
            columns = np.concatenate([rows[i][0] for i in group]).astype(np.int32)
            values = np.concatenate([rows[i][1] for i in group]).astype(np.float32)
            place = np.repeat(np.arange(len(group)), [len(rows[i][0]) for i in group]) + self.edges[b]
            np.maximum.at(self.most[:, b], columns, values)
            rest = np.flatnonzero(self.place[columns] < 0)
            rest = rest[np.argsort(columns[rest], kind="stable")]
            self.begin[b] = held + np.searchsorted(columns[rest], np.arange(width + 1, dtype=np.int32))
            postings.append(place[rest] << 32 | values[rest].view(np.uint32))
            held += len(rest)
        self.postings = np.concatenate(postings)

    def bounds(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The largest product that a row of each block could have with a query."""
        return weight.astype(np.float32) @ self.most[at]

    def near(self, block: int, queries: list["Query"]) -> np.ndarray:
        """Products of a block's rows (columns) with some queries (rows), in double precision; one block's postings stay in cache."""
        lo, hi = int(self.edges[block]), int(self.edges[block + 1])
        rows, begin = hi - lo, self.begin[block]
        at, weight = np.concatenate([q.rare_at for q in queries]), np.concatenate([q.rare for q in queries])
        first = begin[at]
        n = begin[at + 1] - first
        here = np.flatnonzero(n)
        of = np.repeat(np.arange(len(queries)), [len(q.rare_at) for q in queries])[here]
        first, n, weight = first[here], n[here], weight[here]
        ends = np.cumsum(n, dtype=np.int64)
        # the query's base above, what leads from a posting's number to its place in the index below
        lead = (of * rows - lo << 32) + (first - ends + n)
        runs = np.searchsorted(of, np.arange(len(queries) + 1))
        before = np.concatenate([[0], ends])[runs]
        out = np.stack([q.often for q in queries]) @ self.wide[block].astype(np.float64)
        flat, i = out.reshape(-1), 0
        while i < len(queries):
            j = max(i + 1, int(np.searchsorted(before, before[i] + SLICE, "right")) - 1)
            own = n[runs[i] : runs[j]]
            to = np.repeat(lead[runs[i] : runs[j]], own)
            to += np.arange(before[i], before[j])
            held = self.postings.take(to & 0xFFFFFFFF)
            value = np.repeat(weight[runs[i] : runs[j]], own)
            value *= held.astype(np.uint32).view(np.float32)
            to += held  # weights are positive, so the lower halves never carry
            to >>= 32
            to -= i * rows
            flat[i * rows : j * rows] += np.bincount(to, value, (j - i) * rows)
            i = j
        return out


class Query:
    """A vector that is asked for, and the best that was found so far."""

    def __init__(self, index: BlockIndex, at: np.ndarray, weight: np.ndarray, leave: int | None = None):
        self.at, self.weight, self.leave = np.asarray(at, np.int64), np.asarray(weight, np.float64), leave
        place = index.place[self.at]
        self.often = np.zeros(index.wide[0].shape[0])
        self.often[place[place >= 0]] = self.weight[place >= 0]
        self.rare_at, self.rare = self.at[place < 0], self.weight[place < 0]
        self.bounds = index.bounds(self.at, self.weight)
        self.names, self.cosines, self.least = [], [], -1.0


class Examples:
    """The labelled vectors, equal ones as one."""

    def __init__(self, rows: list[tuple[int, int, float, np.ndarray, np.ndarray]], width: int):
        groups: dict = {}
        for doc_id, toxic, share, at, weight in rows:
            at, weight = np.asarray(at, np.int32), np.asarray(weight, np.float64)
            g = groups.setdefault(self.key(at, weight), [at, weight.astype(np.float32), 0.0, 0.0, 0, doc_id])
            g[2 + toxic] += 1 / share
            g[4] += 1
            g[5] = min(g[5], doc_id)
        found = sorted(groups.items(), key=lambda g: g[0])
        self.index = BlockIndex([(g[0], g[1]) for _, g in found], width)
        self.votes = np.array([[g[2], g[3]] for _, g in found]).reshape(-1, 2)
        self.rows, self.ids = np.array([g[4] for _, g in found]), np.array([g[5] for _, g in found])
        self.known = {key: row for row, (key, _) in enumerate(found)}

    @staticmethod
    def key(at: np.ndarray, weight: np.ndarray) -> bytes:
        return hashlib.blake2b(at.tobytes() + weight.tobytes(), digest_size=16).digest()

    def kth(self, names: np.ndarray, cosines: np.ndarray, k: int, leave: int | None) -> float:
        """The cosine of the k-th nearest labelled row; -1 where there are fewer."""
        order = np.argsort(-cosines, kind="stable")
        held = self.rows[names] - (names == leave if leave is not None else 0)
        full = np.flatnonzero(np.cumsum(held[order]) >= k)
        return float(cosines[order[full[0]]]) if len(full) else -1.0

    def nearest(self, queries: list[Query], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query: (examples, cosines) of the k nearest labelled rows and all that tie with the last, nearest first."""
        index = self.index
        orders = [np.argsort(-q.bounds, kind="stable") for q in queries]
        for lot in (0, 1):  # the second lot holds only blocks that may yet have one of the k nearest
            asked: dict[int, list[Query]] = {}
            for q, order in zip(queries, orders):
                visit = order[:FIRST] if lot == 0 else order[FIRST:]
                for b in visit[q.bounds[visit] >= q.least - 2e-5].tolist():
                    asked.setdefault(b, []).append(q)
            for b, own in asked.items():
                names = index.names[index.edges[b] : index.edges[b + 1]]
                for q, near in zip(own, index.near(b, own)):
                    keep = near >= q.least - 2e-5
                    q.names.append(names[keep])
                    q.cosines.append(near[keep])
            for q in queries:
                names, cosines = np.concatenate(q.names), np.concatenate(q.cosines)
                most = min(k + 1, len(cosines))  # each example but the one left out holds a row at least
                keep = cosines >= np.partition(cosines, -most)[-most] - 2e-5
                q.names, q.cosines = [names[keep]], [cosines[keep]]
                q.least = self.kth(names[keep], cosines[keep], k, q.leave)
        out = []
        for q in queries:
            names, cosines = q.names[0], np.round(q.cosines[0], 9)  # the same in whatever company it was worked out
            keep = cosines >= self.kth(names, cosines, k, q.leave) - 1e-6
            names, cosines = names[keep], cosines[keep]
            order = np.lexsort((self.ids[names], -np.round(cosines, 6)))
            out.append((names[order], cosines[order]))
        return out

    def votes_of(self, vectors: list[tuple], k: int, leave: list[tuple[int, int, float]] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each vector: (share of toxic votes, examples, cosines); leave: for each an example, label and weight that don't vote."""
        queries = [Query(self.index, at, weight, leave[i][0] if leave else None) for i, (at, weight) in enumerate(vectors)]
        out = []
        for i, (names, cosines) in enumerate(self.nearest(queries, k)):
            votes = self.votes[names].copy()
            if leave:
                votes[names == leave[i][0], leave[i][1]] -= leave[i][2]
            votes *= (np.maximum(cosines, 0) ** POWER)[:, None]
            total = votes.sum()
            out.append(((float(votes[:, 1].sum() / total) if total > 1e-12 else 0.0), names, cosines))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling neighbours that fall."""
    values, back = np.unique(x, return_inverse=True)
    w = np.bincount(back, weight)
    pools: list[list[float]] = []
    for v, m, n in zip(values, np.bincount(back, weight * y) / w, w):
        pools.append([v, v, m, n])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    # a pool's mean is drawn towards one half as one row would draw it, so no score is certain
    means = [(p[2] * p[3] + 0.5) / (p[3] + 1) for p in pools]
    return np.array([z for p in pools for z in p[:2]]), np.repeat(means, 2)


class Model:
    def __init__(self, features: list[tuple[str, int, float]], rows: list[tuple]):
        """rows: (doc_id, toxic, share, places, times), places and times as bytes of 32-bit integers."""
        self.vectors = Vectors(features, len(rows))
        vector = lambda row: self.vectors.of(np.frombuffer(row[3], np.int32), np.frombuffer(row[4], np.int32))  # noqa: E731 - again each time, so that memory holds them once
        self.examples = Examples(((*row[:3], *vector(row)) for row in rows), len(features) + 1) if rows else None
        self.memo: dict = {}
        if rows:
            shares: dict = {}
            own_of = []
            for at in range(0, len(rows), CHUNK):
                new: dict = {}
                for row in rows[at : at + CHUNK]:
                    v = vector(row)
                    own_of.append((self.examples.known[self.examples.key(*v)], row[1]))
                    if own_of[-1] not in shares:
                        new[own_of[-1]] = v, (*own_of[-1], 1 / row[2])
                found = self.examples.votes_of([v for v, _ in new.values()], K, [x for _, x in new.values()]) if new else []
                shares.update(zip(new, (x[0] for x in found)))
            raw = np.array([shares[x] for x in own_of])
            self.knots = isotonic(raw, np.array([x[1] for x in rows], float), np.array([1 / x[2] for x in rows]))
            self.examples.known.clear()

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """(score, evidence doc_ids, their cosines) of each text."""
        if self.examples is None:
            return [(0.0, [], [])] * len(texts)
        out = []
        for at in range(0, len(texts), CHUNK):
            keys, new = [], {}
            for text in texts[at : at + CHUNK]:
                places, times = self.vectors.counts(text)
                keys.append(self.examples.key(places, times))
                if keys[-1] not in self.memo:
                    new.setdefault(keys[-1], (places, times))
            if len(self.memo) > 20_000:
                self.memo = {k: self.memo[k] for k in keys if k in self.memo}
            found = self.examples.votes_of([self.vectors.of(*x) for x in new.values()], K) if new else []
            for key, (share, names, cosines) in zip(new, found):
                self.memo[key] = (float(np.interp(share, *self.knots)), self.examples.ids[names[:5]].tolist(), [round(float(c), 6) for c in cosines[:5]])
            out += [self.memo[k] for k in keys]
        return out


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> str:
    """Fit the model in one task, whose input the sample's bound limits, and return the shared file that holds it."""
    spark = docs.sparkSession
    sample = common.materialise(labelled_sample(docs, labels, per_label), "labelled")
    sent = spark.sparkContext.broadcast(select_features(sample))  # the features of the sample
    out = common.scratch(spark, "toxicity") + "/model"

    def run(batches):
        import pyarrow as pa

        common.forget()
        counts, rows = Vectors(sent.value, 1).counts, []
        for batch in batches:
            for doc_id, toxic, share, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows.append((doc_id, toxic, share, *(x.astype(np.int32).tobytes() for x in counts(text))))
        del counts  # with the words that it has kept
        save(Model(sent.value, sorted(rows)), out)
        common.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    if not sample.select("doc_id", "toxic", "share", "text").repartition(1).mapInArrow(run, "n long").collect():
        save(Model([], []), out)
    sent.destroy()
    common.remove(spark, sample.scratch_path)
    return out


def save(model: Model, uri: str) -> None:
    """Write the model's arrays as they are in memory to uri.arrays, and the rest, with where each of them lies, to uri."""
    arrays: list[pickle.PickleBuffer] = []
    rest = pickle.dumps(model, 5, buffer_callback=arrays.append)
    sizes = [x.raw().nbytes for x in arrays]
    starts = np.cumsum([0, *(-(-n // ALIGN) * ALIGN for n in sizes)]).tolist()

    def write(f):
        for x, n, start, end in zip(arrays, sizes, starts, starts[1:]):
            f.write(x.raw())
            f.write(bytes(end - start - n))

    common.put_file(uri + ".arrays", write)
    common.put_file(uri, lambda f: pickle.dump((rest, list(zip(starts, sizes))), f, 5))


def load(uri: str) -> Model:
    """The model; of a mounted store its arrays are mapped, so an executor's workers, however many, share one copy that the system may drop."""
    import pyarrow as pa
    from pyarrow import fs

    where, path = common.store(uri)
    with where.open_input_file(path) as f:
        rest, places = pickle.load(io.BufferedReader(f, 1 << 20))
    with pa.memory_map(path + ".arrays") if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path + ".arrays") as f:
        held = memoryview(f.read_buffer())
    return pickle.loads(rest, buffers=[held[start : start + n] for start, n in places])


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, column: str = "toxicity") -> DataFrame:
    """docs with a column struct(score double, evidence array<long>, cosines array<double>). docs' other columns stay."""
    if column in docs.columns:
        raise ValueError(f"docs has a column {column} already")
    model = fit(docs, labels, per_label)

    @F.arrow_udf("struct<score: double, evidence: array<bigint>, cosines: array<double>>")
    def judge(texts):
        import pyarrow as pa

        held, found = common.worker_cache("toxicity", model, lambda: load(model)), []
        for at in range(0, len(texts), CHUNK):  # only so many texts are Python's at once
            found += held.scores(texts.slice(at, CHUNK).to_pylist())
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())))]
        return pa.StructArray.from_arrays(columns, ["score", "evidence", "cosines"])

    return docs.withColumn(column, judge(F.col("text").cast("string")))
