"""Benchmark decontamination: BM25 over test items with block-max pruning, then overlap of question and answer.

The test items are indexed, each training passage is a query. Impacts are BM25 weights divided by the item's score
for itself, so a passage that holds a whole item scores 1 for it whatever its length. Passages are windows of twice
the longest item's words, half overlapping, so that each item fits in one whole. Postings are kept in blocks of
``BLOCK`` items with each term's largest impact in the block.

A query goes in three exact steps. (1) Of each item's terms the commonest are set aside as long as together they stay
under the threshold; only a passage with one of the item's other terms can reach it. (2) Of the blocks so found, those
whose largest impacts over the passage's terms sum to less than the threshold are skipped. (3) The others' items are
scored. Every item at or over the threshold is found. An item counts as leaked if enough of its question's five-word
shingles and of its answer's words stand in the passage; the answer is the item's ``answer`` where the table has that
column, else its last sentence, the question the rest.

Counts, document frequencies, the mean length and the passages' width are those of all items. Items fall into shards of
a bounded size, each indexed by one task and written to the shared folder. A task asks one shard after another about the
texts that it holds, with one shard's index in memory at a time: documents are read once and never written, a task's
memory doesn't depend on the benchmark's size, and neither does what is found on how items fall into shards.

Characters of scripts that put no spaces between words are words of their own. Items of fewer than ``MIN_WORDS`` pieces
between white space are found by BM25 like all others; as shares of so few can't be told from chance, the overlap asked
of them is the whole item, question and answer, word by word.

Defined results. A null or empty text or item matches nothing; an item of one word leaks where that word stands. Rows that share a doc_id are answered each. A null item_id is reported as -1. A
column of docs that is called like the result is an error, any other stays. Without items nothing is contaminated;
without documents the result is empty.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
import uuid
from collections import Counter, defaultdict
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.llm import common

BLOCK = 16
MIN_WORDS = 8
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75
SHINGLE = 5
EDGE = b".,;:!?\"'()[]"
#: Characters of scripts that put no spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Texts that a task holds while it asks one shard after another.
HELD_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (of every script) without punctuation, in UTF-8; characters of unspaced scripts are words."""
    text = (text or "").lower()
    return pieces_of(text if text.isascii() else UNSPACED.sub(r" \g<0> ", text))


def pieces_of(text: str) -> list[bytes]:
    return text.lower().encode(errors="surrogatepass").translate(None, EDGE).split()


def split_item(text: str, answer: str | None) -> tuple[str, str]:
    """(question, answer)."""
    if answer is not None:
        return text, answer
    parts = re.findall(r"[^.!?]+[.!?]*\s*", text)
    return ("".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def shingles(words: list[bytes], k: int = SHINGLE) -> set[tuple]:
    k = min(k, len(words))
    return set(zip(*(words[i:] for i in range(k)))) if k else set()


def whole_item(text: str | None, answer: str | None) -> str:
    return (text or "") + ("" if answer is None else " " + answer)


class Index:
    """BM25 impacts of items [(item_id, text, answer)], in blocks, and what the overlap check needs.

    whole: (items, mean length, longest item, rows by word) of all items that have words, where these are a part."""

    def __init__(self, items: list[tuple], threshold: float, whole: tuple | None = None):
        self.threshold = threshold
        self.items = []
        for item_id, text, answer in items:
            question, reply = split_item(text or "", answer)
            whole_text = whole_item(text, answer)
            all_words = words_of(whole_text)
            if all_words:
                self.items.append((-1 if item_id is None else item_id, all_words, shingles(words_of(question)), set(words_of(reply)), len(pieces_of(whole_text)) < MIN_WORDS))
        self.items.sort(key=lambda x: (len(x[1]), x[0]))
        if whole is None:
            lengths = [len(x[1]) for x in self.items]
            whole = len(lengths), sum(lengths) / max(len(lengths), 1), max(lengths, default=1), Counter(w for x in self.items for w in set(x[1]))
        n, mean, longest, df = whole
        self.window = 2 * longest
        self.ids: dict[bytes, int] = {w: i for i, w in enumerate(sorted({w for x in self.items for w in x[1]}))}
        self.impacts: list[dict[int, float]] = []
        essential = defaultdict(set)
        for at, (_, all_words, *_) in enumerate(self.items):
            weight = {}
            for w, tf in Counter(all_words).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(all_words) / mean))
            total, spent = sum(weight.values()) or 1.0, 0.0
            self.impacts.append({self.ids[w]: x / total for w, x in weight.items()})
            for w in sorted(weight, key=lambda w: (-df[w], w)):
                spent += weight[w] / total
                if spent >= threshold - 1e-9:
                    essential[self.ids[w]].add(at)
        self.essential = {t: np.array(sorted(x), np.int64) for t, x in essential.items()}
        self.essential_words = frozenset(w for w, t in self.ids.items() if t in self.essential)
        self.block_max: list[dict[int, float]] = []
        for begin in range(0, len(self.items), BLOCK):
            most: dict[int, float] = {}
            for impact in self.impacts[begin : begin + BLOCK]:
                for t, x in impact.items():
                    most[t] = max(most.get(t, 0.0), x)
            self.block_max.append(most)

    def search(self, text: str | None) -> list[tuple[int, float]]:
        """[(item's place, best score)] over the passages of a text, whose question and answer overlap."""
        words = words_of(text)
        found: dict[int, float] = {}
        if self.essential_words.isdisjoint(words):
            return []
        ids, essential = self.ids, self.essential
        rare = [(i, ids[w]) for i, w in enumerate(words) if w in self.essential_words]
        half = max(1, self.window // 2)
        asked: dict[int, set[int]] = defaultdict(set)
        for i, t in rare:
            last = i // half
            for window in (last - 1, last) if last else (0,):
                asked[window].update(essential[t].tolist())
        for window, items in asked.items():
            passage = words[window * half : window * half + self.window]
            terms = {ids[w] for w in passage if w in ids}
            by_block = defaultdict(list)
            for at in items:
                by_block[at // BLOCK].append(at)
            for block, members in by_block.items():
                most = self.block_max[block]
                if sum(most[t] for t in terms if t in most) < self.threshold - 1e-9:
                    continue
                for at in members:
                    impact = self.impacts[at]
                    score = sum(impact[t] for t in impact if t in terms)
                    if score >= self.threshold - 1e-9 and score > found.get(at, 0.0) and self.overlaps(at, passage):
                        found[at] = score
        return sorted(found.items())

    def overlaps(self, at: int, passage: list[bytes], share: float = 0.5) -> bool:
        _, words, question, answer, short = self.items[at]
        if short:
            return any(w == words[0] and passage[i : i + len(words)] == words for i, w in enumerate(passage))
        width = len(next(iter(question))) if question else 0
        here = shingles(passage, width) if width <= len(passage) else set()
        in_question = len(question & here) / len(question) if question else 1.0
        in_answer = len(answer.intersection(passage)) / len(answer) if answer else 1.0
        return in_question >= share and in_answer >= share


def item_shards(items: DataFrame, threshold: float) -> list[str]:
    """Files of indexes, one for each shard of about SHARD_BYTES of items, each built by a task from its items and their words' frequencies."""
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [words_of(whole_item(t, a)) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            words = pa.array([sorted(set(x)) for x in found], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(x) for x in found], pa.int64()), words], ["item_id", "text", "answer", "n", "words"])

    rows = common.materialise(rows.mapInArrow(run, "item_id long, text string, answer string, n long, words array<binary>"), "items").filter("n > 0")
    size = F.sum(F.octet_length("text") + F.octet_length(common.text_or_empty("answer")) + 64)
    size, n, mean, longest = rows.agg(F.coalesce(size, F.lit(0)), F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    shards, folder = math.ceil(size / SHARD_BYTES), common.scratch(items.sparkSession, "item_index")
    df = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    parts = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))))
    own = parts.select(F.col("shard").alias("of"), F.explode("words").alias("w")).distinct().join(df, "w")

    def build(part, known):
        index = Index(list(zip(part["item_id"], part["text"], part["answer"])), threshold, (n, mean, longest, dict(zip(map(bytes, known["w"]), known["df"]))))
        path = f"{folder}/{uuid.uuid4().hex}.index"
        common.put_file(path, lambda out: out.write(pickle.dumps(index)))
        return pd.DataFrame({"path": [path]})

    both = parts.select("shard", "item_id", "text", "answer").groupBy("shard").cogroup(own.groupBy("of"))
    return sorted(r.path for r in both.applyInPandas(build, "path string").collect()) if shards else []


def read_index(path: str) -> Index:
    where, at = common.store(path)
    with where.open_input_stream(at, compression=None) as f:
        return pickle.loads(f.read())


def leaks(paths: list[str]):
    """A pandas UDF: the items of the indexes that each text leaks. Batches are held up to HELD_BYTES if several are to be asked."""

    def answers(held: list[pd.Series]):
        hits = [set() for texts in held for _ in texts]
        for path in paths:
            index = common.worker_cache("decontaminate", path, lambda: read_index(path))  # a single shard's stays for the next task
            for text, own in zip(itertools.chain(*held), hits):
                own.update(index.items[at][0] for at, _ in index.search(text))
        rest = iter(hits)
        for texts in held:
            yield pd.Series([sorted(next(rest)) for _ in texts], dtype=object)

    @F.pandas_udf("array<bigint>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, size = [], 0
        for texts in batches:
            held.append(texts)
            size += int(texts.str.len().sum()) if len(texts) else 0
            if len(paths) == 1 or size >= HELD_BYTES:
                yield from answers(held)
                held, size = [], 0
        yield from answers(held)

    return found


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, column: str = "item_ids") -> DataFrame:
    """docs with a column array<long>: the items that each row's text leaks, ascending (empty: none). docs' other columns stay."""
    if column in docs.columns:
        raise ValueError(f"docs has a column {column} already")
    paths = item_shards(items, threshold)
    return docs.withColumn(column, leaks(paths)(F.col("text").cast("string")) if paths else F.array().cast("array<bigint>"))
