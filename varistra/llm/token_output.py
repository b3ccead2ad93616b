"""Token-ID output: frequency-ranked ids in byte-aligned variable-length code.

Format of a shard (``shard-NNNNNN.vtk``): blocks one after another. A block holds whole documents:

    magic ``VTK1`` | n_docs u32 | n_ids u64 | n_data u64 | doc_id i64 * n_docs | is_null u8 * n_docs
    | ids in each document u64 * n_docs | control bytes (n_ids + 3) // 4 | data bytes n_data

Ids are replaced by their rank of frequency in the whole corpus (ties: smaller id first), so the commonest
256 ids take one data byte. Four ranks share a control byte, two bits each: the number of data bytes less one.
Control and data bytes stand apart, so a block is decoded with table lookups and no branches.
``ranks.bin`` holds the id of each rank as u32. ``index`` (Parquet) has a row for each shard: its first position.

Defined results. A null text counts as empty and gives the end id alone. Rows are in ascending order of doc_id,
null doc_ids first, equal doc_ids by a hash of their ids; equal rows are all kept. Other columns are ignored,
whatever their names. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from string import punctuation as PUNCTUATION

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistra.llm import common

MAGIC = b"VTK1"
HEAD = struct.Struct("<4sIQQ")
BLOCK_IDS = 1 << 20
#: Memory that a worker's known words take, in two generations of half of it: a full one replaces the older.
CACHE_BYTES = 64 << 20
#: What a known word takes besides its own bytes.
ENTRY_BYTES = 220
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 4 << 20
#: White space of the pattern that str.isspace() doesn't count.
ODD_SPACE = "\u180e\u200b\ufeff"
#: The ASCII characters that count as white space, by code.
SPACES = np.array([c < 128 and chr(c).isspace() for c in range(256)])
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters up to here are letters in every version of Unicode in use; other words are cut by the library alone.
KNOWN = "\u0530"

# ---------------------------------------------------------------- tokenizing


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def blank_edges(words, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether words (an Arrow array, and as a list) begin and end with white space; an empty word counts as both."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    out = []
    for at, place in ((offsets[:-1], 0), (offsets[1:] - 1, -1)):
        edge = raw[np.clip(at, 0, len(raw) - 1)]
        blank = SPACES[edge] | (offsets[1:] == offsets[:-1])
        for i in np.flatnonzero((edge > 0x7F) & (edge != 0xC3) & ~blank).tolist():  # 0xC3 begins Latin letters alone
            c = names[i][place]
            blank[i] = c.isspace() or c in ODD_SPACE
        out.append(blank)
    return out[0], out[1]


class CachedEncoder:
    """Ids of whole texts, by the tokenizers library, with the ids of words that were seen before.

    The byte-level pattern always starts a new piece at a space that follows or precedes other than white space,
    and pieces are merged each on its own. So texts are cut before such spaces by Arrow, each distinct word of a chunk
    is looked up once, a new word's pieces go through the library's model once, and ids are gathered by numpy. A text
    with white space on both sides of a space, or with the content of an added token (such as an end mark written out),
    goes to the library whole, as does every text under any other kind of tokenizer.
    """

    def __init__(self, tokenizer_path: str, cache_bytes: int = CACHE_BYTES):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads only wait for it
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        cut = spec["pre_tokenizer"] or {}
        byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.by_word = bool(byte_level and not spec["normalizer"] and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"))
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.pieces, self.model = regex.compile(PIECES), self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.space, self.kind = self.letters[0x20], "H" if self.dtype.itemsize == 2 else "I"
        self.cache_bytes, self.used = cache_bytes, 0
        #: By what stands before a word (a space or nothing): its ids; the same of the generation before.
        self.known: dict[str, dict[str, bytes]] = {" ": {}, "": {}}
        self.older: dict[str, dict[str, bytes]] = {" ": {}, "": {}}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, by the library's model."""
        return self._shown(piece.encode().decode("latin-1").translate(self.letters))

    def _shown(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def ids_of(self, words: list[str], before: str) -> list[bytes]:
        """The ids of each word after what stands before it."""
        if self.used > self.cache_bytes // 2:
            self.older, self.known, self.used = self.known, {" ": {}, "": {}}, 0
        known, older, space = self.known[before], self.older[before], self.space if before else ""
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        marks: dict[str, bytes] = {}
        alone = []
        for i in missing:
            w = words[i]
            ids = older.get(w)
            if ids is None:
                plain = w.isascii()
                if w and (plain or max(w) < KNOWN):
                    stem = w.rstrip(PUNCTUATION)  # a run of ASCII punctuation after letters is one piece
                    if stem.isalpha():
                        ids = known.get(stem) if stem is not w else None
                        if ids is None:
                            ids = self._shown(space + stem) if plain else self._piece(before + stem)
                        if len(stem) < len(w):
                            tail = w[len(stem) :]
                            if tail not in marks:
                                marks[tail] = self._piece(tail)
                            ids += marks[tail]
                    else:
                        ids = b""
                        for p in self.pieces.findall(before + w):
                            if p not in marks:
                                marks[p] = known.get(p[1:]) if before and p[0] == before else None
                                marks[p] = self._piece(p) if marks[p] is None else marks[p]
                            ids += marks[p]
                else:
                    alone.append(i)
                    continue
            out[i] = known[w] = ids
        for i, ids in zip(alone, self._whole([before + words[i] for i in alone]) if alone else ()):
            out[i] = known[words[i]] = ids
        self.used += len(missing) * ENTRY_BYTES + sum([len(words[i]) + len(out[i]) for i in missing])
        return out

    def _lists(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = [x + end for x in self._whole(texts)]
        return np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize, np.frombuffer(b"".join(ids), self.dtype)

    def encode(self, texts, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids in each text, all ids) of an Arrow array of texts without nulls; end follows each text's ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word or not len(texts):
            return self._lists(texts.to_pylist(), end)
        parts = pc.split_pattern(texts, " ")
        at, words = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
        coded = words.dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_pylist()
        blank_start, blank_end = blank_edges(coded.dictionary, names)
        inner = blank_end[codes[:-1]] & blank_start[codes[1:]]
        inner[at[1:-1] - 1] = False
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(at, np.flatnonzero(inner), "right") - 1] = True
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        first = words.take(pa.array(at[:-1])).to_pylist()
        chosen = np.flatnonzero(whole)
        units = [*self.ids_of(names, " "), *self.ids_of(first, ""), *(self._whole(texts.take(pa.array(chosen)).to_pylist()) if len(chosen) else ()), b"", end]
        codes[at[:-1]] = len(names) + np.arange(len(texts))
        for i, t in enumerate(chosen.tolist()):
            codes[at[t] : at[t + 1]] = len(units) - 2
            codes[at[t]] = len(names) + len(texts) + i
        codes = np.insert(codes, at[1:], len(units) - 1)
        n = np.fromiter(map(len, units), np.int64, len(units)) // self.dtype.itemsize
        begin, n_of = np.cumsum(n) - n, n[codes]
        ends = np.cumsum(n_of)
        gathered = np.repeat((begin[codes] - ends + n_of).astype(np.int32), n_of)  # a chunk holds under 2 billion ids, or one text
        gathered += np.arange(len(gathered), dtype=np.int32)
        return np.diff(ends[at[1:] + np.arange(len(texts))], prepend=0), np.frombuffer(b"".join(units), self.dtype)[gathered]

    def __call__(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        n, ids = self.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [ids[b - k : b].tobytes() for b, k in zip(ends.tolist(), n.tolist())]


def encoder(tokenizer_path: str) -> CachedEncoder:
    """The worker's own encoder; it outlives the task, until the ids are counted or another operator runs in that worker."""
    return common.worker_cache("tokens", tokenizer_path, lambda: CachedEncoder(tokenizer_path))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n, ids, counts): the ids of each whole text and the end id as little-endian bytes, 2 to an id where the vocabulary allows.

    The last row of each task has counts instead, all else null: how often the task met each id, as 64-bit integers."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        total = np.zeros(max(enc.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        for batch in batches:
            for part in common.by_bytes(batch, 1, CHUNK_BYTES):
                n, ids = enc.encode(part.column(1), end)
                total += np.bincount(ids, minlength=len(total))
                offsets = np.append(0, np.cumsum(n) * width)
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), raw.cast(pa.binary()), pa.nulls(len(n), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array([total.tobytes()])], names)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


# ---------------------------------------------------------------- the code

#: Of each control byte: the data bytes of its four ranks, and of all.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
MASKS = np.tri(4, dtype=bool)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit unsigned ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[MASKS[extra]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks again: lengths by table lookup, places by a running sum, bytes gathered at once."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    out = data[starts].astype(np.uint32)
    for byte in range(1, 4):
        has = np.flatnonzero(lengths > byte)
        if not len(has):
            break
        out[has] |= data[starts[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def pack_block(doc_ids: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)) + keys + np.array(lengths, "<u8").tobytes() + control + data


def read_blocks(stream, id_of_rank: np.ndarray):
    """(doc_ids, is_null, lengths, ids) of each block of an open shard."""
    while head := stream.read(HEAD.size):
        magic, n_docs, n_ids, n_data = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        take = lambda n, kind: np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        doc_ids, nulls, lengths = take(n_docs, "<i8"), take(n_docs, "u1"), take(n_docs, "<u8")
        control, data = take(-(-n_ids // 4), "u1"), take(n_data, "u1")
        yield doc_ids, nulls.astype(bool), lengths.astype(np.int64), id_of_rank[decode_ranks(control, data, n_ids)]


# ---------------------------------------------------------------- writing and reading


def id_counts(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, occurrences) of all tokens; at most one row for each id of the vocabulary, whatever the input."""

    def run(batches):
        import pyarrow as pa

        common.forget()  # all is encoded: what sorts and writes the ids has the memory
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n = np.frombuffer(x.as_buffer(), np.int64)
                total = n + (total if len(total) else 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counted = tokens.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long")
    return [(r.id, r.n) for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()]


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0) -> str:
    """Write the token shards of documents(doc_id, text) to the folder out, a URI that the executors share; returns out."""
    with common.small_batches(docs.sparkSession):
        return _write(docs, out, tokenizer_path, end_id)


def _write(docs: DataFrame, out: str, tokenizer_path: str, end_id: int) -> str:
    spark = docs.sparkSession
    width = encoder(tokenizer_path).dtype.itemsize
    tokens = common.materialise(tokenize(docs, tokenizer_path, end_id), "tokens")
    ranked = sorted(id_counts(tokens), key=lambda x: (-x[1], x[0]))
    id_of_rank = np.array([i for i, _ in ranked], "<u4")
    common.put_file(f"{out}/ranks.bin", lambda f: f.write(id_of_rank.tobytes()))
    rank_of_id = np.zeros(int(id_of_rank.max()) + 1 if len(id_of_rank) else 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of_id)  # at most the vocabulary

    def run(batches):
        import pyarrow as pa

        common.forget()
        ranks, name = sent.value, f"{out}/shard-{TaskContext.get().partitionId():06d}.vtk"
        totals = [0, 0]

        def write(f):
            doc_ids, lengths, held, n = [], [], [], 0

            def flush():
                f.write(pack_block(doc_ids, lengths, ranks[np.frombuffer(b"".join(held), f"<u{width}")]))
                totals[0] += len(doc_ids)
                totals[1] += n

            for batch in batches:
                for doc_id, size, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    doc_ids.append(doc_id)
                    lengths.append(size)
                    held.append(ids.as_buffer())
                    n += size
                    if n >= BLOCK_IDS:
                        flush()
                        doc_ids, lengths, held, n = [], [], [], 0
            if doc_ids:
                flush()

        common.put_file(name, write)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    keyed = tokens.filter("counts is null").withColumn("tie", F.xxhash64("ids"))
    in_order = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n", "ids")
    shards = in_order.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").collect()  # a row for each shard
    start, index = 0, []
    for r in sorted(shards, key=lambda r: r.shard):
        if r.n_docs:
            index.append((r.shard, r.path.removeprefix(f"{out}/"), start, r.n_docs, r.n_ids))
        start += r.n_ids
    spark.createDataFrame(index, "shard long, file string, start long, n_docs long, n_ids long").coalesce(1).write.mode("overwrite").parquet(f"{out}/index")
    common.remove(spark, tokens.scratch_path)
    sent.unpersist()
    return out


def read_tokens(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """The documents of a folder of shards: doc_id, start, n_tokens, and ids (array<int>), or with digest their crc32 instead."""
    index = spark.read.parquet(f"{out}/index")
    n = max(1, min(index.count(), 4 * spark.sparkContext.defaultParallelism))
    last, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")

    def run(batches):
        import pyarrow as pa

        where, path = common.store(f"{out}/ranks.bin")
        with where.open_input_file(path) as f:
            id_of_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path = common.store(f"{out}/{file}")
                with where.open_input_stream(path, compression=None) as f:
                    for doc_ids, nulls, lengths, ids in read_blocks(f, id_of_rank):
                        ends = np.cumsum(lengths)
                        begins = ends - lengths
                        if digest:
                            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                            found = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())
                        else:
                            found = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(begins + start), pa.array(lengths), found], ["doc_id", "start", "n_tokens", last])
                        start += int(ends[-1])

    return index.select("file", "start").repartition(n).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {kind}")
