"""Removal of repeated 50-byte strings with suffix arrays built by two-stage sorting.

A document loses each byte of every 50-byte string of its text that also starts in a document with a smaller doc_id.

Sorting every suffix of a large table would move each text many times, so the suffixes that have to be sorted are found first.
Every 50-byte window has an anchor: the leftmost of its 25-byte strings with the smallest hash. It depends on the window's
bytes alone, so equal windows have equal anchors in equal places. The windows of one anchor in a text are neighbours;
together they are its phrase, at most 75 bytes, and every window lies in exactly one phrase.

1. ``anchor_records``: the table is cut into chunks of about ``CHUNK_BYTES``, kept compressed in the shared folder. A chunk passes on a
   sorted list of (anchor hash, phrase hash, first document) for each range of hashes, compressed: 12 bytes or so a phrase.
   Equal phrases of a chunk are one entry.
2. ``judge``: a range's lists meet in one task. A phrase that an earlier document has is repeated as a whole: equal phrases
   are one entry of the dictionary to be sorted, with the smallest document. An anchor with one phrase leaves nothing
   to sort. The first documents of anchors with several phrases go on to be sorted. The answer is one
   code for each entry of a list, in its order.
3. ``phrases``: those phrases leave their chunks, in two rows: windows with at least 13 bytes left of the anchor, and the
   others, which have at least 13 right of it. They meet by anchor and those 13 bytes.
4. ``repeated_windows``: a task sorts the suffixes of its phrases, as many anchors at once as fit in ``SORT_BYTES``. Two stages: suffixes
   smaller than their successors are sorted directly, the others are induced by scanning the buckets of first bytes
   in order. Neighbours with a common prefix of 50 bytes or more are runs of equal windows; those of a run that aren't in its smallest
   document are repeated.
5. ``apply``: each chunk takes its answers from the shared folder, marks bytes and cuts them out.

Phrase hashes have 56 bits within an anchor's 48; windows of sorted phrases are compared byte by byte. Nothing is capped. A
passage that very many documents have, each with other words around it, gives an anchor very many phrases: a chunk passes on two of
them and has the others sorted in any case, and keys of over ``HOT_PHRASES`` phrases are settled window by window, by
aggregates that begin in each task (``single_windows``).

Defined results. A null text counts as empty; texts under 50 bytes stay whole. Rows that share a doc_id are one document for
what is smaller: neither loses bytes to the other. A null doc_id is smaller than any other. A repeated row gets its copy's
result. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistra.llm import common

WIDTH, GRAM = 50, 25
SIDE = (WIDTH - GRAM + 1) // 2  # bytes that a window has left or right of its anchor at least
CHUNK_BYTES, SORT_BYTES, RANGE_BYTES = 4 << 20, 1 << 20, 16 << 20
ANCHOR_BITS = 48
#: Strings hashed at a time; their places take 16 bits.
BLOCK = 0xFFFF
FOLDER_CHUNKS, MOST_FOLDERS = 16, 4096
#: Different phrases of an anchor that a chunk passes on; phrases of a key that are sorted in one task.
MOST_PHRASES, HOT_PHRASES = 16, 20_000
LOWEST = -(1 << 63)
#: Ends what is sorted: no UTF-8 text has these bytes, so no window equals a string cut short.
END = b"\xff" * 64
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * U(0xD6E8FEB86659FD93) + right
    return out ^ (out >> U(32))


def rolling(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of all strings of each width: those of 1, 2, 4, ... bytes joined by pairs, and those joined to the width."""
    power, of_power, out = 1, (data.astype(U) + U(1)) * U(0x9E3779B97F4A7C15), {}
    parts = {w: None for w in widths}
    while True:
        for w in widths:
            if w & power:
                done = w & (power - 1)
                if parts[w] is None:
                    parts[w] = of_power
                else:
                    n = min(len(parts[w]), max(0, len(of_power) - done))
                    parts[w] = join_hashes(parts[w][:n], of_power[done : done + n])
            if w < 2 * power:
                out.setdefault(w, parts[w])
        power *= 2
        if power > max(widths):
            return [mixed(out[w][: max(0, len(data) - w + 1)]) for w in widths]
        of_power = join_hashes(of_power[: max(0, len(of_power) - power // 2)], of_power[power // 2 :])


def in_order(keys: list[np.ndarray]) -> np.ndarray:
    """Places in rising order of the first key; ties are sorted by the next, and so on."""
    order = np.argsort(keys[0])
    if not len(order):
        return order
    key = keys[0][order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for key in keys[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = (np.cumsum(new) - 1)[at]
        sub = order[at]
        by = np.lexsort((key[sub], group))  # groups stay where they are
        order[at] = sub = sub[by]
        value = key[sub]
        new[at[1:]] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
    return order


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    span, n = 1, len(x) - width + 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, in blocks that fit in a core's cache."""
    out = np.zeros(max(0, len(data) - GRAM + 1), U)
    for at in range(0, len(out), BLOCK):
        (out[at : at + BLOCK],) = rolling(data[at : at + BLOCK + GRAM - 1], (GRAM,))
    return out


def anchors(grams: np.ndarray, begins_here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, end of windows) of each anchor, in order; begins_here tells which windows count."""
    span, parts = WIDTH - GRAM + 1, []
    # the upper bits order the strings; the lower ones hold the place in a block, so that of equal ones the leftmost is the smallest
    low, step = U(0xFFFF), BLOCK - span + 1
    for at in range(0, len(begins_here), step):
        block = grams[at : at + BLOCK]
        windows = np.flatnonzero(begins_here[at : at + step])
        if not len(windows):
            continue
        least = sliding_min((block & ~low) | np.arange(len(block), dtype=U), span)[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(windows)) - 1
        parts.append((least[first] >> U(16), (least[first] & low).astype(np.int64) + at, windows[first] + at, windows[last] + at + 1))
    if not parts:
        return np.zeros(0, U), *[np.zeros(0, np.int64)] * 3
    h, place, first, end = (np.concatenate(x) for x in zip(*parts))
    goes_on = np.zeros(len(h), bool)  # from one block into the next
    goes_on[1:] = (place[1:] == place[:-1]) & (first[1:] == end[:-1])
    stays, last = ~goes_on, np.append(~goes_on[1:], True)
    return mixed(h[stays]) >> U(64 - ANCHOR_BITS), place[stays], first[stays], end[last]  # mixed again: minima are small numbers


def phrase_hashes(grams: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """56 bits of each phrase and of where its anchor is: its first and its last window, two strings each, cover it."""
    half, last = WIDTH - GRAM, end - 1
    windows = join_hashes(join_hashes(grams[first], grams[first + half]), join_hashes(grams[last], grams[last + half]))
    own = (place - first).astype(U) * U(64) + (place - last).astype(U)
    return mixed(join_hashes(windows, own * U(0x9E3779B97F4A7C15))) >> U(8)


class Chunk:
    """The phrases of a chunk's texts: distinct (anchor, phrase) in order, each with its first document."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.texts = texts
        self.doc_ids, self.rank = np.unique(np.array(ids, np.int64), return_inverse=True)  # equal doc_ids are one document
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        grams = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
        counts = np.zeros(max(0, int(lengths.sum()) - WIDTH + 1), bool)
        for a, n in zip(starts.tolist(), lengths.tolist()):
            counts[a : max(a, a + n - WIDTH + 1)] = True
        anchor, place, first, end = anchors(grams, counts)
        phrase = phrase_hashes(grams, place, first, end)
        text = np.searchsorted(starts, first, "right") - 1  # of texts that begin there only the last isn't empty
        rank = self.rank[text]
        order = in_order([anchor, phrase, rank])
        self.anchor, self.phrase, self.text = anchor[order], phrase[order], text[order]
        self.place, self.first, self.end = (x[order] - starts[self.text] for x in (place, first, end))
        rank, new = rank[order], np.ones(len(order), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.phrase[1:] != self.phrase[:-1])
        self.begins = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1
        self.own = rank[self.begins]  # the smallest document of each entry
        self.later = rank > self.own[self.entry]
        self.sent = self.to_judge()

    def to_judge(self) -> np.ndarray:
        """The entries that are passed on: all but those of anchors with over MOST_PHRASES, of which the first and the last document's are."""
        anchor = self.anchor[self.begins]
        order = in_order([anchor, self.own])
        sizes = np.unique(anchor, return_counts=True)[1]
        last = np.cumsum(sizes)
        keep = np.repeat(sizes <= MOST_PHRASES, sizes)
        keep[last - sizes] = keep[last - 1] = True
        return np.sort(order[keep])

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each range of anchor hashes begins among the entries sent; the last is their number."""
        lows = np.array([-(-(i << ANCHOR_BITS) // ranges) for i in range(ranges)], U)
        return [*np.searchsorted(self.anchor[self.begins[self.sent]], lows).tolist(), len(self.sent)]


def planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def from_planes(raw: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T
    return out.view("<u8").reshape(-1)


def pack(anchor: np.ndarray, phrase: np.ndarray, doc: np.ndarray, doc_ids: np.ndarray) -> bytes:
    """A sorted list of entries by byte places: differences of anchors, phrases, documents as places among doc_ids."""
    import zstandard

    used, place = np.unique(doc, return_inverse=True)
    ids = doc_ids[used]
    head = np.array([len(anchor), len(ids)], "<u4").tobytes()
    body = planes(np.diff(ids.view(U), prepend=U(0)), 8) + planes(np.diff(anchor, prepend=U(0)), 6) + planes(place, 4)
    return head + planes(phrase, 7) + zstandard.compress(body, 3)  # phrases are random: left as they are


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, phrase, doc_id) of each entry."""
    import zstandard

    n, k = np.frombuffer(data, "<u4", 2).tolist()
    phrase, body = from_planes(data[8 : 8 + 7 * n], n, 7), zstandard.decompress(data[8 + 7 * n :])
    ids = np.cumsum(from_planes(body[: 8 * k], k, 8), dtype=U).view(np.int64)
    anchor = np.cumsum(from_planes(body[8 * k : 8 * k + 6 * n], n, 6), dtype=U)
    return anchor, phrase, ids[from_planes(body[8 * k + 6 * n :], n, 4).astype(np.int64)] if n else np.zeros(0, np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, ids, lengths, pack): texts of tasks' successive rows, compressed together; a long text is a chunk of its own."""

    def run(batches):
        import uuid

        import pyarrow as pa
        import zstandard

        def flush(ids, texts):
            # a name of its own for each chunk: a repeated task's other names come with its other rows
            name, whole = uuid.uuid4().int >> 65, zstandard.compress(b"".join(texts), 3)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([whole], pa.binary())], ["chunk", "ids", "lengths", "pack"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), common.text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, ids array<long>, lengths array<long>, pack binary")


def opened(batches):
    """(chunk name, Chunk) of each row of chunks."""
    import zstandard

    for batch in batches:
        for name, ids, lengths, data in zip(*(batch.column(i) for i in range(4))):
            whole, lengths = zstandard.decompress(data.as_py()), np.array(lengths.as_py(), np.int64)
            ends = np.cumsum(lengths)
            yield name.as_py(), Chunk(ids.as_py(), [whole[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())])


def anchor_records(chunks: DataFrame, ranges: int) -> DataFrame:
    """(part, chunk, pack): each chunk's entries for each range of anchor hashes."""

    def run(batches):
        import pyarrow as pa

        for name, c in opened(batches):
            cuts, parts, out = c.cuts(ranges), [], []
            at, own = c.begins[c.sent], c.own[c.sent]
            anchor, phrase = c.anchor[at], c.phrase[at]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    parts.append(i)
                    out.append(pack(anchor[a:b], phrase[a:b], own[a:b], c.doc_ids))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array(out, pa.binary())], ["part", "chunk", "pack"])

    return chunks.mapInArrow(run, "part int, chunk long, pack binary")


def verdicts(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each entry of some chunks' lists of one range 0, 1: an earlier document has this phrase, or 2: to be sorted."""
    anchor, phrase, doc = (np.concatenate(x) for x in zip(*lists))
    order = in_order([anchor, phrase, doc])
    a, p, d = anchor[order], phrase[order], doc[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_p = new_a | np.concatenate([[True], p[1:] != p[:-1]])
    first = d[np.flatnonzero(new_p)][np.cumsum(new_p) - 1]
    group = np.cumsum(new_a) - 1
    begins = np.flatnonzero(new_a)
    several = np.add.reduceat(new_p.astype(np.int64), begins) > 1
    several &= np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
    code = np.where(d > first, 1, np.where(several[group], 2, 0)).astype(np.uint8)
    # of equal first documents (rows that share a doc_id) each has to be answered
    out = np.zeros(len(order), np.uint8)
    out[order] = code
    return np.split(out, np.cumsum([len(x[0]) for x in lists])[:-1])


def judge(records: DataFrame, ranges: int) -> DataFrame:
    """(chunk, part, codes): the verdicts of each list, two bits an entry as bytes, compressed."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        def answer(part, names, lists):
            codes = verdicts(lists)
            out = [len(c).to_bytes(4, "little") + zstandard.compress(c.tobytes(), 3) for c in codes]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(out, pa.binary())], ["chunk", "part", "codes"])

        now, names, lists = None, [], []
        for batch in batches:
            for part, name, data in zip(*(batch.column(i) for i in range(3))):
                if part.as_py() != now:
                    if lists:
                        yield answer(now, names, lists)
                    now, names, lists = part.as_py(), [], []
                names.append(name.as_py())
                lists.append(unpack(data.as_py()))
        if lists:
            yield answer(now, names, lists)

    return records.repartition(ranges, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, "chunk long, part int, codes binary")


def answers(rows: DataFrame, folders: int, tag: str) -> str:
    """Where the rows' answers stand, in folders by chunk, sorted by chunk."""
    path = common.scratch(rows.sparkSession, tag)
    rows = rows.withColumn("folder", F.pmod(F.xxhash64("chunk"), F.lit(folders)).cast("int"))
    rows.repartition("folder").sortWithinPartitions("folder", "chunk").write.partitionBy("folder").option("compression", "zstd").parquet(path)
    return path


def read_answers(path: str, folder: int, name: int):
    """A chunk's rows of ``answers``, read by the task that has the chunk."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    where, at = common.store(f"{path}/folder={folder}")
    if where.get_file_info(at).type == fs.FileType.NotFound:
        return []
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    return [t for t in (pq.read_table(f, filesystem=where, filters=[("chunk", "=", name)], partitioning=None) for f in files) if t.num_rows]


def codes_of(c: Chunk, name: int, folder: int, path: str, ranges: int) -> np.ndarray:
    """The verdicts of a chunk's entries; those that weren't sent are to be sorted."""
    import zstandard

    cuts, found = c.cuts(ranges), np.zeros(len(c.sent), np.uint8)
    for table in read_answers(path, folder, name):
        for part, data in zip(table.column("part").to_pylist(), table.column("codes").to_pylist()):
            n = int.from_bytes(data[:4], "little")
            found[cuts[part] : cuts[part] + n] = np.frombuffer(zstandard.decompress(data[4:]), np.uint8)
    out = np.full(len(c.begins), 2, np.uint8)
    out[c.sent] = found
    return out


def with_folder(chunks: DataFrame, folders: int) -> DataFrame:
    return chunks.select("chunk", "ids", "lengths", "pack", F.pmod(F.xxhash64("chunk"), F.lit(folders)).cast("int").alias("folder"))


def phrases(chunks: DataFrame, codes: str, folders: int, ranges: int) -> DataFrame:
    """(key, doc_id, chunk, entry, back, windows, text): the phrases to be sorted, in two parts.

    text begins at the window that lies ``back`` bytes left of the anchor and holds ``windows`` windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for (name, c), folder in zip(opened([batch]), batch.column(4).to_pylist()):
                entries = np.flatnonzero(codes_of(c, name, folder, codes, ranges) == 2)
                rows = []
                at = c.begins[entries]
                for e, anchor, text, place, first, end, own in zip(entries.tolist(), c.anchor[at].tolist(), c.text[at].tolist(), c.place[at].tolist(), c.first[at].tolist(), c.end[at].tolist(), c.own[entries].tolist()):
                    data, mid, doc_id = c.texts[text], min(max(place - SIDE + 1, first), end), int(c.doc_ids[own])
                    for side, a, b in ((b"L" + data[place - SIDE : place], first, mid), (b"R" + data[place + GRAM : place + GRAM + SIDE], mid, end)):
                        if a < b:
                            rows.append((anchor.to_bytes(6, "big") + side, doc_id, name, e, place - a, b - a, data[a : b + WIDTH - 1]))
                for i in range(0, len(rows), 20_000):
                    columns = list(zip(*rows[i : i + 20_000]))
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], ["key", "doc_id", "chunk", "entry", "back", "windows", "text"])

    return with_folder(chunks, folders).mapInArrow(run, "key binary, doc_id long, chunk long, entry long, back int, windows int, text binary")


def words_at(data: np.ndarray, count: int) -> list[np.ndarray]:
    """The eight bytes at each place, ``8 * i`` further on, as one number each in byte order (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8 * count + 8, np.uint8)])
    word = np.zeros(len(data) + 8 * count, np.uint64)
    for i in range(8):
        word = (word << U(8)) | padded[i : i + len(word)].astype(U)
    return [word[8 * i : 8 * i + len(data)] for i in range(count)]


def suffix_array(data: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """All suffixes of data in the order of their first ``depth`` bytes at least, in two stages.

    A suffix that is smaller than its successor begins a rise. Those are sorted directly. All others are larger than their
    successors; buckets of first bytes are scanned upwards, and each suffix met puts its predecessor, if that is larger,
    next into its bucket: before the bucket's rising ones, which are larger than all of that bucket that fall."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    changes = np.flatnonzero(data[1:] != data[:-1])
    after = np.searchsorted(changes, np.arange(n))  # the next place where the byte changes decides; the end is smaller than all
    rises = np.zeros(n, bool)
    inside = after < len(changes)
    at = changes[after[inside]]
    rises[inside] = data[at] < data[at + 1]
    rising_at = np.flatnonzero(rises)
    direct = rising_at[in_order([w[rising_at] for w in words_at(data, -(-depth // 8) + 1)])]
    counts = np.bincount(data, minlength=256)
    rising = np.split(direct, np.cumsum(np.bincount(data[direct], minlength=256))[:-1])
    falling: list[list[np.ndarray]] = [[] for _ in range(256)]
    falling[data[n - 1]].append(np.array([n - 1]))  # the last suffix, smaller than any other with its first byte

    def induced(suffixes: np.ndarray, byte: int, same: bool) -> np.ndarray:
        before = suffixes[suffixes > 0] - 1
        before = before[~rises[before]]
        return before[data[before] == byte] if same else before[data[before] > byte]

    out = []
    for byte in np.flatnonzero(counts).tolist():
        # runs of one byte: a falling suffix induces the one before it within the bucket, one place further in each round
        parts = falling[byte]
        front = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):
            front = induced(front, byte, True)
            bucket.append(front)
        whole = np.concatenate([*bucket, rising[byte]])
        out.append(whole)
        up = induced(whole, byte, False)
        if len(up):
            first = data[up]
            by = np.argsort(first, kind="stable")
            values, starts = np.unique(first[by], return_index=True)
            for v, part in zip(values.tolist(), np.split(up[by], starts[1:])):
                falling[v].append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """How many bytes each suffix of order shares with the one before it, ``most`` at most; 0 for the first."""
    padded = np.concatenate([data, np.zeros(most, np.uint8)])
    out = np.zeros(len(order), np.int64)
    a, b, still = order[:-1], order[1:], np.arange(1, len(order))
    for i in range(most):
        inside = b + i < len(data)
        inside &= a + i < len(data)
        same = inside & (padded[a + i] == padded[b + i])
        a, b, still = a[same], b[same], still[same]
        if not len(still):
            break
        out[still] = i + 1
    return out


def repeated(texts: list[bytes], windows: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """For each text, which of its windows (starting at 0, 1, ...) also start in a text of a smaller document."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data, starts = np.frombuffer(b"".join(texts) + END, np.uint8), np.cumsum(lengths) - lengths
    order = suffix_array(data)
    alike = common_prefixes(data, order)
    owner = np.searchsorted(starts, order, "right") - 1
    real = order - starts[owner] < windows[owner]  # suffixes that begin a window; others are no strings of a text, or not these rows'
    run = np.cumsum(alike < WIDTH) - 1
    run, order, owner = run[real], order[real], owner[real]
    marks = np.zeros(len(data), bool)
    if len(run):
        begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        least = np.repeat(np.minimum.reduceat(docs[owner], begins), np.diff(np.append(begins, len(run))))
        marks[order] = docs[owner] > least
    return [marks[s : s + w] for s, w in zip(starts.tolist(), windows.tolist())]


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(chunk, entry, mask): bit i stands for the window that begins i bytes left of the anchor.

    Keys of over HOT_PHRASES phrases never meet in one task: their windows are compared one by one."""
    rows = common.materialise(rows, "phrases")
    hot = common.materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PHRASES).select("key"), "hot")
    if hot.isEmpty():
        return sorted_windows(rows)
    return sorted_windows(rows.join(hot, "key", "left_anti")).union(single_windows(rows.join(hot, "key", "left_semi")))


def single_windows(rows: DataFrame) -> DataFrame:
    """The same by the smallest document of each window, summed up in each task first and joined back in salted parts."""
    salt = F.pmod(F.xxhash64("chunk", "entry"), F.lit(common.SALTS)).cast("int").alias("salt")
    each = rows.select("doc_id", "chunk", "entry", "back", "text", salt, F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
    each = each.select("doc_id", "chunk", "entry", "salt", F.substring("text", F.col("i") + 1, F.lit(WIDTH)).alias("window"), (F.col("back") - F.col("i")).alias("left"))
    least = each.groupBy("window", "salt").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")).groupBy("window").agg(F.min("doc").alias("least"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    least = least.filter("n > 1").select("window", "least", F.explode("salts").alias("salt"))
    lost = each.join(least, ["window", "salt"]).filter("doc_id > least")
    return lost.groupBy("chunk", "entry").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("left"))).alias("mask"))


def sorted_windows(rows: DataFrame) -> DataFrame:
    """The same by sorting the suffixes of each key's phrases."""

    def run(batches):
        import pyarrow as pa

        def answer(held):
            _, docs, names, entries, backs, windows, texts = (list(x) for x in zip(*held))
            found = repeated(texts, np.array(windows, np.int64), np.array(docs, np.int64))
            masks = [int((1 << (back - np.flatnonzero(f))).sum()) for f, back in zip(found, backs)]
            keep = [i for i, m in enumerate(masks) if m]
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.int64()), pa.array([entries[i] for i in keep], pa.int64()), pa.array([masks[i] for i in keep], pa.int64())], ["chunk", "entry", "mask"])

        held, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:  # a single phrase is sorted as it is
                        held += group
                        size += sum(len(r[6]) for r in group)
                    group = []
                    if size >= SORT_BYTES:
                        yield answer(held)
                        held, size = [], 0
                group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield answer(held)

    dealt = rows.repartition("key").sortWithinPartitions("key", "doc_id", "chunk", "entry")
    return dealt.mapInArrow(run, "chunk long, entry long, mask long")


def apply(chunks: DataFrame, codes: str, masks: str, folders: int, ranges: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, text (binary, what is left) of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for (name, c), folder in zip(opened([batch]), batch.column(4).to_pylist()):
                code, mask = codes_of(c, name, folder, codes, ranges), np.zeros(len(c.begins), np.int64)
                for table in read_answers(masks, folder, name):
                    np.bitwise_or.at(mask, table.column("entry").to_numpy(), table.column("mask").to_numpy())
                whole = np.flatnonzero(c.later | (code[c.entry] == 1))
                some = np.flatnonzero(~(c.later | (code[c.entry] == 1)) & (mask[c.entry] != 0))
                n = np.array([len(t) for t in c.texts], np.int64)
                starts = np.concatenate([[0], np.cumsum(n + 1)])  # a byte more than the text, so that marks end within it
                edge = np.zeros(int(starts[-1]) + 1, np.int32)
                at = starts[c.text[whole]]
                np.add.at(edge, at + c.first[whole], 1)
                np.add.at(edge, at + c.end[whole] - 1 + WIDTH, -1)
                for i in range(WIDTH - GRAM + 1):
                    hit = some[(mask[c.entry[some]] >> i) & 1 == 1]
                    at = starts[c.text[hit]] + c.place[hit] - i
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WIDTH, -1)
                gone = np.cumsum(edge) > 0
                ids, removed, spans, left = [], [], [], []
                for i, text in enumerate(c.texts):
                    g = gone[starts[i] : starts[i] + n[i]]
                    k = int(g.sum())
                    removed.append(k)
                    spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
                    left.append(np.frombuffer(text, np.uint8)[~g].tobytes() if k else text)
                    doc_id = int(c.doc_ids[c.rank[i]])
                    ids.append(None if doc_id == LOWEST else doc_id)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "text"])

    return with_folder(chunks, folders).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, text binary")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, text (binary) of each row of docs(doc_id, text)."""
    chunks = common.materialise(chunked(docs), "chunks")
    count, size = chunks.agg(F.count(F.lit(1)), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, folders = max(tasks, -(-(size or 0) // RANGE_BYTES)), max(1, min(MOST_FOLDERS, -(-count // FOLDER_CHUNKS)))
    codes = answers(judge(anchor_records(chunks, ranges), ranges), folders, "codes")
    masks = answers(repeated_windows(phrases(chunks, codes, folders, ranges)), folders, "repeats")
    return apply(chunks, codes, masks, folders, ranges)
