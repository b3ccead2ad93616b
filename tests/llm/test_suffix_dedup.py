"""Removal of repeated 50-byte strings against brute force, and on odd tables."""

import numpy as np
import pytest

pytest.importorskip("zstandard")
from varistra.llm import suffix_dedup as S  # noqa: E402

SCHEMA = "doc_id long, text string, chunk string, key int, pack int, ids string"


def by_hand(rows):
    """(doc_id, bytes, removed, spans, what is left) of each row."""
    first = {}
    for i, text, *_ in rows:
        data, k = (text or "").encode(), S.LOWEST if i is None else i
        for a in range(len(data) - 49):
            w = data[a : a + 50]
            first[w] = min(first.get(w, k), k)
    out = []
    for i, text, *_ in rows:
        data, k = (text or "").encode(), S.LOWEST if i is None else i
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 49):
            if first[data[a : a + 50]] < k:
                gone[a : a + 50] = True
        out.append((i, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def same(df, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, by_hand(rows)))
    return got


def corpus(seed, n):
    """Copies, near copies, shared passages of 45 to 80 bytes with their own surroundings, runs of one byte, several bytes a character."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh é漢\n")
    prose = lambda k: "".join(rng.choice(letters, k))
    shared = [prose(int(rng.integers(30, 70))) for _ in range(8)] + ["a" * 90, "ab" * 60, "\0" * 70]
    rows = []
    for i in range(n):
        kind = int(rng.integers(6))
        text = prose(int(rng.integers(0, 400)))
        if kind == 1 and rows:
            text = rows[int(rng.integers(len(rows)))][1]
        elif kind == 2 and rows:
            old = list(rows[int(rng.integers(len(rows)))][1])
            for _ in range(3):
                if old:
                    old[int(rng.integers(len(old)))] = "#"
            text = "".join(old)
        elif kind >= 3:
            text = "".join(prose(int(rng.integers(0, 60))) + shared[int(rng.integers(len(shared)))][int(rng.integers(0, 9)) :] for _ in range(int(rng.integers(1, 6)))) + prose(int(rng.integers(0, 30)))
        rows.append((int(rng.integers(10**6)) if i % 9 else i, text))
    return rows


@pytest.mark.parametrize("seed,chunk,crowd,hot", [(1, 4 << 20, 16, 20_000), (2, 700, 1, 3), (3, 5000, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, crowd, hot):
    """One chunk and many, with and without anchors and keys of too many phrases."""
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(S, "MOST_PHRASES", crowd)
    monkeypatch.setattr(S, "HOT_PHRASES", hot)
    monkeypatch.setattr(S, "SORT_BYTES", 2000)
    rows = corpus(seed, 150)
    got = same(S.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)
    assert sum(r[2] for r in got) > 1000 and sum(r[3] > 1 for r in got) > 5


def test_odd_rows(spark):
    long = "The quick brown fox jumps over the lazy dog while nobody looks at all. "
    rows = [
        (None, long, "x", 1, 1, "y"), (None, None, None, None, None, None), (1, "", "x", 1, 1, "y"), (2, long, "x", 1, 1, "y"), (2, long, "x", 1, 1, "y"), (2, "other " + long, "x", 1, 1, "y"), (3, long[:49], "x", 1, 1, "y"), (4, long[:50], "x", 1, 1, "y"),
        (5, long * 2000 + "é" * 70_000, "x", 1, 1, "y"), (6, "é" * 30 + long * 3, "x", 1, 1, "y"), (7, "\n" * 60, "x", 1, 1, "y"), (8, "\n" * 60, "x", 1, 1, "y"), (-5, long[5:], "x", 1, 1, "y"),
    ]
    odd = spark.createDataFrame(rows, SCHEMA)
    same(S.dedup_bytes(odd), rows)
    assert S.dedup_bytes(odd.limit(0)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    for n, kinds in ((0, 2), (1, 2), (300, 2), (3000, 3), (3000, 200), (500, 1)):
        data = rng.integers(0, kinds, n).astype(np.uint8)
        if n == 3000:
            data[1000:1200] = data[200:400]
            data[2000:2100] = 1
        text = data.tobytes()
        order = S.suffix_array(data, depth=len(data) or 1).tolist()
        assert order == sorted(range(n), key=lambda i: text[i:])
        shared = S.common_prefixes(data, np.array(order, np.int64))
        for j in range(1, n):
            a, b = text[order[j - 1] : order[j - 1] + 50], text[order[j] : order[j] + 50]
            assert shared[j] == next((k for k in range(50) if k >= min(len(a), len(b)) or a[k] != b[k]), 50)


def test_windows_depend_on_their_bytes_alone():
    """Every window lies in one phrase, and its anchor is in the same place wherever it stands; also beyond 65,535 bytes."""
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 200_000).astype(np.uint8)
    data[150_000:150_500] = data[100:600]
    grams = S.gram_hashes(data)
    h, place, first, end = S.anchors(grams, np.ones(len(data) - 49, bool))
    assert first[0] == 0 and end[-1] == len(data) - 49 and (first[1:] == end[:-1]).all() and (end > first).all()
    assert ((place >= end - 1) & (place - first <= 25)).all() and (place[1:] != place[:-1]).all()
    of = np.repeat(np.arange(len(h)), end - first)
    for i in rng.integers(0, 450, 60).tolist():
        a, b = of[100 + i], of[150_000 + i]
        assert h[a] == h[b] and place[a] - (100 + i) == place[b] - (150_000 + i)
        ((h1,), (p1,), _, _) = S.anchors(grams[100 + i : 126 + i], np.ones(1, bool))
        assert h1 == h[a] and p1 == place[a] - (100 + i)
    assert 0.4 < (h < 1 << 47).mean() < 0.6  # ranges of hashes are equally full
    for w in (1, 2, 25, 50):
        (r,) = S.rolling(data[:500], (w,))
        assert len(r) == 501 - w and r[7] == S.rolling(data[7 : 7 + w], (w,))[0][0]


def test_packed_lists_come_back():
    rng = np.random.default_rng(7)
    anchor, phrase = np.sort(rng.integers(0, 1 << 48, 1000)).astype(np.uint64), rng.integers(0, 1 << 56, 1000).astype(np.uint64)
    ids, doc = np.sort(rng.integers(-(1 << 62), 1 << 62, 40)), rng.integers(0, 40, 1000)
    a, p, d = S.unpack(S.pack(anchor, phrase, doc, ids))
    assert (a == anchor).all() and (p == phrase).all() and (d == ids[doc]).all()
    assert all(len(x) == 0 for x in S.unpack(S.pack(anchor[:0], phrase[:0], doc[:0], ids)))
