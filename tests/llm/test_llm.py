"""The corpus operators against brute force, exact round trips and held-out rows, and on odd tables."""

import base64
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
from varistra.llm import common, decontaminate, html_text, line_dedup, minhash, mixing, order_minhash, quality, token_output, toxicity, warc  # noqa: E402
from varistra.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_ids int, toxicity string, mix_size int, u int"
ODD = [
    (None, None, None, None, None, 1, "x", 1, 1), (1, "", "en", None, 0, None, None, None, None), (2, " \t\n ", None, "s", 4, 1, "x", 1, 1),
    (3, "one", "en", "s", 3, 1, "x", 1, 1), (3, "one", "en", "s", 3, 1, "x", 1, 1), (3, "other words here", "en", "s", 3, 1, "x", 1, 1),
    (4, "Á b  c d\x85 e\r\nf 漢字 🙂 <|endoftext|>", "fr", "t", 9, 1, "x", 1, 1), (5, "a b c d e f g h " * 3000, "en", "t", 48000, 1, "x", 1, 1),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def prose(rng, n, words=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % words)


# ---------------------------------------------------------------- 1


def test_tokens_round_trip(spark, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    out = token_output.write_tokens(odd, f"file://{tmp_path}/t", path)
    got = [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in token_output.read_tokens(spark, out).orderBy("start").collect()]
    want = Counter((r[0], *whole.encode(r[1] or "", add_special_tokens=False).ids, 0) for r in ODD)
    assert Counter((d, *ids) for d, _, _, ids in got) == want
    assert [d for d, *_ in got] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x or 0))
    assert [s for _, s, _, _ in got] == [sum(len(x[3]) for x in got[:i]) for i in range(len(got))]
    crc = {(r.start, r.ids_crc32) for r in token_output.read_tokens(spark, out, digest=True).collect()}
    assert crc == {(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, _, ids in got}
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, f"file://{tmp_path}/e", path)).count() == 0


def test_workers_hand_freed_memory_back():
    """What an operator has freed doesn't stay with a worker that the next one uses, or that waits."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024

    start = held()
    common.worker_cache("first", 0, lambda: [bytes([i % 256]) * 4000 for i in range(40_000)])
    full, last = held(), [bytes(4000) for _ in range(100)]  # these lie behind and hold what is before them
    assert full - start > 100
    common.worker_cache("second", 0, list)
    assert held() - start < 50 and len(last) == 100


def test_token_tasks_hold_small_batches_and_give_back(spark, tmp_path):
    """Of 12 MB of texts a task gets 4 MB at a time, and tasks that count or write ids keep no encoder."""
    import public_tokenizers

    path, sizes, limit = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/sizes", "spark.sql.execution.arrow.maxBytesPerBatch"

    def seen(batches):
        for batch in batches:
            with open(sizes, "a") as f:
                print(batch.nbytes, file=f)
            yield batch

    docs = spark.range(48).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 40000) as text").coalesce(1).mapInArrow(seen, "doc_id long, text string")
    out = token_output.write_tokens(docs, f"file://{tmp_path}/t", path)
    with open(sizes) as f:
        assert max(map(int, f)) < 5 << 20
    assert spark.conf.get(limit, None) is None and token_output.read_tokens(spark, out).count() == 48
    spark.conf.set(limit, "1m")  # a session's own limit stays
    try:
        with common.small_batches(spark):
            assert spark.conf.get(limit) == "1m"
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)

    class Tokens:
        def filter(self, *_):
            return self

        def mapInArrow(self, run, _):
            common.worker_cache("tokens", path, dict)
            self.counted = [x for b in run([pa.RecordBatch.from_arrays([pa.array([np.array([0, 2, 5]).tobytes()])], ["counts"])]) for x in b.to_pylist()]
            return self

        select = groupBy = agg = filter

        def collect(self):
            return []

    tokens = Tokens()
    token_output.id_counts(tokens)
    assert tokens.counted == [{"id": 1, "n": 2}, {"id": 2, "n": 5}] and not common._WORKER


def test_cached_encoder_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, plain = token_output.CachedEncoder(path, cache_bytes=20_000), Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = [*" \n\t .,!'’s re tAbÉß  ᠎1२क中🙂\x1c\x85-#", "<|endoftext|>", "<|endof", "'re", "naïve"]
    for _ in range(80):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(50)]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert e(["<|endoftext|>"]) == [np.array([50256], e.dtype).tobytes()] and e.used <= 40_000
    long = "word, another-word\n" * 200_000
    assert np.frombuffer(e([long])[0], e.dtype).tolist() == plain.encode(long, add_special_tokens=False).ids


def test_slices_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 3, 100, 1, 1)] + [None])], ["t"])
    got = [x.column(0).to_pylist() for x in common.by_bytes(batch, 0, 8)]
    assert [y for x in got for y in x] == batch.column(0).to_pylist() and [len(x) for x in got] == [3, 1, 3]


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        x = (2 ** (rng.random(n) * 32)).astype(np.uint32)
        control, data = token_output.encode_ranks(x)
        assert len(control) == -(-n // 4)
        assert (token_output.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()


# ---------------------------------------------------------------- 2


def test_targets_reshare():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([0, 10], [3, 1], 1.5, 2.0) == pytest.approx([0, 15])
    assert mixing.targets([], [], 1.5, 2.0) == []


def test_fit_is_exact_where_a_sum_exists():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths, counts = np.unique(rng.integers(0, 40, 12)), None
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reach = {r + n * i for r in reach for i in range(c + 1)}
        got = mixing.fit(lengths, counts, budget, window=10)
        total = int((got * lengths).sum())
        assert (got <= counts).all() and total <= budget and budget - total <= max(lengths.max(), budget - max(r for r in reach if r <= budget))
        assert mixing.fit(lengths, counts, 0).sum() == 0


def test_mix(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, int(rng.integers(1, 60))), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sized(mixing.with_size(docs)).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.mix_size * r.mix_copies for r in own) - own[0].mix_target) <= 1 and max(r.mix_copies for r in own) <= 2
    again = mixing.mix_sized(mixing.with_size(docs.repartition(7))).collect()
    assert {(r.doc_id, r.mix_copies) for r in mixed} == {(r.doc_id, r.mix_copies) for r in again}
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0
    assert mixing.mix_sized(mixing.with_size(odd)).count() == len(ODD)


# ---------------------------------------------------------------- 3


def brute_kneser_ney(texts):
    """log p(gram) of an interpolated modified Kneser-Ney model, straight from its definition, over tuples of symbols."""
    n = quality.ORDER
    counts = {n: Counter()}
    for t in texts:
        x = [quality.START] * (n - 1) + list(t) + [quality.END]
        counts[n].update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    for k in range(n - 1, 0, -1):
        left, raw = defaultdict(set), Counter()
        for g, c in counts[k + 1].items():
            left[g[1:]].add(g[0])
            raw[g[1:]] += c
        counts[k] = Counter({g: raw[g] if g[0] == quality.START else len(left[g]) for g in left})
    spare = {k: quality.discounts([sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]) for k in counts}

    def p(g):
        k = len(g)
        if not k:
            return 1 / quality.SYMBOLS
        following = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not following:
            return p(g[1:])
        total = sum(following.values())
        d = lambda c: spare[k][min(c, 3) - 1]
        c = following.get(g, 0)
        return (c - d(c) if c else 0) / total + sum(map(d, following.values())) / total * p(g[1:])

    return p


def test_kneser_ney_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "en", prose(rng, 12, 20) + ("é\x02\x03" if i % 5 == 0 else "")) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    aside = {r.trusted_id for r in quality.trusted_ids(labels).filter("aside").collect()}
    assert 0 < len(aside) < 10
    p = brute_kneser_ney([t.encode() for i, _, t in rows if i < 20 and i not in aside])
    want, n = {}, quality.ORDER
    for i, _, t in rows:
        x = [quality.START] * (n - 1) + list(t.encode()) + [quality.END]
        logs = [np.log(p(tuple(x[j : j + n]))) for j in range(len(x) - n + 1)]
        want[i] = np.exp(-np.mean(logs))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i].perplexity == pytest.approx(want[i], rel=1e-4) for i in want)
    limit = max(got[i].perplexity for i in aside)
    assert all(got[i].threshold == limit and got[i].kept == (got[i].perplexity <= limit) for i in want)


def test_quality_keeps_unseen_good_text(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows = [(i, "en", prose(rng, 300)) for i in range(260)] + [(1000 + i, "en", "".join(chr(int(c)) for c in rng.integers(33, 126, 200))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)], LABELS)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert sum(got[i].kept for i in range(160, 260)) >= 90 and not any(got[1000 + i].kept for i in range(10))
    odd_rows = quality.classify(odd, labels).collect()
    assert len(odd_rows) == len(ODD) and all(r.kept for r in odd_rows if not r.n_bytes)
    assert quality.classify(empty, labels).count() == 0 and quality.classify(odd, labels.limit(0)).filter("kept").count() == len(ODD)


# ---------------------------------------------------------------- 4


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "http://c", "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "x" * 300_000), (7, "http://c", "<p>é</p>"), (8, "u", "alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    got = warc.deduplicate(pages, f"file://{tmp_path}/w").collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[(h or "").encode()].append(p)
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = [r for r in got if r.payload_digest == digest]
        assert len(own) == len(ids) and all(r.payload_bytes == len(payload) for r in own)
        best = max(ids, key=lambda x: (x is not None, x or 0))
        assert [r.page_id for r in own if r.record_type == "response"] == [best]
        assert all(r.refers_to == best for r in own if r.record_type == "revisit")
    assert warc.deduplicate(pages, f"file://{tmp_path}/m", min_bytes=10).filter("record_type = 'revisit'").count() == 1
    assert warc.deduplicate(pages.limit(0), f"file://{tmp_path}/e").count() == 0


# ---------------------------------------------------------------- 5


def brute_groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 8)
    rng = np.random.default_rng(5)
    rows, base = [], prose(rng, 120, 5000).split()
    for i in range(60):  # a group whose members are alike to different degrees
        w = list(base)
        for j in rng.integers(0, len(w), int(rng.integers(0, 12))):
            w[j] = f"x{int(rng.integers(1000))}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(rng, int(rng.integers(1, 50)), 3000)) for i in range(60)] + [(300, "Same  TEXT\n"), (301, "same text"), (302, ""), (303, None), (304, "one"), (305, "ONE")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert got == brute_groups(rows, k, 80)


def test_near_duplicates_odd(spark, odd, empty):
    got = minhash.near_duplicates(odd, 2).collect()
    assert len(got) == len(ODD) and all((r.doc_id is None) == (r.component_id is None) for r in got)
    assert minhash.near_duplicates(empty, 2).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.concatenate([a[:240], np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))])
    x, y, one = minhash.signatures([a, np.unique(b), a[:1]], 160)
    assert abs((x == y).mean() - 240 / 360) < 0.15 and len(set(one.tolist())) == 160
    assert (minhash.signatures([a], 160)[0] == x).all()


def test_components_of_path_and_hub(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000, 2001), (2000, 2001)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(40)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 6


def test_order_minhash(spark, odd, empty):
    rng = np.random.default_rng(4)
    a = prose(rng, 300, 2000)
    rows = [(9, a), (8, a), (7, a.replace("w1 ", "q ", 3)), (6, " ".join(a.split()[150:] + a.split()[:150])), (5, ""), (4, None), (None, "x y z")]
    got = {r.doc_id: r for r in order_minhash.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9].fingerprint == got[8].fingerprint and got[9].near_next == 1.0 and got[5].fingerprint == got[4].fingerprint
    assert got[8].near_next > 0.6 and got[7].near_next < got[8].near_next  # a moved half costs more than a few words
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest() and got[d].n_chars == len(t)
    assert order_minhash.compare_edited(odd).count() == len(ODD) and order_minhash.compare_edited(empty).count() == 0
    assert order_minhash.compare_edited(odd.filter("doc_id = 4")).first().near_next == 1.0


def test_occurrences_are_numbered(spark):
    df = spark.createDataFrame([("a a a a b",), ("a b",)], "t string").select(order_minhash.numbered(order_minhash.packed_kmers(F.col("t"), 1)).alias("x"))
    x, y = ([v >> order_minhash.PLACE for v in r.x] for r in df.collect())
    assert len(set(x)) == 5 and set(y) < set(x)


# ---------------------------------------------------------------- 7


def test_lines_equal_brute_force(spark, odd, empty):
    rng = random.Random(2)
    pool = [f"  Common LINE number {i} of the pool É" for i in range(6)] + ["short", "", "x" * 19, "y" * 20]
    rows = [(i, "\n".join(rng.choice(pool + [f"own line of document {i} and no other"]) for _ in range(rng.randint(1, 9)))) for i in range(30)] + [(40, None), (41, "")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    want = {}
    rows += [(50, "a line that stands in two documents only\nx")] * 2 + [(51, "a line that stands in two documents only"), (52, "z" * 25), (52, "z" * 25 + "\n" + "z" * 25), (None, "y" * 20)]
    for d, t in rows[-6:]:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    lowest = lambda d: -(1 << 63) if d is None else d
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)], key=lowest) == d]
        want[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == want
    assert line_dedup.dedup_lines(odd).count() == len(ODD) and line_dedup.dedup_lines(empty).count() == 0


# ---------------------------------------------------------------- 8


def test_toxicity_workers_map_the_model(spark, monkeypatch):
    """A worker holds no copy of the index that others have too; a store that can't be mapped gives the same scores."""
    from pyarrow import fs

    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, 40, 300) + (" awfulbad" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    uri = toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    model = toxicity.load(uri)
    index = model.examples.index
    with open("/proc/self/maps") as f:
        assert common.store(uri)[1] + ".arrays" in f.read()
    for held in (index.most, index.begin, *index.wide):
        assert held.nbytes and not held.flags.owndata and not held.flags.writeable
    texts = [r[1] for r in rows] + [None, "", "awfulbad"]
    scores = model.scores(texts)
    assert scores[-1][0] > 0.5 > scores[1][0]
    monkeypatch.setattr(common, "store", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("file:").lstrip("/")))
    assert toxicity.load(uri).scores(texts) == scores


def test_toxicity_held_out(spark, odd, empty):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 40, 300).replace("w", "word") + (" you awfulbad nastyword" if bad else " fine"), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((got[i].toxicity.score >= 0.5) == (i % 4 == 0) for i in held)
    assert not {e for r in got.values() for e in r.toxicity.evidence} & set(held)
    with pytest.raises(ValueError):
        toxicity.score(odd, labels)  # it has a column toxicity
    s = toxicity.score(odd, labels, column="found").drop("toxicity").withColumnRenamed("found", "toxicity")
    assert s.count() == len(ODD) and set(s.columns) == set(odd.columns)
    assert toxicity.score(empty, labels, column="f").count() == 0 and toxicity.score(odd, labels.limit(0), column="f").filter("f.score = 0").count() == len(ODD)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_block_max_search_is_exact(block, monkeypatch):
    monkeypatch.setattr(toxicity.BlockIndex.__init__, "__defaults__", (block,))
    rng = np.random.default_rng(7)
    rows = []
    for i in range(500):
        topic = 20 * int(rng.integers(3))  # three groups of texts with their own features, and rare ones
        at = tuple(sorted({*(topic + rng.choice(20, int(rng.integers(1, 6)), replace=False)).tolist(), 60 + int(rng.integers(80))})) + (140,)
        w = rng.random(len(at))
        rows.append((i, int(rng.integers(2)), 1.0, at, w / np.sqrt(w @ w)))
    e = toxicity.Examples(rows, 141)
    dense = np.zeros((500, 141))
    for i, _, _, at, w in rows:
        dense[i, list(at)] = w
    assert sorted(e.index.names.tolist()) == list(range(len(e.ids))) and np.diff(e.index.edges).max() <= block
    for i, _, _, at, w in rows[:80]:
        exact = np.sort(dense @ dense[i])[::-1]
        (names, cosines), _ = e.nearest([toxicity.Query(e.index, at, w), toxicity.Query(e.index, *rows[499 - i][3:])], 15)
        assert np.allclose(cosines[:15], exact[:15], atol=1e-5) and len(names) >= 15
        assert e.ids[names[0]] == i


def test_search_and_index_hold_little():
    """Many texts asked at once take no more memory than a slice of postings, and an index is built block by block."""
    rng = np.random.default_rng(8)
    width, rows = 6000, []
    for i in range(1000):
        at = np.append(np.sort(rng.choice(width - 1, 400, replace=False)), width - 1).astype(np.int32)
        w = (rng.random(401) + 0.01).astype(np.float32)
        rows.append((at, w / np.sqrt(w @ w)))
    tracemalloc.start()
    try:
        index = toxicity.BlockIndex(rows, width)
        held, most = tracemalloc.get_traced_memory()
        assert most - held < 3 * held
        queries = [toxicity.Query(index, *r) for r in rows[:512]]
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        near = index.near(0, queries)
        assert tracemalloc.get_traced_memory()[1] - held < 30e6
    finally:
        tracemalloc.stop()
    names = index.names[index.edges[0] : index.edges[1]]
    dense = np.zeros((1000, width))
    for i, (at, w) in enumerate(rows):
        dense[i, at] = w
    assert np.allclose(near, dense[:512] @ dense[names].T, atol=1e-6)


def test_words_are_runs_of_letters():
    odd = ["", "Ab1c_d", "Straße İstanbul ΑΣ ς", "x²y Ⅷ ½ 五 ٣ a\u0301b", "co-op\u00a0it's\x00e\u2003f", "日本語 テスト", "\U0001d400b🙂c"]
    for text in [*odd, *(r[1] for r in ODD), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))]:
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", (text or "").lower())


def test_votes_are_weighted_by_distance():
    rows = [(1, 1, 1.0, (0, 2), np.array([0.8, 0.6])), (2, 0, 1.0, (1, 2), np.array([0.8, 0.6])), (3, 0, 0.5, (2,), np.array([1.0]))]
    e = toxicity.Examples(rows, 3)
    share, names, cosines = e.votes_of([((0, 2), np.array([0.8, 0.6]))], 3)[0]
    c = {1: 1.0, 2: 0.36, 3: 0.6}
    votes = {i: x**toxicity.POWER for i, x in c.items()}
    assert e.ids[names].tolist() == [1, 3, 2] and np.allclose(cosines, [1.0, 0.6, 0.36])
    assert share == pytest.approx(votes[1] / (votes[1] + votes[2] + 2 * votes[3]))


# ---------------------------------------------------------------- 9


def test_main_text(spark):
    body = "<h1>Head &amp; more</h1><p>Some  words\nhere <b>bold</b>er.<br>Next</p><p>One</p><div class='comments'><p>I disagree with all of this text</p></div><form>Your name<input></form>"
    page = f"<html><head><title>Head</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- x --><div class='ad'>Buy this thing now</div><article>{body}</article><aside>See also these other pages</aside><footer>&copy; us</footer></body>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain <b"), (5, "u", page), (None, "u", "<p>x")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == got[5] == "Head & more\nSome words here bolder. Next\nOne"
    assert got[2] == got[3] == "" and got[None] == "x" and got[4].startswith("plain")
    assert html_text.extract(pages.limit(0)).count() == 0
    clash = pages.selectExpr("page_id", "url", "html", "html as text", "1 as n_chars")
    assert {r.page_id: r.text for r in html_text.extract(clash).collect()} == got


def test_inline_names_drop_nothing():
    page = '<h1>T</h1><p>Header of the text <span class="header-note">kept</span> more words here</p>'
    assert html_text.main_text(page, {}) == "T\nHeader of the text kept more words here"


@pytest.fixture(scope="module")
def learnt(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return html_text.learn(spark.read.parquet(path))


LAST = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize(
    "body,want",
    [
        (f'<h1>T</h1><p>Read the <a href="/r">full report</a> today.</p><p>{LAST}</p>', f"T\nRead the full report today.\n{LAST}"),
        (f"<p>First of all</p><ul><li>this item</li><li>and <a href='/x'>that</a></li></ul><p>{LAST}</p>", f"First of all\nthis item\nand that\n{LAST}"),
        (f'<p>First of all some words</p><div class="ad">Buy <a href="/b">this</a> now, please do</div><p>{LAST}</p>', f"First of all some words\n{LAST}"),
        (f"<p>First of all some words</p><form><label>Name</label><input><button>Go on</button></form><p>{LAST}</p>", f"First of all some words\n{LAST}"),
        (f"<p>First of all some words</p><header><ul><li><a href='/'>Up</a></li></ul></header><p>{LAST}</p>", f"First of all some words\n{LAST}"),
        (f'<p class="reply">A reply of his</p><div class="share-price">42 euros a share</div><div id="related-work">Others did so</div><div class="form-of-government">A republic</div><p>{LAST}</p>', f"A reply of his\n42 euros a share\nOthers did so\nA republic\n{LAST}"),
        (f"<table><tr><th>Year</th><td>Sum</td></tr></table><blockquote><p>Quoted words</p></blockquote><div class='site-footer'>No</div><div class='cookie-banner'>No</div><p>{LAST}</p>", f"Year\nSum\nQuoted words\n{LAST}"),
    ],
)
def test_articles_keep_links_lists_and_what_follows(learnt, body, want):
    """With learnt weights: nothing within an article but its excluded blocks is lost, and nothing around it comes in."""
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav><div class='ad'>Buy it</div><article>{body}</article><div class='comments'><p>I disagree</p></div><footer>Us</footer></body></html>"
    assert html_text.main_text(page, learnt) == want


def test_best_run_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        best = max([0.0, *(sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1))])
        a, b = html_text.best_run(x)
        assert sum(x[a:b]) == best and (best > 0 or (a, b) == (0, 0))


@pytest.mark.parametrize("page", ['<a "' * 20_000, "<a \"'x" * 20_000 + ">", "<div>" * 20_000 + "</b></section>" * 20_000, "<script " * 20_000, "<" * 100_000 + ">", "<!--" * 30_000, "<p>word " * 50_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page, {})
    assert time.process_time() - began < 10
    assert list(html_text.pieces("a < b <p class='>'>c")) == [("a ",), ("<",), (" b ",), ("", "p", " class='>'"), ("c",)]


# ---------------------------------------------------------------- 10


def test_leaks_equal_brute_force(spark, odd, empty):
    rng = np.random.default_rng(8)
    items = [(i, prose(rng, int(rng.integers(12, 40)), 4000) + ". " + prose(rng, 10, 4000) + ".") for i in range(40)] + [(90, None), (91, "too short"), (None, prose(rng, 20, 4000))]
    rows = []
    for i in range(120):
        own = [prose(rng, int(rng.integers(0, 120)), 4000)]
        planted = [int(x) for x in rng.choice(40, int(rng.integers(0, 3)), replace=False)] if i % 3 == 0 else []
        for p in planted:
            own += [items[p][1].upper() if i % 2 else items[p][1], prose(rng, 30, 4000)]
        rows.append((i, " ".join(own), sorted(planted)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {d: p for d, _, p in rows}
    out = decontaminate.contaminated(odd, bench, column="found")
    assert out.count() == len(ODD) and set(out.columns) == {*odd.columns, "found"}
    assert decontaminate.contaminated(empty, bench, column="found").count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).filter("size(item_ids) > 0").count() == 0


def test_shards_and_short_items_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(11)
    items = [(i, prose(rng, int(rng.integers(9, 40)), 300)) for i in range(60)] + [(100 + i, f"capital{i} of land{i}? City{i}.") for i in range(8)]
    rows = []
    for i in range(150):
        own = items[i % 60][1].split()
        rows.append((i, prose(rng, 30, 300) + " " + " ".join(own[: int(rng.integers(4, len(own) + 1))]) + (f" Capital{i % 8} of land{i % 8}? city{i % 8}" if i % 7 == 0 else "")))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()}
    assert all((100 + i % 8 in whole[i]) == (i % 7 == 0) for i in whole)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2500)
    assert {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()} == whole
    without = {r.doc_id: [x for x in r.item_ids if x < 100] for r in decontaminate.contaminated(docs, bench.filter("item_id < 100")).collect()}
    assert without == {i: [x for x in v if x < 100] for i, v in whole.items()}
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs.withColumn("item_ids", F.lit(1)), bench)


def bm25_leaks(text, items, threshold=0.5, k1=1.2, b=0.75):
    """Items that a text leaks, from the definition: every window scores every item, no index."""
    split = lambda t: "".join(c for c in t.lower() if c not in ".,;:!?\"'()[]").split()
    sets = {i: split(t) for i, t in items}
    n, mean, longest = len(sets), sum(map(len, sets.values())) / len(sets), max(map(len, sets.values()))
    df = Counter(w for x in sets.values() for w in set(x))

    def weight(w, x):
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * (k1 + 1) / (x.count(w) + k1 * (1 - b + b * len(x) / mean))

    def share(part, passage, k):
        grams = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
        return len(grams & {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}) / len(grams)

    words, out = split(text), set()
    for begin in range(0, len(words), longest):
        passage = words[begin : begin + 2 * longest]
        for i, t in items:
            x = sets[i]
            score = sum(weight(w, x) for w in set(x) & set(passage)) / sum(weight(w, x) for w in set(x))
            if len(x) < 8:
                good = any(passage[j : j + len(x)] == x for j in range(len(passage)))
            else:
                cut = max((j for j in range(len(t) - 2) if t[j] in ".!?"), default=-1) + 1
                question, answer = (split(t[:cut]), split(t[cut:])) if cut else (x, x)
                good = share(question, passage, min(5, len(question))) >= 0.5 and share(sorted(set(answer)), sorted(set(passage)), 1) >= 0.5
            if score >= threshold - 1e-9 and good:
                out.add(i)
    return sorted(out)


def test_leaks_equal_plain_bm25(spark, monkeypatch):
    rng = np.random.default_rng(12)
    items = [(i, prose(rng, int(rng.integers(8, 30)), 200) + "? " + prose(rng, int(rng.integers(1, 6)), 200) + ".") for i in range(30)]
    items += [(50 + i, prose(rng, int(rng.integers(3, 7)), 2000)) for i in range(10)]
    rows = []
    for i in range(120):
        own = items[i % 40][1].split()
        rows.append((i, prose(rng, 60, 200) + " " + " ".join(own[int(rng.integers(0, 3)) : int(rng.integers(1, len(own) + 1))]) + " " + prose(rng, int(rng.integers(0, 60)), 200)))
    want = {i: bm25_leaks(t, items) for i, t in rows}
    assert 20 < sum(map(len, want.values())) and sum(not v for v in want.values()) > 10
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 700):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        assert {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()} == want


def test_pruning_loses_nothing():
    rng = np.random.default_rng(9)
    items = [(i, prose(rng, 30, 300), None) for i in range(50)]
    index = decontaminate.Index(items, 0.5)
    for i in range(60):
        text = prose(rng, 40, 300) + " " + " ".join(items[i % 50][1].split()[: int(rng.integers(5, 30))])
        words = decontaminate.words_of(text)
        best = defaultdict(float)
        half = index.window // 2
        for a in range(0, max(1, len(words)), half):
            terms = {index.ids[w] for w in words[a : a + index.window] if w in index.ids}
            for at, impact in enumerate(index.impacts):
                s = sum(x for t, x in impact.items() if t in terms)
                if s >= 0.5 - 1e-9 and index.overlaps(at, words[a : a + index.window]):
                    best[at] = max(best[at], s)
        assert dict(index.search(text)) == pytest.approx(dict(best))


# ---------------------------------------------------------------- pipeline and queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline as pipeline

    docs, d = odd.withColumn("mix_key", F.lit("own")).withColumn("mix_copies", F.lit(7)), "/root/testdata/sf0.001"
    for name, stage in pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, d), name)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).count() == 0
        if name == "near_duplicates":
            assert out.count() == len(ODD) - 1  # of two equal rows one stays
        docs = out
    assert docs.filter("mix_key = 'own' and mix_copies = 7").count() == docs.count() > 0
    assert [c for c in pipeline.STAGES[-1][1](spark, docs, d).columns] == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_blank_texts_are_never_toxic(spark, tmp_path):
    """Also where labelled rows without text are toxic."""
    import corpus_pipeline as pipeline

    rows = [(i, None if i % 4 else " \n", "en", "s", 0) for i in range(80)] + [(100 + i, f"kind words number {i} here", "en", "s", 0) for i in range(40)]
    spark.createDataFrame([(r[0], 1, int(r[0] < 100)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = pipeline.without_toxic(spark, docs, str(tmp_path))
    assert kept.filter("doc_id < 100").count() == 80


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
