"""The audits of sources and filters against brute force, and on odd tables."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("zstandard")
from varistra.llm import divergence, filter_audit  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, rank int, value string, mask int, id int, cells int"
ODD = [
    (None, None, None, None, 1, "x", 1, 1, 1), (1, "", "en", None, 1, None, None, None, None), (2, " \t\n ", None, "s", 1, "x", 1, 1, 1), (3, "Ünder ünder UNDER", "en", "", 1, "x", 1, 1, 1),
    (3, "Ünder ünder UNDER", "en", "", 1, "x", 1, 1, 1), (4, "a b C$ " * 4000, "en", "t", 1, "x", 1, 1, 1), (5, "Ünder ünder UNDER", "en", "t", 1, "x", 1, 1, 1), (6, "漢字 漢字　x y", "en", "s", 1, "x", 1, 1, 1), (7, None, "en", "s", 1, "x", 1, 1, 1),
]


def sample(seed, n, langs=("en", "fr"), sources=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = int(rng.integers(sources))
        words = [f"w{chr(97 + int(x) % 26)}{'é' * (int(x) // 26 % 3)}" if int(x) % 7 else f"W{chr(65 + s)}" for x in rng.zipf(1.4, int(rng.integers(0, 300))) % 120]
        rows.append((i, "\n".join(words) if i % 3 else " ".join(words), langs[i % len(langs)], f"s{s}"))
    return rows


# ---------------------------------------------------------------- 12


def audit_by_hand(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in seen.items()}
    for lang, source, words in docs:
        count[lang, source].update(t for t in words if t in kept[lang])
    p = {}
    for (lang, source), c in count.items():
        total = sum(c.values()) + len(kept[lang])
        p[lang, source] = {t: 1 + 10**9 * (c[t] + 1) // total for t in kept[lang]}
    whole = {}
    for lang in kept:
        c = sum((x for (k, _), x in count.items() if k == lang), Counter())
        whole[lang] = {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang])) for t in kept[lang]}
    f = lambda a, b: (a - b) * (a - b) // b
    out = set()
    for lang, source in count:
        mine = p[lang, source]
        pairs = [(sum(f(mine[t], q[t]) for t in mine), s) for (k, s), q in p.items() if k == lang and s != source]
        terms = [(f(x, whole[lang][t]), t) for t, x in mine.items() if count[lang, source][t] and x > whole[lang][t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(ranked[: top if part == "term" else None])}
    return out


@pytest.mark.parametrize("sources,block,shard", [(1, 64, 1 << 16), (5, 64, 1 << 16), (6, 2, 40), (9, 3, 11), (7, 1, 30)])
def test_divergence_equals_brute_force(spark, monkeypatch, sources, block, shard):
    """One block and many, an odd and an even number of them, one shard and many."""
    monkeypatch.setattr(divergence, "MOST_BLOCK", block)
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    rows = sample(sources, 120, sources=sources)
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = audit_by_hand(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_divergence_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 2)
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = divergence.audit(odd).collect()
    assert {tuple(r) for r in got} == audit_by_hand(ODD) and got
    assert divergence.audit(odd.limit(0)).count() == 0


def test_every_pair_of_blocks_meets_once(spark):
    from pyspark.sql import functions as F

    for blocks in range(2, 12):
        pairs = spark.createDataFrame([(i, j) for i in range(blocks) for j in range(i + 1, blocks)], "i int, j int")
        turn, host = divergence.meeting(F.col("i"), F.col("j"), F.lit(blocks))
        met = pairs.select("i", "j", turn.alias("t"), host.alias("h")).collect()
        assert all(r.h in (r.i, r.j) and 0 <= r.t < blocks + blocks % 2 - 1 for r in met)
        busy = Counter((r.t, b) for r in met for b in (r.i, r.j))
        assert max(busy.values()) == 1  # in a round a block meets one other


def test_shares_and_sums_are_exact():
    rng = np.random.default_rng(4)
    for total in (1, 7, 10**6 + 3, 2 * 10**14):
        n = np.minimum(rng.integers(0, 1 << 47, 200), total - 1)
        assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in n]
    ids = np.unique(rng.integers(0, 1 << 16, 500))
    n = rng.integers(1, 1 << 50, len(ids))
    assert all((a == b).all() for a, b in zip(divergence.unpack(divergence.pack(ids, n)), (ids, n)))


# ---------------------------------------------------------------- 13


def filters_by_hand(rows, labels):
    first = {}
    for i, text, *_ in rows:
        k = -math.inf if i is None else i
        first[text or ""] = min(first.get(text or "", math.inf), k)
    good, toxic = ({i for i, q, t in labels if (q, t)[at] == 1} for at in (0, 1))
    cells = defaultdict(list)
    for i, text, _, source, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (-math.inf if i is None else i) > first[t]}
        cells[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in cells.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = list(docs), []
            for step, x in enumerate(order, 1):
                removed, left = [d for d in left if d[0][x]], [d for d in left if not d[0][x]]
                out[part, order, step] = [len(left), len(removed), sum(d[0][x] for d in gone), sum(d[0][x] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)]
                gone += removed
                shapley[x] += len(removed)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filters_equal_brute_force(spark):
    rows = [r[:4] for r in sample(3, 60)] + [(100 + i, text, "en", "s1" if i % 2 else None) for i, (_, text, *_) in enumerate(sample(3, 12))]
    rows += [(200, "One two# " * 150, "en", "s1"), (201, "word" + " x" * 199, "en", "s2"), (202, " ".join(f"v{i // 2}" for i in range(200)), "en", "s2"), (203, "AB" + "c" * 98, "en", "s2"), (204, "ABC" + "c" * 97, "en", "s2")]
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 210, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    got = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == filters_by_hand(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_filters_on_odd_rows(spark):
    odd, labels = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd, labels).collect()
    want = filters_by_hand(ODD, [(3, 1, 0), (4, 0, 1)])
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want
    assert filter_audit.audit(odd.limit(0), labels).count() == 0 and filter_audit.audit(odd, labels.limit(0)).count() == len(want)
