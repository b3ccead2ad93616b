"""The corpus operators leave nothing of their inputs out."""

import numpy as np
from pyspark.sql import functions as F

from varistra.llm import decontaminate, toxicity


def test_rare_toxic_words_count(spark):
    """A word in 6 of 500 toxic rows decides, though 400 common words tell the labels apart better."""
    rng = np.random.default_rng(11)
    rare = ["".join(rng.choice(list("bcdfgklmnprst"), 9)) for _ in range(12)]
    signs = ["".join(rng.choice(list("aeioubdg"), 8)) for _ in range(400)]
    neutral = ["".join(rng.choice(list("stuvwxyz"), 8)) for _ in range(300)]
    rows, want = [], {}
    for i in range(1100):
        bad = i % 2 == 0
        slur = rare[i // 2 % 12] if bad and i % 14 == 0 else None
        words = list(rng.choice(neutral, 30)) + (list(rng.choice(signs, 12)) if bad and not slur else []) + ([slur] if slur else [])
        rows.append((i, " ".join(words), int(bad)))
        if slur:
            want[i] = slur
    docs = spark.createDataFrame(rows + [(5000 + j, " ".join([*rng.choice(neutral, 30), w]), 1) for j, w in enumerate(rare)], "doc_id long, text string, toxic int")
    labels = docs.filter("doc_id < 5000").select("doc_id", F.lit(1).alias("quality"), "toxic")
    features = {f for f, _, _ in toxicity.select_features(toxicity.labelled_sample(docs, labels))}
    assert set(rare) <= features and len(features) > 700
    got = {r.doc_id: r.toxicity.score for r in toxicity.score(docs.select("doc_id", "text"), labels).filter("doc_id >= 5000").collect()}
    assert len(got) == 12 and all(s >= 0.5 for s in got.values())


def test_cosines_over_many_places_equal_dense():
    """More than 384 places, common and rare ones: every cosine is that of the dense vectors."""
    rng = np.random.default_rng(12)
    width, rows = 3000, []
    dense = np.zeros((400, width))
    for i in range(400):
        at = np.unique(np.concatenate([rng.choice(30, 12, replace=False), rng.choice(width - 1, 60), [width - 1]]))
        dense[i, at] = rng.random(len(at)) + 0.01
        dense[i] /= np.sqrt(dense[i] @ dense[i])
        rows.append((i, int(rng.integers(2)), 1.0, at, dense[i, at]))
    examples = toxicity.Examples(rows, width)
    for i in range(40):
        exact = dense @ dense[i]
        ((names, cosines),) = examples.nearest([toxicity.Query(examples.index, rows[i][3], rows[i][4])], 15)
        assert np.allclose(np.sort(cosines)[::-1][:15], np.sort(exact)[::-1][:15], atol=1e-5)
        assert np.allclose(cosines, exact[examples.ids[names]], atol=1e-6)


def test_short_items_leak_whole(spark):
    """Items of fewer than eight words, with and without spaces, leak where all of them stands and nowhere else."""
    items = [(1, "What is the capital of France? Paris."), (2, "日本の首都はどこですか。東京です。"), (3, "Hello there"), (4, None), (5, " . "), (6, "one two three four five six seven eight nine. ten eleven twelve.")]
    docs = [
        (1, "quiz: what is  the capital\nof FRANCE? Paris! next", [1]), (2, "what is the capital of france? lyon, not paris", []), (3, "昔、日本の首都はどこですか。\n東京です。と言った", [2]), (4, "日本の首都はどこですか。京都です。", []),
        (5, "oh hello there again", [3]), (6, "othello there, hello therein", []), (7, "say one two three four five six seven eight nine. ten eleven twelve. hello there", [3, 6]), (8, None, []), (9, "", []), (10, "hello", []),
    ]
    got = decontaminate.contaminated(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: list(r.item_ids) for r in got} == {d: x for d, _, x in docs}
