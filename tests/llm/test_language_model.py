import math
import zlib
from collections import Counter

import numpy as np
import pytest

from denspark.llm.language_model import best_classes, exchange, score_documents


def corpus():
    r = np.random.default_rng(2)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    docs = []
    for i in range(300):
        side = left if i % 2 else right
        docs.append((i, " ".join(side[int(x)] for x in r.integers(0, 30, r.integers(1, 40)))))
    return docs + [(900, ""), (901, None), (902, "Unseen L1 words")]


@pytest.mark.parametrize("listed", [1 << 17, 20])
def test_base_is_exact_and_the_model_better(spark, listed):
    docs = corpus()
    found = {r.doc_id: r for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), clustered=40, classes=4, listed=listed).select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()}
    tokens = {i: (t or "").lower().split() + ["</s>"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    apart = [i for i in tokens if held[i] and i < 900]
    assert sum(found[i].score for i in apart) > sum(found[i].base_score for i in apart)


def test_partitions_do_not_matter(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = [{r.doc_id: r.score for r in score_documents(frame.repartition(n), clustered=20, classes=4).select("row.doc_id", "score").collect()} for n in (1, 100)]
    assert found[0].keys() == found[1].keys()
    assert all(math.isclose(x, found[1][i], rel_tol=1e-9) for i, x in found[0].items())


def test_words_beyond_the_seeds_are_clustered(spark):
    """Words share all their endings; their neighbours alone tell which of two kinds of document they are from."""
    r = np.random.default_rng(4)
    docs, ideal = [], {}
    for i in range(800):
        side, seed = "ab"[i % 2], r.random(20) < 0.7
        docs.append((i, " ".join(f"{side}{int(r.integers(0, 5))}seed" if x else f"{side}{int(r.integers(0, 30)):02}word" for x in seed)))
        ideal[i] = float(np.where(seed, np.log10(0.7 / 5), np.log10(0.3 / 30)).sum() + 20 * math.log10(20 / 21) + math.log10(1 / 21) + math.log10(0.5))
    found = score_documents(spark.createDataFrame(docs, "doc_id long, text string"), clustered=10, classes=2).where("held_out").select("row.doc_id", "n_tokens", "score").collect()
    assert len(found) > 40
    assert sum(q.score - ideal[q.doc_id] for q in found) > -0.05 * sum(q.n_tokens for q in found)


def test_exchanged_in_as_exchange_would():
    table = np.array([[0.0, 50], [40, 0]])
    assert best_classes(table, np.array([[9.0, 0], [0, 9]]), np.array([[8.0, 0], [0, 8]])).tolist() == [1, 0]


def test_exchange_separates_what_never_meets():
    bigrams = np.zeros((8, 8))
    bigrams[:4, :4] = bigrams[4:, 4:] = 5
    of = exchange(bigrams, 2)
    assert len(set(of[:4])) == len(set(of[4:])) == 1 and of[0] != of[4]


def test_empty_and_untrained(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


def test_repeats_clashing_names_and_long_words(spark):
    rows = [(i, "a b c " * 5 + "=" * 500, 1) for i in range(1, 30)] + [(5, "a b c " * 5 + "=" * 500, 1), (None, "a", 1), (77, "word " * 50_000, 1)]
    found = score_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)).collect()
    assert len(found) == len(rows)
    twice = [(r.held_out, r.n_tokens, r.base_score, r.score) for r in found if r.row.doc_id == 5]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1]) and twice[0][1] == 17
    assert [r.n_tokens for r in found if r.row.doc_id == 77] == [50_001] and all(r.held_out for r in found if r.row.doc_id is None)


def test_a_class_s_probabilities_sum_to_one(spark):
    """Scores of one-word documents: with the start's transitions, words and unseen ones share out each class."""
    docs = corpus()
    words = sorted({w for _, t in docs for w in (t or "").lower().split()})
    asked = [(10_000 + i, w) for i, w in enumerate([*words, "never"])]
    held = [(i, w) for i, w in asked if True]
    frame = spark.createDataFrame(docs + held, "doc_id long, text string")
    found = {r.doc_id: r.score for r in score_documents(frame, clustered=40, classes=4).select("row.doc_id", "score").collect()}
    assert all(found[i] < 0 for i, _ in asked)
    assert sum(10 ** found[i] for i, _ in asked) < 1  # each has an end after it as well
