import itertools
import random
import re

import pytest

from denspark.llm import jaccard
from denspark.llm.jaccard import similar_documents


def brute(docs, percent=80, k=5):
    sets = []
    for _, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    return {d[0]: (len(sets[i]), min(docs[j][0] for j in range(len(docs)) if root[j] == root[i])) for i, d in enumerate(docs)}


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    passage = [word() for _ in range(40)]
    docs = []
    for group in range(12):
        base = [word() for _ in range(r.randint(8, 160))] + (passage if group % 3 == 0 else [])
        for _ in range(r.randint(1, 9)):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = word()
            docs.append(" ".join(own))
    docs += ["", None, "  ", "One two", "one  TWO", "one", docs[0], docs[5].upper()] + [" ".join(passage)] * 30
    r.shuffle(docs)
    return [(3 * i + 1, d) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("percent", "block"), [(80, 1024), (80, 4), (60, 8)])
def test_components_match_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = similar_documents(frame, percent=percent).select("row.doc_id", "n_shingles", "component_id").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, percent)


def test_sets_are_joined_when_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_BYTES", -1)
    docs = corpus()[:60]
    found = similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "n_shingles", "component_id").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (3, None, None)]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string, vertex int"))
    assert sorted((r.row.doc_id or 0, r.component_id) for r in found.collect()) == [(0, 2), (2, 2), (2, 2), (3, 3)]
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_copies(count, seed=6):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    docs = []
    for i in range(count):
        own = list(base)
        for place in r.sample(range(150), r.randint(1, 4)):
            own[place] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    return docs


def test_links_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    made = []
    for name in ("links", "verify"):
        inner = getattr(jaccard._Join, name)
        monkeypatch.setattr(jaccard._Join, name, lambda self, *a, inner=inner: made.append(inner(self, *a)) or made[-1])
    seen = {}
    for count in (150, 300, 600):
        made.clear()
        docs = near_copies(count)
        found = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "component_id").collect()}
        seen[count] = sum(x.count() for x in made)
        assert seen[count] < 8 * count
        if count == 150:
            assert found == {k: v[1] for k, v in brute(docs).items()}
    assert seen[600] < 6 * seen[150]


def test_a_very_long_text_and_its_near_copy(spark):
    long = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-3000])), (3, " ".join(long[30_000:])), (4, "short text of a few words only")]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == [(1, 59996, 1), (2, 56996, 1), (3, 29996, 3), (4, 3, 4)]
