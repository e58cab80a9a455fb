import random

import pytest

from denspark.llm.substrings import remove_repeats


def brute(docs, width):
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("width", [20, 8, 3])
def test_matches_brute_force(spark, width):
    r = random.Random(9)
    word = lambda: r.choice("abcdefghij") + r.choice("klmn")
    parts = [[word() for _ in range(r.randint(5, 60))] for _ in range(15)]
    docs = [(i, " ".join(w for _ in range(r.randint(1, 4)) for w in r.choice(parts) + [word() for _ in range(r.randint(0, 9))])) for i in range(60)]
    docs += [(100, "a " * 90), (101, "a b " * 70), (102, "a b c " * 40), (103, ""), (104, None), (105, docs[0][1]), (106, "z " * 19)]
    found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), min_words=width, as_is=False)
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in found.collect()} == brute(docs, width)


def test_nulls_repeats_and_clashing_names(spark):
    text = " ".join(str(i) for i in range(30))
    rows = [(None, text, 1), (1, text, 2), (1, text, 3), (2, text, 4), (3, "x  y", 5)]
    found = sorted((r.row.run, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, run int")).collect())
    assert found == [(1, 0, text), (2, 0, text), (3, 0, text), (4, 30, ""), (5, 0, "x  y")]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
