import zlib

import numpy as np

from denspark.llm.language import RUN_UP, STRETCH, Network, identify


def test_languages_of_unseen_documents(spark):
    words = {"en": "the and of with that from this was".split(), "de": "der und die nicht für größe über schön".split(), "fr": "le très être où déjà ça même élève".split()}
    rows = [(i, lang, " ".join(own[(i * 7 + j * j) % 8] for j in range(5 + i % 40))) for i in range(360) for lang, own in [list(words.items())[i % 3]]]
    rows += [(1000, None, "der und die nicht"), (1001, "en", None), (1002, "en", "12 34 !!"), (1003, "en", ""), (None, "en", "the and of")]
    found = identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    got = {r.row.doc_id: r for r in found.collect()}
    truth = {i: lang for i, lang, _ in rows[:360]}
    for i, r in got.items():
        if i is not None:
            assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert sum(got[i].lang_pred == lang for i, lang in truth.items()) >= 0.97 * len(truth)
    assert got[1000].lang_pred == "de" and [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[None].lang_pred == "en"


def test_without_labels_and_empty(spark):
    found = identify(spark.createDataFrame([(1, None, "abc"), (2, None, None)], "doc_id long, lang string, text string")).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert identify(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_slopes_against_differences():
    network = Network(["a", "b", "c"])
    network.weights = [w.astype(np.float64) for w in network.weights]
    r = np.random.default_rng(2)
    part, labels = r.integers(0, 5, (9, 6)).astype(np.uint8) + 95, np.array([0, 1, 2, 0, 1, 2])
    part[6:, 2] = 0
    _, slopes = network.slopes(part, labels)
    for k, w in enumerate(network.weights):
        places = np.argwhere(np.abs(slopes[k]) > 1e-6)
        for place in map(tuple, places[r.permutation(len(places))[:12]]):
            had, values = w[place], []
            for step in (1e-5, -1e-5):
                w[place] = had + step
                values.append(network.slopes(part, labels)[0])
            w[place] = had
            assert abs((values[0] - values[1]) / 2e-5 - slopes[k][place]) < 1e-6


def test_documents_are_read_whole_and_alone():
    network = Network(["a", "b"])
    network.prepare()
    texts = [b"x" * 1000 + b"yz" * 37, b"abc", b"", b"q" * STRETCH, b"r" * (STRETCH + 1)]
    offsets = np.cumsum([0, *map(len, texts)])
    together, _ = network.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, text in enumerate(texts):
        alone, _ = network.documents(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert np.allclose(alone[0], together[i], atol=1e-6)
        if text and len(text) <= STRETCH:  # one stretch: the states of plain passes from either end
            p = network.positions(np.frombuffer(text, np.uint8)[:, None])
            assert np.allclose(p[:, :, 0].mean(axis=0), alone[0], atol=1e-6)
    assert RUN_UP > 0


def test_repeats_clashing_names_and_a_long_text(spark):
    rows = [(i, "en" if i % 2 else "de", ("the and of " if i % 2 else "der und die ") * 9, i) for i in range(60)]
    rows += [(7, "en", "the and of " * 9, 7), (99, None, "der und die nicht " * 20_000, 1)]
    found = identify(spark.createDataFrame(rows, "doc_id long, lang string, text string, score int")).collect()
    assert len(found) == 62 and {r.lang_pred for r in found if r.row.doc_id == 99} == {"de"}
    assert len({(r.lang_pred, r.score) for r in found if r.row.doc_id == 7}) == 1 and all(r.row.score is not None for r in found)
