"""The stages on a small corpus, each against its own rule."""

import corpus_pipeline
from denspark.storage import written


def test_stages_chain(spark, tmp_path):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    passage = " ".join(word(i) for i in range(50000, 50060))
    item = " ".join(word(i) for i in range(60000, 60030))
    text = lambda a, n=120: " ".join(word(a * 131 + i) for i in range(n))
    rows = [(i, text(i), "en", "s", 0) for i in range(20)]
    rows += [(30, text(3) + " more", "en", "s", 0), (31, text(40) + " " + passage, "en", "s", 0), (32, text(41) + " " + passage, "en", "s", 0), (33, text(42) + " " + item, "en", "s", 0), (34, "123 456", None, "s", 0), (35, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first, second, third, fourth = kept.values()
    assert not {34, 35} & set(first) and set(range(20)) <= set(first)
    assert 30 not in second and set(second) == set(first) - {30}
    assert third[31].endswith(passage) and third[32] == text(41)
    assert set(fourth) == set(third) - {33}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(fourth)


def test_rows_are_kept_by_component_not_by_id(spark):
    text = lambda a: " ".join(f"w{a}x{i}" for i in range(80))
    rows = [(1, text(1)), (1, text(2)), (2, text(1) + " more"), (None, text(3)), (None, text(3)), (None, text(3) + " more"), (None, text(1)), (5, text(4)), (5, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted((r.doc_id or 0, r.text.split()[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert found == [(0, "w3x0"), (1, "w1x0"), (1, "w2x0"), (5, "w4x0")]


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
