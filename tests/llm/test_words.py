import numpy as np
import pyarrow as pa

from denspark.llm.words import Words, chunks, grams

TEXTS = ["a b  c", None, "", " x\ty\n", "A b", "é ü\x0bz", "w" * 300 + " " + "v" * 9, "nbsp stays"]


def test_words_are_bytes_split():
    words = Words(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert [words.word(j) for j in range(words.first[i], words.first[i + 1])] == (text or "").encode().split()


def test_hashes_follow_the_words():
    texts = ["the cat", "cat the", "The cat", "w" * 100 + " cat", "w" * 100]
    words = Words(pa.array(texts), lower=True)
    h = words.hashes()
    assert h[0] == h[3] == h[4] and h[1] == h[2] == h[5] == h[7] and h[6] == h[8]
    assert len(set(h.tolist())) == 3


def test_grams_and_chunks():
    assert len(grams(np.arange(3, dtype=np.uint64), 5)) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50] * 7 + [None])], ["text"])
    assert sum(c.num_rows for c in chunks(iter([batch]), size=120)) == 8
