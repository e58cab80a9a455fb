import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from denspark.llm.packing import bin_completion, lower_bound, pack
from denspark.llm.queries import tokenizer_path
from denspark.llm.tokens import Encoder

ODD = ["", "  a  b ", " x", "a\n\n  b\t c \n", "it's we'll I'M <|endoftext|> ok  ", " ", "\x1c a \x1cb", "日本語 テキスト😀 12 3a", "a \n b", "x" * 3000, " \n", "\n a  \n\n  b", "é ß", "don't  't", "a  b  c", "hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|endoftext|>b  <|endoftext|>  c <|endoftext|", " <|endoftext|> ", "x\n<|endoftext|>\n\ny"]


def reference():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_library_s():
    ids, counts = Encoder(tokenizer_path()).encode([*ODD, None])
    at = 0
    for text, n in zip([*ODD, ""], counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == reference().encode(text, add_special_tokens=False).ids
        at += n


@pytest.mark.parametrize("counts", [{6: 3, 5: 2, 4: 5, 1: 2}, {7: 4, 3: 4}, {10: 2}, {}, {4: 3, 3: 3, 2: 1, 9: 2}, {6: 1, 5: 1, 4: 1, 3: 1, 2: 1}])
def test_few_bins(counts):
    plan = bin_completion(counts, 10)
    used = defaultdict(int)
    for filling, n in plan:
        assert sum(filling) <= 10
        for x in filling:
            used[x] += n
    assert dict(used) == counts
    assert sum(n for _, n in plan) == lower_bound(counts, 10)


def test_pieces_and_places(spark):
    texts = [*ODD, None, "word " * 3000, "b " * 700, "c " * 320]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pack(frame, tokenizer_path(), size=256).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = reference().encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 256)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def fewest_bins(pieces, size):
    """Exact, by subsets: the fewest bins, and the least room taken in the last of them."""
    n = len(pieces)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (1, 0)
    for s in range(1 << n):
        bins, used = best[s]
        for i in range(n):
            if not s >> i & 1:
                state = (bins, used + pieces[i]) if used + pieces[i] <= size else (bins + 1, pieces[i])
                best[s | 1 << i] = min(best[s | 1 << i], state)
    return best[-1][0]


def test_as_few_bins_as_an_exact_solver():
    r = random.Random(8)
    cases = [([15, 14, 21, 9, 17, 20, 10, 12, 15, 16], 50)]
    for _ in range(400):
        size = r.choice([10, 23, 50, 100])
        cases.append(([r.randint(1, size * 2 // 3) for _ in range(r.randint(1, 9))], size))
    for pieces, size in cases:
        plan = bin_completion(dict(Counter(pieces)), size)
        used = Counter()
        for filling, n in plan:
            assert sum(filling) <= size
            for x in filling:
                used[x] += n
        assert used == Counter(pieces)
        assert sum(n for _, n in plan) == fewest_bins(pieces, size), (pieces, size)


def test_null_ids_repeats_and_clashing_names(spark):
    rows = [(None, "a b c", 1, 2), (4, "a b c", 3, 4), (4, "a b c", 3, 4), (5, "\u00e9 " * 400, 5, 6)]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id long"), tokenizer_path(), size=64).collect()
    assert sorted((r.row.doc_id or 0, r.row.piece) for r in found if r.row.doc_id != 5) == [(0, 1), (4, 3), (4, 3)]
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
