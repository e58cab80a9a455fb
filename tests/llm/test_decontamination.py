import random

import numpy as np

from denspark.llm.decontamination import Items, banded_distance, count_items, find_items, normalised


def semi_global(item, part):
    row = [0] * (len(part) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(part, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance_is_the_least():
    r = random.Random(1)
    for _ in range(80):
        item = bytes(r.choice(b"abc") for _ in range(r.randint(5, 30)))
        part = bytearray(r.choice(b"abc") for _ in range(10)) + bytearray(item) + bytearray(r.choice(b"abc") for _ in range(10))
        for _ in range(r.randint(0, 5)):
            part[r.randrange(len(part))] = r.choice(b"abc")
        truth = semi_global(item, bytes(part))
        found = banded_distance(item, np.frombuffer(bytes(part), np.uint8), 6)
        assert (found[0] if found else 7) == min(truth, 7)


def test_edited_items_are_found_and_parts_are_not(spark):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(50, "tiny"), (51, ""), (52, None), (None, text(25))]
    docs, want = [], set()
    for i in range(20):
        own = list(items[i][1])
        for _ in range(len(own) * i // 400):  # up to nearly five in a hundred
            own[r.randrange(len(own))] = "z"
        docs.append((i, f"{text(40)}\n{''.join(own).upper().replace(' ', '  ')} {text(40)}"))
        want.add((i, i))
    docs += [(100 + i, f"{text(30)} {items[i][1][:70]} {text(30)}") for i in range(20)] + [(200, None), (201, ""), (202, "a tiny one"), (203, items[23][1])]
    want |= {(202, 50), (203, None)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.row.doc_id, x.item_id) for x in find_items(frame, benchmark).collect()} == want
    flagged = {x.row.doc_id for x in count_items(frame, benchmark).where("items > 0").collect()}
    assert flagged == {d for d, _ in want}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert find_items(frame, empty).count() == 0 and count_items(frame, empty).count() == len(docs)


def test_normalised_and_bound():
    import pyarrow as pa

    data, offsets = normalised(pa.array(["  A  b\n", None, "É", " ", "x"]))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == ["a b", "", "é", "", "x"]
    items = Items(["word " * 20], 8)
    assert items.bound[0] == items.length[0] - 7 - 8 * items.edits[0]


def test_all_pairs_against_brute_force(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcd ") for _ in range(n)).strip() + "x"
    items = [(i, text(r.randint(40, 90))) for i in range(8)]
    docs = []
    for i in range(40):
        own = list(r.choice(items)[1])
        for _ in range(r.randint(0, len(own) // 8)):
            own[r.randrange(len(own))] = r.choice("abcdz")
        docs.append((i, text(60) + "".join(own) + text(60)))
    docs += [(100, None), (101, ""), (3, docs[3][1])]
    known = Items([t for _, t in items], 8)
    want = []
    for d, t in docs:
        whole = " ".join((t or "").lower().split()).encode()
        want += [(d, i, e) for i in range(8) if (e := semi_global(known.texts[i], whole)) <= known.edits[i]]
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int")
    found = find_items(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.row.doc_id, x.item_id, x.edits) for x in found) == sorted(want) and want


def test_items_with_the_same_prompt(monkeypatch):
    import time

    import pyarrow as pa

    from denspark.llm import decontamination

    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    prompt = text(90)
    items = Items([prompt + text(160) for _ in range(500)], 8)
    data, offsets = normalised(pa.array([" ".join(prompt + text(60) for _ in range(100)), items.texts[7].decode()]))
    began = time.process_time()
    found = items.found(data, offsets)
    assert time.process_time() - began < 60 and [x[:3] for x in found] == [(1, 7, 0)]
    monkeypatch.setattr(decontamination, "PAIRS", 1000)
    data, offsets = normalised(pa.array([items.texts[3].decode(), prompt, items.texts[400].decode() + " " + items.texts[7].decode()]))
    assert [x[:3] for x in items.found(data, offsets)] == [(0, 3, 0), (2, 7, 0), (2, 400, 0)]
