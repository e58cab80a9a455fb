"""Removal of repeated passages by seed and extend.

A window is ``min_words`` consecutive words.  Each window names one anchor, the least
hash among its word ``SEED``-grams (winnowing), so equal windows name the same anchor.
Documents are joined on their anchors first; only windows whose anchor occurs in two
documents or more, or twice in one, are extended to both sides, that is compared as
whole windows.  The earliest place of a window stays, every later one is a repeat;
adjoining repeats together are the maximal repeats, and their words go.

Everything that may be hot is collapsed before a shuffle: of the places of an anchor or
window within a block of documents only the earliest goes into the exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from denspark.llm.runs import column, repeated, run_heads
from denspark.llm.words import Words, chunks, grams, mix, signed

#: Words of a seed; a window of w words has w - SEED + 1 of them.
SEED = 6


def _sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out, have = least(out[:-have], out[have:]), 2 * have
    rest = width - have
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def _windows(words: Words, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document and start in the document of all windows."""
    if len(hashes) < min_words:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    seed = min(SEED, min_words)
    anchors = _sliding(np.minimum, grams(hashes, seed), min_words - seed + 1)
    document = words.documents()
    inside = np.flatnonzero(document[: len(anchors)] == document[min_words - 1 :])
    document = document[inside]
    return anchors[inside], document, inside - words.first[document]


def _anchor_places(words: Words, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and document of every place of a seed that is an anchor of some window, ties included."""
    anchors, document, start = _windows(words, hashes, min_words)
    if not len(anchors):
        return anchors, document
    seed = min(SEED, min_words)
    seeds = grams(hashes, seed)
    each = min_words - seed + 1
    # A seed is an anchor where it equals the greatest of the least hashes of the windows around it.
    least = np.zeros(len(seeds) + each - 1, np.uint64)
    least[each - 1 + words.first[document] + start] = anchors
    place = np.flatnonzero(seeds == _sliding(np.maximum, least, each))
    return seeds[place], words.documents()[place]


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return column(batch, "doc_id"), column(batch, "body")


def _anchors(min_words: int):
    def apply(batches):
        for batch in chunks(batches):
            ids, body = _places(batch)
            words = Words(batch.column("text"))
            anchor, document = _anchor_places(words, words.hashes(), min_words)
            if not len(anchor):
                continue
            order = np.lexsort((document, anchor))
            anchor, document = anchor[order], document[order]
            lead = run_heads(anchor, None)
            own = lead | (document != np.roll(document, 1))  # once for each document
            many = ~(lead & np.append(lead[1:], True))  # more than one place in this block
            sent, known = np.flatnonzero(lead), np.flatnonzero(many & own)
            rows = np.concatenate([sent, known])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(anchor[rows])),
                    pa.array(ids[document[rows]]),
                    pa.array(body[document[rows]]),
                    pa.array(np.arange(len(rows)) >= len(sent)),
                ],
                ["anchor", "doc_id", "body", "known"],
            )

    return apply


def _shared(batches):
    """Anchors of two blocks or more, sorted runs; and those known to be shared within a block."""

    def unknown():
        for batch in batches:
            flags = column(batch, "known").astype(bool)
            if flags.any():
                known.append(batch.filter(pa.array(flags)))
            if not flags.all():
                yield batch.filter(pa.array(~flags))

    known: list[pa.RecordBatch] = []
    for batch in repeated("anchor")(unknown()):
        yield batch.select(["doc_id", "body", "anchor"])
        while known:
            yield known.pop().select(["doc_id", "body", "anchor"])
    while known:
        yield known.pop().select(["doc_id", "body", "anchor"])


def _extended(min_words: int):
    """Windows of shared anchors: the earliest of a block, and runs of those known to be repeats."""

    def apply(batches):
        for batch in chunks(batches):
            lists = batch.column("anchors")
            batch = batch.filter(lists.is_valid())
            if not batch.num_rows:
                continue
            lists = batch.column("anchors")
            ids, body = _places(batch)
            words = Words(batch.column("text"))
            hashes = words.hashes()
            anchor, document, start = _windows(words, hashes, min_words)
            if not len(anchor):
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            wanted = mix(flat + mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)))
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
            lead = np.flatnonzero(new)
            hit = np.isin(mix(anchor[lead] + mix(document[lead].astype(np.uint64))), wanted)
            take = np.flatnonzero(np.repeat(hit, np.diff(np.append(lead, len(anchor)))))
            if not len(take):
                continue
            document, start = document[take], start[take]
            window = grams(hashes, min_words)[words.first[document] + start]
            _, rank = np.unique(np.stack([ids, body]), axis=1, return_inverse=True)  # by doc_id, then body
            place = rank.reshape(-1)[document] * (1 << 40) + start
            order = np.lexsort((place, window))
            head = run_heads(window[order], None)
            first_place = np.repeat(place[order][head], np.diff(np.append(np.flatnonzero(head), len(order))))
            again = np.zeros(len(order), bool)
            again[order] = place[order] > first_place
            sent = order[head]
            # runs of repeats in a document
            flagged = np.flatnonzero(again)
            if len(flagged):
                cut = np.ones(len(flagged), bool)
                cut[1:] = (document[flagged[1:]] != document[flagged[:-1]]) | (start[flagged[1:]] != start[flagged[:-1]] + 1)
                runs = np.flatnonzero(cut)
                lengths = np.diff(np.append(runs, len(flagged)))
                at = flagged[runs]
            else:
                at = lengths = np.zeros(0, np.int64)
            rows = np.concatenate([sent, at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([window[sent], mix(place[at].astype(np.uint64))]))),
                    pa.array(ids[document[rows]]),
                    pa.array(body[document[rows]]),
                    pa.array(start[rows].astype(np.int32)),
                    pa.array(np.concatenate([np.ones(len(sent), np.int32), lengths.astype(np.int32)])),
                    pa.array(np.arange(len(rows)) >= len(sent)),
                ],
                ["window", "doc_id", "body", "start", "n", "known"],
            )

    return apply


def _repeats(batches):
    """All but the earliest place of each window; rows come sorted by window, doc_id, body, start."""
    last = place = None  # the window of the run, and its earliest place
    for batch in batches:
        if not batch.num_rows:
            continue
        window, ids, body, start, n = (column(batch, c) for c in ("window", "doc_id", "body", "start", "n"))
        head = run_heads(window, last)
        group = np.cumsum(head)  # 0: goes on from the batch before
        at = np.flatnonzero(head)
        first = [np.append(x[0] if place is None else place[i], x[at])[group] for i, x in enumerate((ids, body, start))]
        out = column(batch, "known").astype(bool) | (first[0] != ids) | (first[1] != body) | (first[2] != start)
        last, place = window[-1], [x[-1] for x in first]
        if out.any():
            run = start[out].astype(np.int64) << 32 | n[out]
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(body[out]), pa.array(run)], ["doc_id", "body", "run"])


def _cut(min_words: int, as_is: bool):
    """Text without the words of repeats."""

    def apply(batches):
        from itertools import compress

        for batch in chunks(batches):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            lists = batch.column("runs")
            flat, upto = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            repeated_in = lists.is_valid().to_pylist()
            kept, words, removed = [], [], []
            for i, text in enumerate(texts):
                parts = (text or b"").split()
                words.append(len(parts))
                if not repeated_in[i]:
                    kept.append(text or b"" if as_is else b" ".join(parts))
                    removed.append(0)
                    continue
                edge = np.zeros(len(parts) + 1, np.int64)
                runs = flat[upto[i] : upto[i + 1]]
                begin, count = runs >> 32, runs & 0xFFFFFFFF
                np.add.at(edge, begin, 1)
                np.add.at(edge, np.minimum(begin + count + min_words - 1, len(parts)), -1)
                stay = np.cumsum(edge)[:-1] == 0
                kept.append(b" ".join(compress(parts, stay.tolist())))
                removed.append(len(parts) - int(stay.sum()))
            named = {
                "n_words": pa.array(words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*batch.select(["row"]).columns, *named.values()], ["row", *named])

    return apply


def remove_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", as_is: bool = True) -> DataFrame:
    """Remove every word that a repeated window of ``min_words`` words covers.

    A window is a repeat if its word sequence also starts earlier: in a document of a
    smaller id, or earlier in the same document.  Windows are judged on the input.

    Returns ``row``, a struct of the columns of ``docs`` but for the text (so that no name
    can clash), ``n_words``, ``n_removed`` and ``kept``: the kept words joined by one
    space, or with ``as_is`` the text unchanged where no word goes.

    * null or empty text: no words, ``kept`` is empty;
    * null id: the row has no place in the order, so nothing of it is removed and it covers nothing;
    * equal rows: one document that is there twice, each copy gets the same result;
    * rows that share an id but not the text: ordered by a hash of the text;
    * an empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    placed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("body"), F.col(f"`{text_col}`").cast("string").alias("text"), row.alias("row"))

    sent = placed.where("doc_id is not null").select("doc_id", "body", "text").mapInArrow(_anchors(min_words), "anchor long, doc_id long, body long, known boolean")
    spread: Column = F.when(F.col("known"), F.xxhash64("doc_id", "anchor")).otherwise(F.col("anchor"))
    shared = sent.repartition(spread).sortWithinPartitions("known", "anchor").mapInArrow(_shared, "doc_id long, body long, anchor long")
    lists = shared.groupBy("doc_id", "body").agg(F.collect_set("anchor").alias("anchors"))

    # The text's exchange is the same here and below, so Spark writes it once.
    windows = placed.join(lists, ["doc_id", "body"], "left").mapInArrow(_extended(min_words), "window long, doc_id long, body long, start int, n int, known boolean")
    repeats = windows.repartition("window").sortWithinPartitions("window", "doc_id", "body", "start").mapInArrow(_repeats, "doc_id long, body long, run long")
    by_document = repeats.groupBy("doc_id", "body").agg(F.collect_set("run").alias("runs"))

    out = StructType([placed.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return placed.join(by_document, ["doc_id", "body"], "left").select("row", "text", "runs").mapInArrow(_cut(min_words, as_is), out)
