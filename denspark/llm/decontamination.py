"""Benchmark decontamination by q-gram filtering and banded alignment.

An item is found in a document if some part of it is within the item's edit budget,
``edit_percent`` of its length, after lower-casing and turning white space into single
spaces; edits count UTF-8 bytes.  By the q-gram lemma such a part shares at least
``length - q + 1 - q * edits`` q-grams with the item, all within a band of diagonals.
Shared q-grams are counted in overlapping bands, bands that meet the bound are kept, the
same lemma with shorter q-grams, whose bound is most of the item, is applied to each, and
a banded alignment settles the rest.  Benchmarks are sent to the tasks in blocks of
bounded size, so one of any size works.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from denspark.llm.language_model import Listed
from denspark.llm.words import SEPARATOR, chunks, mix, text_buffer

#: Bytes of a q-gram: what one unaligned load gives.
Q = 8
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20
#: Bytes of a q-gram of the second count.
FINE = 4
#: Pairs of a place and an item with its q-gram that are looked at together.
PAIRS = 4 << 20
_TABLE = 1 << 20


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts with single spaces and none at the ends."""
    data, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    if not len(data):
        return data, offsets
    apart = SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = ~apart
    keep[:-1] |= apart[:-1] & ~apart[1:] & ~first[1:-1]  # the last of a run before a visible byte
    keep[first[:-1] & apart] = False
    lead = np.flatnonzero(keep & apart)
    if len(lead):  # at a document's head there is nothing before it
        document = np.searchsorted(offsets, lead, "right") - 1
        solid = np.append(0, np.cumsum(~apart))
        keep[lead[solid[lead] == solid[offsets[document]]]] = False
    upto = np.append(0, np.cumsum(keep))
    return np.where(apart, 0x20, data).astype(np.uint8)[keep], upto[offsets]


def _eight(data: np.ndarray) -> np.ndarray:
    return np.ndarray(max(len(data) - Q + 1, 0), "<u8", np.concatenate([data, np.zeros(Q, np.uint8)]), strides=(1,))


def _fine(data: np.ndarray) -> np.ndarray:
    """The FINE-grams of a text."""
    return _eight(np.concatenate([data, np.zeros(Q - FINE, np.uint8)])) & np.uint64((1 << 8 * FINE) - 1)


class Items:
    """A block of benchmark items with the index of their q-grams."""

    def __init__(self, texts: list[str | None], percent: int):
        data, offsets = normalised(pa.array(texts, pa.large_string()))
        self.texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.length = np.diff(offsets)
        self.edits = np.maximum(np.minimum(self.length * percent // 100, self.length // Q - 1), 0)
        self.bound = np.maximum(self.length - Q + 1 - Q * self.edits, 1)
        self.fine = [_fine(np.frombuffer(x, np.uint8)) for x in self.texts]
        self.short = [i for i, n in enumerate(self.length.tolist()) if 0 < n < Q]
        codes, owner, place = [], [], []
        for i, text in enumerate(self.texts):
            if len(text) >= Q:
                own = _eight(np.frombuffer(text, np.uint8))
                codes.append(own)
                owner.append(np.full(len(own), i))
                place.append(np.arange(len(own)))
        none = np.zeros(0, np.int64)
        code = np.concatenate(codes) if codes else none.astype(np.uint64)
        owner, place = (np.concatenate(x) if x else none for x in (owner, place))
        hashed = mix(code)
        order = np.argsort(hashed, kind="stable")
        names, first, count = np.unique(hashed[order], return_index=True, return_counts=True)
        self.grams, self.first, self.count = Listed(names, 20), first, count
        self.owner, self.place = owner[order], place[order]
        self.owned = np.repeat(np.arange(len(names)), count) * (len(self.texts) + 1) + self.owner  # ascending: a q-gram's items are in order
        self.may = np.zeros(1 << 22, bool)
        self.may[(names >> np.uint64(42)).astype(np.int64)] = True

    def found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, end) of the best part for each item in each document, in normalised bytes."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}

        def keep(document: int, item: int, edits: int, start: int, end: int) -> None:
            old = out.get((document, item))
            if old is None or (edits, start) < old[:2]:
                out[document, item] = (edits, start, end)

        for item in self.short:
            text, whole = self.texts[item], data.tobytes()
            at = whole.find(text)
            while at >= 0:
                document = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(text) <= offsets[document + 1]:
                    keep(document, item, 0, at - int(offsets[document]), at - int(offsets[document]) + len(text))
                at = whole.find(text, at + 1)
        for document, item, low, high in self._regions(data, offsets):
            begin, end = int(offsets[document]), int(offsets[document + 1])
            a, b = max(begin, low), min(end, high)
            text, part = self.texts[item], data[a:b]
            at = part.tobytes().find(text)
            if at >= 0:
                keep(document, item, 0, a + at - begin, a + at - begin + len(text))
            elif ((old := out.get((document, item))) is None or old[0]) and np.isin(self.fine[item], _fine(part)).sum() >= self.length[item] - FINE + 1 - FINE * self.edits[item]:
                best = banded_distance(text, part, int(self.edits[item]))
                if best is not None:
                    keep(document, item, best[0], a - begin + best[1], a - begin + best[2])
        return [(d, i, *x) for (d, i), x in sorted(out.items())]

    def _regions(self, data: np.ndarray, offsets: np.ndarray):
        """(document, item, low, high): places of bands whose shared q-grams meet the bound."""
        grams = _eight(data)
        if not len(grams) or not len(self.grams.hashes):
            return
        code = mix(grams)
        at = np.flatnonzero(self.may[(code >> np.uint64(42)).astype(np.int64)])
        gram = self.grams.find(code[at])
        at, gram = at[gram >= 0], gram[gram >= 0]
        if not len(at):
            return
        document = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[document + 1]
        at, gram, document = at[inside], gram[inside], document[inside]
        upto = np.cumsum(self.count[gram])
        edge = np.append(np.flatnonzero(np.append(True, document[1:] != document[:-1])), len(at))
        k = 0
        while k < len(edge) - 1:  # whole documents together, or one of them in parts by item
            done = upto[edge[k] - 1] if edge[k] else 0
            to = max(k + 1, int(np.searchsorted(upto[edge[1:] - 1], done + PAIRS, "right")))
            own = slice(edge[k], edge[to])
            parts = -(-int(upto[edge[to] - 1] - done) // PAIRS)
            bounds = [len(self.texts) * i // parts for i in range(parts + 1)]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                yield from self._bands(at[own], gram[own], document[own], offsets, low, high)
            k = to

    def _bands(self, at: np.ndarray, gram: np.ndarray, document: np.ndarray, offsets: np.ndarray, low_item: int, high_item: int):
        base = gram * (len(self.texts) + 1)
        first = np.searchsorted(self.owned, base + low_item)
        n = np.searchsorted(self.owned, base + high_item) - first
        index = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = self.owner[index]
        wide = self.edits[item] + 1
        # Diagonals count from the document's start; they are shifted so that none is negative.
        diagonal = np.repeat(at - offsets[document], n) - self.place[index] + self.length[item]
        document = np.repeat(document, n)
        for half in (0, 1):  # bands are 2 (edits + 1) wide and begin every edits + 1 diagonals
            band = (diagonal // wide - half) // 2
            key = mix((item.astype(np.uint64) << np.uint64(40)) ^ (document.astype(np.uint64) << np.uint64(20)) ^ mix(band.astype(np.uint64)))
            cell = (key & np.uint64(_TABLE - 1)).astype(np.int64)
            often = np.flatnonzero(np.bincount(cell, minlength=_TABLE)[cell] >= self.bound[item])
            if not len(often):
                continue
            names, first, count = np.unique(key[often], return_index=True, return_counts=True)
            chosen = often[first[count >= self.bound[item[often[first]]]]]
            for i in chosen.tolist():
                d, t, w = int(document[i]), int(item[i]), int(wide[i])
                low = int(offsets[d]) + (2 * int(band[i]) + half) * w - int(self.length[t])
                yield d, t, low - w, low + 3 * w + int(self.length[t]) + w


def banded_distance(item: bytes, part: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Least edits, start and end of a stretch of ``part`` that the item becomes, or None if over ``edits``."""
    a, m, n = np.frombuffer(item, np.uint8), len(item), len(part)
    if m - n > edits:
        return None
    # Diagonal d: place in part less place in item. It may end and begin anywhere in the part.
    low, high = -edits, n - m + edits
    d = np.arange(low, high + 1)
    padded = np.concatenate([np.full(m + edits + 1, 256, np.int16), part.astype(np.int16), np.full(m + edits + 1, 256, np.int16)])
    shift = m + edits + 1
    far = 1 << 20
    row = np.where((d >= 0) & (d <= n), 0, far)
    begin = np.where((d >= 0) & (d <= n), d, 0)
    steps = np.arange(len(d))
    for i in range(m):
        across = row + (padded[shift + i + d] != a[i])  # an item byte on a part byte
        down = np.append(row[1:] + 1, far)  # an item byte that the part lacks
        better = down < across
        new, start = np.where(better, down, across), np.where(better, np.append(begin[1:], 0), begin)
        # part bytes that the item lacks: from the best diagonal before
        level = new - steps
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, steps, 0))
        row, begin = best + steps, start[source]
        if row.min() > edits:
            return None
    end = m + d
    row = np.where((end >= 0) & (end <= n), row, far)
    i = int(np.argmin(row))
    return (int(row[i]), int(begin[i]), int(end[i])) if row[i] <= edits else None


def _matches(items: Items, ids: list[int | None]):
    def apply(batches):
        for batch in chunks(batches):
            data, offsets = normalised(batch.column("text"))
            found = items.found(data, offsets)
            if found:
                document, item, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(document)), pa.array([ids[i] for i in item], pa.int64()), *[pa.array(x, pa.int64()) for x in rest]],
                    ["row", "item_id", "edits", "start", "end"],
                )

    return apply


def _flags(items: Items):
    def apply(batches):
        for batch in batches:
            for part in chunks(iter([batch])):
                data, offsets = normalised(part.column("text"))
                hits = np.bincount([d for d, *_ in items.found(data, offsets)], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(hits + part.column("items").to_numpy())], ["row", "text", "items"])

    return apply


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, edit_percent: int):
    """The benchmark's items in blocks of about BLOCK_BYTES, with their ids."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text is not null and text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for i in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        rows = sorted(own.collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
        yield Items([r["text"] for r in rows], edit_percent), [r["id"] for r in rows]


def count_items(docs: DataFrame, benchmark: DataFrame, edit_percent: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every document, as ``row`` (its columns but for the text), ``text`` and ``items``, the number of benchmark items found in it; as in find_items()."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    given = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(0).cast("long").alias("items"))
    out = StructType().add("row", given.schema["row"].dataType).add("text", StringType()).add("items", LongType())
    for items, _ in _blocks(benchmark, item_col, item_text_col, edit_percent):
        given = given.mapInArrow(_flags(items), out)
    return given


def find_items(docs: DataFrame, benchmark: DataFrame, edit_percent: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which benchmark items stand in which documents.

    Returns a row for each document and item found in it: ``row`` (the columns of ``docs``
    but for the text), ``item_id``, ``edits`` of the best place, and its ``start`` and
    ``end`` in bytes of the normalised text.

    * null or empty text or item: finds nothing and is not found;
    * an item of under ``Q`` bytes is found only as it is; the edit budget of one of under
      ``Q * (edits + 1)`` bytes is lowered until the q-gram bound is one or more;
    * ties: of places with equally few edits the first;
    * very long texts: whole, in parts of bounded size, by one task;
    * other columns keep their names inside ``row``, so none can clash;
    * repeated rows give repeated results; an empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    given = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = StructType().add("row", given.schema["row"].dataType)
    for name in ("item_id", "edits", "start", "end"):
        out = out.add(name, LongType())
    parts = [given.mapInArrow(_matches(items, ids), out) for items, ids in _blocks(benchmark, item_col, item_text_col, edit_percent)]
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    return found
