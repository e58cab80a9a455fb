"""Exact Jaccard self-join of shingle sets: size-banded tiles with bitmap signatures.

Two sets whose Jaccard similarity is at least t share j shingles among the first
``n - ceil(t n) + j`` of either, in any order that is the same for all.  The order puts
shingles that are frequent in the corpus last; j grows with the set, and sets that share
fewer prefix shingles with sets they aren't joined with are done.  A tile is one such shared shingle and
one band of set sizes, with the sets of the band and of the band above; sets further
apart in size can't be similar.  Within a tile, hashed parity bitmaps are compared: the
bits in which two bitmaps differ bound the size of the symmetric difference from below,
so the overlap from above.  Sets with a partner that passes come back to the same tile
as sorted arrays and are intersected exactly.

Only components are asked for, so a tile keeps a forest: sets that are already joined,
by an earlier round or in the tile, aren't compared again, and a tile hands on fewer
links than it has sets.  Equal texts are one vertex from the start.  A first round links
each set to the least set with which it shares half its prefix, a second settles a few
tiles of each set, a third all tiles in which sets are still apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from denspark.llm.frequent import most_frequent
from denspark.llm.runs import column, run_heads
from denspark.llm.words import Words, chunks, grams, mix, sequence_hash, signed
from denspark.operators.components import least_reachable
from denspark.storage import checkpointed, discard, release, written

#: Frequent shingles that are put last in the order; any order gives the same result.
FREQUENT = 1 << 17
#: Sets in one block of a tile; larger tiles are dealt out as pairs of blocks.
BLOCK = 1024
#: Tiles in which a set is looked at while stars are laid.
COVERED = 2
#: Vertices that may be broadcast (as 8 bytes each, and Spark's table of them); beyond it a shuffled join is used.
SENT_BYTES = 8 << 20
#: Bits of a bitmap for each member of a set.
BITS = 4
#: Percent of a set by which its prefix is longer than it must be. Similar sets then share that many
#: shingles of their prefixes, so sets that share fewer with others are left out unseen.
EXTRA = 8


class Measure:
    """The sizes that follow from the threshold, in whole percent so that no rounding enters."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("the similarity must be over 0 and at most 100 percent")
        self.percent = percent
        self.step = math.log(100 / percent) if percent < 100 else math.log(2)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n + (-self.percent * n // 100) + np.maximum(1, EXTRA * n // 100))

    def shared(self, n: Column) -> Column:
        """The least number of a set's prefix shingles that a similar set has in its own prefix.

        The j-th shingle that two sets have in common has at least |A and B| - j of A behind
        it, so it is among the first |A| - |A and B| + j of A, and likewise of B; a partner
        has at least ``percent`` of the size.
        """
        return F.greatest(F.lit(1), F.floor(F.ceil(n * self.percent / 100) * EXTRA / 100))

    def similar(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection of similar sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / self.step + 1e-9).astype(np.int64)

    def words(self, band: np.ndarray) -> np.ndarray:
        """64-bit words of a band's bitmaps: BITS bits for each member of a set."""
        return (np.ceil(BITS * np.exp((np.asarray(band) + 1) * self.step)).astype(np.int64) >> 6) + 1


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of fewer words, of the whole sequence."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    rolled = grams(hashes, k)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            sets.append(np.array([sequence_hash(hashes[a:b], seed=b - a)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def bitmap(members: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmap: a bit is set if an odd number of members hash to it."""
    bits = (mix(members + np.uint64(words)) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _summaries(k: int):
    """For each document its set's size; and shingles that are frequent in the task."""

    def apply(batches):
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kind = None
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), k)
            n = np.array([len(x) for x in sets], np.int64)
            kind = batch.schema.field("row").type
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vertex"), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())],
                ["row", "vertex", "n", "shingle", "times"],
            )
            values, count = np.unique(np.concatenate(sets), return_counts=True)
            keep = (count > 1) | np.isin(values, seen, assume_unique=True)
            merged, where = np.unique(np.concatenate([seen, values[keep]]), return_inverse=True)
            times = np.bincount(where, np.concatenate([times, count[keep]]), len(merged)).astype(np.int64)
            seen = merged
            if len(seen) > 8 * FREQUENT:
                top = np.sort(np.argpartition(times, -4 * FREQUENT)[-4 * FREQUENT :])
                seen, times = seen[top], times[top]
        top = np.flatnonzero(times > 2)
        if len(top):
            n = len(top)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), *[pa.nulls(n, pa.int64())] * 2, pa.array(signed(seen[top])), pa.array(times[top])],
                ["row", "vertex", "n", "shingle", "times"],
            )

    return apply


def _arrays(members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit numbers of a binary column without nulls, and where each row's begin."""
    offsets = np.frombuffer(members.buffers()[1], np.int32)[members.offset : members.offset + len(members) + 1].astype(np.int64)
    data = np.frombuffer(members.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    return data, (offsets - offsets[0]) // 8


def _prefixes(measure: Measure, k: int, frequent: np.ndarray, times: np.ndarray):
    """The prefix of each set in the common order; equal texts of a block are sent once."""

    def apply(batches):
        for batch in chunks(batches):
            rows, keys, done = [], [], set()
            for members, key in zip(shingle_sets(batch.column("text"), k), column(batch, "vertex").tolist(), strict=True):
                if not len(members) or key in done:
                    continue
                done.add(key)
                at = np.minimum(np.searchsorted(frequent, members), max(len(frequent) - 1, 0))
                late = np.where(frequent[at] == members, times[at], 0) if len(frequent) else np.zeros(len(members), np.int64)
                first = int(measure.prefix(len(members)))
                rows.append(members[np.argsort(late, kind="stable")[:first]] if late.any() else members[:first])
                keys.append((key, len(members), first))
            if rows:
                key, n, first = np.array(keys, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(rows))), pa.array(np.repeat(key, first)), pa.array(np.repeat(n, first)), pa.array(np.repeat(measure.band(n), first))],
                    ["shingle", "vertex", "n", "band"],
                )

    return apply


def _shared(batches):
    """Of the rows sorted by shingle and vertex, those of shingles of two sets or more, with the first set of each."""
    last_shingle = last_vertex = first = None
    held: list[tuple[int, int, int, int]] = []  # the first set of the run, until a second comes
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, vertex, n, band = (column(batch, c) for c in ("shingle", "vertex", "n", "band"))
        again = np.zeros(len(shingle), bool)
        again[1:] = (shingle[1:] == shingle[:-1]) & (vertex[1:] == vertex[:-1])
        again[0] = shingle[0] == last_shingle and vertex[0] == last_vertex
        last_vertex_now = vertex[-1]
        shingle, vertex, n, band = (x[~again] for x in (shingle, vertex, n, band))
        if not len(shingle):
            continue
        head = run_heads(shingle, last_shingle)
        at = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        lead = np.append(first if first is not None else 0, vertex[at])[run + 1]
        size = np.bincount(run + 1, minlength=len(at) + 1)
        many = size[run + 1] > 1
        many |= run < 0  # goes on from the batch before, where its first set is
        out = [(shingle[many], vertex[many], n[many], band[many], lead[many])]
        if held and run[0] < 0:
            s, v, m, b = held[0]
            out.insert(0, (np.array([s]), np.array([v]), np.array([m]), np.array([b]), np.array([v])))
            held = []
        if len(at):
            begun = at[-1]
            held = [(shingle[begun], vertex[begun], n[begun], band[begun])] if size[-1] == 1 else []
            first = vertex[begun]
        last_shingle, last_vertex = shingle[-1], last_vertex_now
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shingle", "vertex", "n", "band", "first"])


class _Tiles:
    """Rows of whole tiles, sorted by tile; each row a set in the tile's band (or in the band above) with its bitmap."""

    def __init__(self, measure: Measure, batch: pa.RecordBatch):
        self.measure = measure
        self.vertex, self.n, self.label, self.block = (column(batch, c) for c in ("vertex", "n", "label", "block"))
        self.upper = column(batch, "upper").astype(bool)
        self.one, self.two = column(batch, "i"), column(batch, "j")
        self.words, self.at = _arrays(batch.column("bits"))

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs to compare at all: other labels, sizes that can be similar, and compared in this tile and in this order only."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (self.label[i] != self.label[j]) & (100 * small >= self.measure.percent * large) & ~(self.upper[i] & self.upper[j])
        return ok & ((self.one[i] == self.two[i]) | (self.block[i] != self.block[j]))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs whose bitmaps allow the overlap that they need."""
        size = self.at[i + 1] - self.at[i]
        if not len(i):
            return np.zeros(0, bool)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        apart = np.bitwise_count(self.words[np.repeat(self.at[i], size) + step] ^ self.words[np.repeat(self.at[j], size) + step])
        apart = np.add.reduceat(apart.astype(np.int64), np.cumsum(size) - size)
        return self.n[i] + self.n[j] - apart >= 2 * self.measure.overlap(self.n[i], self.n[j])

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = self.allowed(i, j)
        i, j = i[ok], j[ok]
        found = []
        for a in range(0, len(i), 1 << 14):
            near = self.near(i[a : a + (1 << 14)], j[a : a + (1 << 14)])
            found.append((i[a : a + (1 << 14)][near], j[a : a + (1 << 14)][near]))
        if not found:
            return i, j
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


ORDER = ("shingle", "band", "i", "j")


def _whole_tiles(found, schema: list[str]):
    """For ``mapInArrow`` over rows sorted by tile: ``found`` gets batches of whole tiles and the first row of each."""

    def shown(held: list[pa.RecordBatch]):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = np.stack([column(batch, c) for c in ORDER])
        lead = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        columns = found(batch, lead, np.diff(np.append(lead, batch.num_rows)))
        if columns is not None:
            yield pa.RecordBatch.from_arrays(columns, schema)

    def apply(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [column(batch, c) for c in ORDER]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            whole = int(changes[-1]) if len(changes) else 0
            if held:  # the last tile may go on
                last = [held[-1].column(c)[-1].as_py() for c in ORDER]
                if not whole and [k[0] for k in key] != last:
                    whole = -1
            if whole > 0:
                held.append(batch.slice(0, whole))
            if whole and held:
                yield from shown(held)
                held = []
            held.append(batch.slice(max(whole, 0)))
        if held:
            yield from shown(held)

    return apply


PLACE = ["shingle", "band", "i", "j", "vertex", "n", "label", "upper", "block"]


def _hopeful(measure: Measure, small: int = 24):
    """Of the rows of each tile, those with a partner under another label whose bitmap allows similarity.

    Sets that share one shingle often share many: where a tile isn't dealt out in blocks, the
    shingle gives way to a hash of what is left of the tile, so that equal tiles are one.
    """

    def found(batch: pa.RecordBatch, lead: np.ndarray, size: np.ndarray):
        tiles = _Tiles(measure, batch)
        hope = np.zeros(batch.num_rows, bool)
        end = np.repeat(lead + size, size)
        little = np.repeat(size <= small, size)
        for d in range(1, small):
            i = np.flatnonzero(little[: len(little) - d] & (np.arange(len(little) - d) + d < end[: len(little) - d]))
            if not len(i):
                break
            i, j = tiles.pairs(i, i + d)
            hope[i] = hope[j] = True
        for t in np.flatnonzero(size > small).tolist():
            a, b = int(lead[t]), int(lead[t] + size[t])
            for row in range(a, b, 64):
                i, j = np.meshgrid(np.arange(row, min(row + 64, b)), np.arange(row + 1, b), indexing="ij")
                up = (i < j) & ~(hope[i] & hope[j])
                i, j = tiles.pairs(i[up], j[up])
                hope[i] = hope[j] = True
        if not hope.any():
            return None
        out = {c: batch.column(c).filter(pa.array(hope)) for c in PLACE}
        left = np.add.reduceat(hope.astype(np.int64), lead)
        begin = (np.cumsum(left) - left)[left > 0]
        each = mix(mix(tiles.vertex[hope].view(np.uint64)) + tiles.upper[hope].astype(np.uint64))
        name = np.repeat(np.add.reduceat(each, begin), left[left > 0])
        whole = (tiles.one[hope] == 0) & (tiles.two[hope] == 0) & (tiles.block[hope] == 0)
        out["shingle"] = pa.array(np.where(whole, signed(name), column(batch, "shingle")[hope]))
        return [*out.values()]

    return _whole_tiles(found, PLACE)


class _Forest:
    """Sets of one tile, joined as they are found similar; a pair is intersected only while its sets are apart."""

    def __init__(self, measure: Measure, vertex, n, label, upper, block, diagonal: bool, flat: np.ndarray, at: np.ndarray, band: int):
        self.measure, self.vertex, self.n, self.upper, self.block, self.diagonal = measure, vertex, n, upper, block, diagonal
        self.flat, self.at = flat, at
        self.root = np.unique(label, return_inverse=True)[1]
        words = int(measure.words(np.int64(band)))
        many = len(vertex) > 8  # fewer are intersected at once
        self.maps = np.stack([bitmap(flat[a:b], words) for a, b in zip(at[:-1], at[1:], strict=True)]) if many else None

    def partners(self, i: int) -> np.ndarray:
        """Later rows that may be similar to row i and aren't joined with it."""
        small, large = np.minimum(self.n[i], self.n[i + 1 :]), np.maximum(self.n[i], self.n[i + 1 :])
        ok = (self.root[i + 1 :] != self.root[i]) & (100 * small >= self.measure.percent * large) & ~(self.upper[i] & self.upper[i + 1 :])
        if not self.diagonal:
            ok &= self.block[i + 1 :] != self.block[i]
        j = np.flatnonzero(ok) + i + 1
        if self.maps is not None and len(j):
            apart = np.bitwise_count(self.maps[j] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
            j = j[self.n[i] + self.n[j] - apart >= 2 * self.measure.overlap(self.n[i], self.n[j])]
        return j

    def links(self) -> list[tuple[int, int]]:
        out = []
        for i in range(len(self.vertex) - 1):
            j = self.partners(i)
            if not len(j):
                continue
            own = self.flat[self.at[i] : self.at[i + 1]]
            size = self.n[j]
            begin = np.cumsum(size) - size
            other = self.flat[np.repeat(self.at[j] - begin, size) + np.arange(int(size.sum()))]
            hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            both = np.add.reduceat(hit.astype(np.int64), begin)
            j = j[self.measure.similar(both, self.n[i], size)]
            roots, first = np.unique(self.root[j], return_index=True)
            out += [(self.vertex[i], self.vertex[x]) for x in j[first].tolist()]
            self.root[np.isin(self.root, roots)] = self.root[i]
        return out


def _linked(measure: Measure):
    """Verified links that join the sets of each tile, fewer than it has sets; rows come with their sets."""

    def found(batch: pa.RecordBatch, lead: np.ndarray, size: np.ndarray):
        flat, at = _arrays(batch.column("members"))
        vertex, n, label, block, band = (column(batch, c) for c in ("vertex", "n", "label", "block", "band"))
        upper = column(batch, "upper").astype(bool)
        diagonal = column(batch, "i") == column(batch, "j")
        links = []
        for a, b in zip(lead.tolist(), (lead + size).tolist(), strict=True):
            rows = slice(a, b)
            if (label[rows] == label[a]).all():
                continue
            links += _Forest(measure, vertex[rows], n[rows], label[rows], upper[rows], block[rows], bool(diagonal[a]), flat[at[a] : at[b]], at[a : b + 1] - at[a], int(band[a])).links()
        if not links:
            return None
        x, y = np.array(links, np.int64).T
        x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return [pa.array(x), pa.array(y)]

    return _whole_tiles(found, ["a", "b"])


def _sets(k: int):
    """(vertex, members): the sets of these texts as sorted 64-bit hashes."""

    def apply(batches):
        for batch in chunks(batches):
            members = [x.tobytes() for x in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(members, pa.binary())], ["vertex", "members"])

    return apply


def _bitmaps(measure: Measure, k: int):
    """The bitmaps of each text's set for the tiles of its own band and of the band below."""

    def apply(batches):
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), k)
            bands = measure.band(np.array([len(x) for x in sets], np.int64))
            columns = []
            for words in (measure.words(bands), measure.words(bands - 1)):
                columns.append(pa.array([bitmap(x, w).tobytes() for x, w in zip(sets, words.tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), *columns], ["vertex", "own", "below"])

    return apply


def _verified(measure: Measure):
    """Rows sorted by group, a, b: the set of a, with no b, and then those of its candidates b."""

    def apply(batches):
        centre, base, part = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, part_of, b = column(batch, "a"), column(batch, "part"), batch.column("b").to_pylist()
            members = batch.column("members")
            from_a, to_b = [], []
            for i in range(batch.num_rows):
                own = np.frombuffer(members[i].as_buffer(), np.uint64)
                if b[i] is None:
                    centre, base, part = a[i], own, part_of[i]
                elif centre == a[i] and part == part_of[i]:
                    both = len(base) + len(own) - len(np.unique(np.concatenate([base, own])))
                    if measure.similar(both, len(base), len(own)):
                        from_a.append(centre)
                        to_b.append(b[i])
            if from_a:
                yield pa.RecordBatch.from_arrays([pa.array(from_a, pa.int64()), pa.array(to_b, pa.int64())], ["a", "b"])

    return apply


class _Join:
    def __init__(self, texts: DataFrame, measure: Measure, k: int):
        """texts: (vertex, text), a vertex perhaps more than once."""
        self.texts, self.measure, self.k = texts, measure, k

    def texts_of(self, vertices: DataFrame) -> DataFrame:
        """(vertex, text) of these distinct vertices, each once, so that only their texts are cut into shingles again.

        The texts are found by their hash in the JVM; few vertices are broadcast, many are joined.
        """
        vertices = checkpointed(vertices)
        wanted = F.broadcast(vertices) if 8 * vertices.count() <= SENT_BYTES else vertices
        return self.texts.join(wanted, "vertex", "left_semi").groupBy("vertex").agg(F.first("text").alias("text"))

    def sets_of(self, vertices: DataFrame) -> DataFrame:
        """(vertex, members) of these distinct vertices, each once."""
        return self.texts_of(vertices).mapInArrow(_sets(self.k), "vertex long, members binary")

    def bitmaps_of(self, vertices: DataFrame) -> DataFrame:
        return self.texts_of(vertices).mapInArrow(_bitmaps(self.measure, self.k), "vertex long, own binary, below binary")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar. Candidates of one set are dealt out in parts."""
        pairs = checkpointed(pairs)
        vertices = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
        sets = self.sets_of(vertices)  # its exchange by vertex serves both joins
        parts = F.pmod(F.xxhash64("b"), F.lit(1 << 20))
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("long").alias("parts"))
        dealt = pairs.join(many, "a").select("a", "b", F.pmod(parts, F.col("parts")).alias("part"))
        centres = many.join(sets.withColumnRenamed("vertex", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "members")
        around = dealt.join(sets.withColumnRenamed("vertex", "b"), "b").select("a", "part", "b", "members")
        rows = centres.unionByName(around).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        links = checkpointed(rows.mapInArrow(_verified(self.measure), "a long, b long"))
        release(links.sparkSession)
        return links

    def labelled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.select("shingle", "vertex", "n", "band").join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))

    def crossing(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows (shingle, vertex, n, band) of shingles that occur under different labels, with the label, if the set has enough of them.

        A shingle's labels are a partial aggregate, and the join back on it can be split, so
        a shingle of very many sets isn't one task's work.
        """
        labelled = checkpointed(self.labelled(self._enough(rows), labels))
        mixed = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
        return self._enough(labelled.join(checkpointed(mixed), "shingle"))

    def _enough(self, rows: DataFrame) -> DataFrame:
        """The rows of sets that have as many of them as any similar set shares."""
        enough = rows.groupBy("vertex").agg(F.first("n").alias("n"), F.count("*").alias("rows")).where(F.col("rows") >= self.measure.shared(F.col("n"))).select("vertex")
        return rows.join(checkpointed(enough), "vertex", "left_semi")

    def links(self, crossing: DataFrame, bitmaps: DataFrame, cover: bool) -> DataFrame:
        """Verified links between sets under different labels that share a prefix shingle; a forest of each tile.

        A cover needs each set in a few tiles only, those of its first shingles; what they
        miss is left to the round that takes all tiles.  Sets that share one shingle often
        share many: of tiles with the same rows, told by two hashes, one is taken.
        """
        if cover:
            first = Window.partitionBy("vertex").orderBy("shingle")  # a set's prefix at most
            crossing = crossing.withColumn("place", F.row_number().over(first)).where(F.col("place") <= COVERED).drop("place")
        sides = F.explode(F.array(F.struct("band", F.lit(False).alias("upper")), F.struct((F.col("band") - 1).alias("band"), F.lit(True).alias("upper")))).alias("side")
        tile = crossing.select("shingle", "vertex", "n", "label", sides).select("shingle", "vertex", "n", "label", "side.*")
        rows = [F.bit_xor(F.xxhash64("vertex", "upper", F.lit(i))).alias(f"rows{i}") for i in (1, 2)]
        counts = tile.groupBy("shingle", "band").agg(F.count("*").alias("all"), F.count_if("upper").alias("above"), F.min("label").alias("low"), F.max("label").alias("high"), *rows)
        counts = counts.where("all > 1 and above < all and low < high").groupBy("band", "all", "rows1", "rows2").agg(F.min("shingle").alias("shingle"))
        counts = checkpointed(counts.select("shingle", "band", F.ceil(F.col("all") / BLOCK).cast("long").alias("blocks")))
        # Joined by shingle before rows are repeated for their two bands; a shingle has no more tiles than there are bands.
        tiles = counts.groupBy("shingle").agg(F.collect_list(F.struct("band", "blocks")).alias("tiles"))
        dealt = crossing.join(tiles, "shingle").select("shingle", "vertex", "n", "label", F.col("band").alias("own"), F.explode("tiles").alias("tile"))
        dealt = dealt.where((F.col("own") == F.col("tile.band")) | (F.col("own") - 1 == F.col("tile.band"))).select("shingle", "vertex", "n", "label", "tile.band", "tile.blocks", (F.col("own") > F.col("tile.band")).alias("upper"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")))
        dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).select(*PLACE)
        # Bitmaps and sets come last, so that they pass one exchange.
        mapped = dealt.join(bitmaps, "vertex").withColumn("bits", F.when(F.col("upper"), F.col("below")).otherwise(F.col("own"))).drop("own", "below")
        hopeful = mapped.repartition(*ORDER).sortWithinPartitions(*ORDER, "vertex").mapInArrow(_hopeful(self.measure), mapped.select(*PLACE).schema)
        hopeful = checkpointed(hopeful.dropDuplicates(["shingle", "band", "i", "j", "vertex"]))
        release(hopeful.sparkSession)
        if hopeful.isEmpty():
            return hopeful.select(F.col("vertex").alias("a"), F.col("vertex").alias("b"))
        rows = hopeful.join(self.sets_of(hopeful.select("vertex").distinct()), "vertex").repartition(*ORDER).sortWithinPartitions(*ORDER, "vertex")
        found = checkpointed(rows.mapInArrow(_linked(self.measure), "a long, b long").distinct())
        release(found.sparkSession)
        return found


def similar_documents(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of documents under the Jaccard similarity of k-word shingles.

    Words are lower-cased (A-Z) runs without white space; a set is the distinct k-word
    shingles, with fewer words the whole sequence.  Two documents link when
    ``100 * |intersection| >= percent * |union|``.

    Returns ``row`` (the columns of ``docs`` but for the text), ``n_shingles`` and
    ``component_id``: the least id that can be reached by links, the row's own included.

    * null or empty text, or white space alone: an empty set, linked with nothing;
    * null id: no component can be named by it; the row gets the least id of its component, or null;
    * repeated rows and equal texts: one vertex (by a 64-bit hash of the text), all in one component; of equal ids the least is one of them;
    * very long texts: one set like any other, held by one task at a time;
    * other columns keep their names inside ``row``, so none can clash;
    * an empty table gives an empty table.
    """
    measure = Measure(percent)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(row.alias("row"), F.xxhash64(text).alias("vertex"), text.alias("text"))
    texts = given.select("vertex", "text")
    out = StructType().add("row", given.schema["row"].dataType).add("vertex", LongType()).add("n", LongType()).add("shingle", LongType()).add("times", LongType())
    summaries = written(given.mapInArrow(_summaries(k), out), "summaries")

    counted = summaries.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    frequent = most_frequent(counted, "times", "shingle", FREQUENT)
    shingle = frequent["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    prefixes = texts.mapInArrow(_prefixes(measure, k, shingle[order], frequent["times"].to_numpy(np.int64)[order]), "shingle long, vertex long, n long, band long")
    rows = written(prefixes.repartition("shingle").sortWithinPartitions("shingle", "vertex").mapInArrow(_shared, "shingle long, vertex long, n long, band long, first long"), "shared")

    join = _Join(texts, measure, k)
    least = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    close = rows.where("first <> vertex").groupBy("vertex", "first").agg(F.count("*").alias("both"), F.first("n").alias("n")).where(F.col("both") * 2 >= least)
    links = join.verify(close.groupBy("vertex").agg(F.min("first").alias("a")).select("a", F.col("vertex").alias("b")))
    labels = least_reachable(links)
    crossing = written(join.crossing(rows, labels), "crossing")
    discard(rows)
    bitmaps = written(join.bitmaps_of(crossing.select("vertex").distinct()), "bitmaps")
    for cover in (True, False):
        more = join.links(crossing, bitmaps, cover)
        if not more.isEmpty():
            links = links.union(more)
            labels = least_reachable(links)
        if cover:  # the last round leaves out the tiles that this one has joined
            before, crossing = crossing, written(join.labelled(crossing, labels), "crossing")
            discard(before)
    for done in (crossing, bitmaps):
        discard(done)

    # Names are given to vertices, so that copies of one set are a partial aggregate and no join meets them but the last.
    vertices = summaries.where("vertex is not null and n > 0").groupBy("vertex").agg(F.min(f"row.`{id_col}`").alias("least"))
    linked = checkpointed(labels.join(vertices, "vertex"))
    smallest = checkpointed(linked.groupBy("label").agg(F.min("least").alias("component")))
    renamed = linked.join(smallest, "label").select("vertex", "component")
    named = checkpointed(vertices.join(renamed, "vertex", "left").select("vertex", F.coalesce("component", "least").alias("component_id")))
    placed = summaries.where("row is not null").select("row", "vertex", "n").join(named, "vertex", "left")
    return placed.select("row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(f"row.`{id_col}`")).alias("component_id"))
