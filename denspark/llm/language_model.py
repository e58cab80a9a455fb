"""Scoring by a Brown class model: P(w | before) = P(class of w | class before) P(w | class of w).

The most frequent words, the seeds, are put into classes by the exchange algorithm on
their bigram counts.  Every further word that is there at least FROM times is exchanged in
by the classes of the seeds before and after it, as that algorithm would move it.  Rarer
words, and words never seen, take the class that the clustered words with the same ending
have.  Transitions and emissions are counted over all training documents
and smoothed by addition; within a class one more type stands for all unseen words, so
the probabilities of a class add up to one.

Frequent words are counted and looked up in place; only rare ones go through a shuffle.
Which words count as frequent changes the cost, not the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructType

from denspark.llm.frequent import most_frequent
from denspark.llm.words import Words, chunks, mix, signed
from denspark.storage import written

#: Seeds, and classes for all words; occurrences from which a word that is no seed is clustered.
CLUSTERED = 1024
CLASSES = 40
FROM = 10
#: Frequent words, which all tasks know; rarer ones are joined.
LISTED = 1 << 17
#: Words whose counts a task holds before it hands them on.
HELD = 1 << 18
SWEEPS = 6
ADDED = 0.1
ENDING = 4
_U = np.uint64


class Listed:
    """Position of a hash among the listed ones, by a direct table and a search where two share a slot."""

    def __init__(self, hashes: np.ndarray, bits: int = 21):
        self.hashes, self._bits, self._shift = np.sort(hashes), bits, _U(64 - bits)
        self._slot = np.full(1 << bits, -1, np.int32)
        at = (self.hashes >> self._shift).astype(np.int64)
        self._slot[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        self._shared = np.zeros(1 << bits, bool)
        self._shared[at[1:][at[1:] == at[:-1]]] = True

    def __reduce__(self):
        return Listed, (self.hashes, self._bits)  # tasks make the table themselves

    def find(self, x: np.ndarray) -> np.ndarray:
        """-1 where a hash isn't listed."""
        if not len(self.hashes):
            return np.full(len(x), -1, np.int64)
        slot = (x >> self._shift).astype(np.int64)
        at = self._slot[slot].astype(np.int64)
        at[(at < 0) | (self.hashes[np.maximum(at, 0)] != x)] = -1
        again = np.flatnonzero((at < 0) & self._shared[slot])
        if len(again):
            i = np.minimum(np.searchsorted(self.hashes, x[again]), len(self.hashes) - 1)
            at[again] = np.where(self.hashes[i] == x[again], i, -1)
        return at


def _ending(eight: np.ndarray, end: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """16-bit key of a word's last bytes."""
    return (mix((eight[end - length] & _U((1 << 8 * length) - 1)) + _U(length)) >> _U(48)).astype(np.int64)


class Endings:
    """Class by the longest known ending of a word."""

    def __init__(self, words: list[bytes], classes: np.ndarray, weights: np.ndarray, count: int):
        self.tables = {}
        data, start, end, size = _spread(words)
        for length in range(1, ENDING + 1):
            fit = size >= length
            key = _ending(data, end[fit], size[fit], length)
            votes = np.bincount(key * count + classes[fit], weights[fit], (1 << 16) * count).reshape(1 << 16, count)
            self.tables[length] = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), -1).astype(np.int16)
        self.default = int(np.bincount(classes, weights, count).argmax()) if len(classes) else 0

    def classes(self, eight: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.full(len(end), self.default, np.int64)
        for length in range(1, ENDING + 1):
            fit = np.flatnonzero(size >= length)
            if len(fit):
                found = self.tables[length][_ending(eight, end[fit], size[fit], length)]
                out[fit] = np.where(found >= 0, found, out[fit])
        return out


def _eight(data: np.ndarray) -> np.ndarray:
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _spread(words: list[bytes]):
    size = np.array([len(x) for x in words], np.int64)
    end = np.cumsum(size)
    return _eight(np.frombuffer(b"".join(words), np.uint8)), end - size, end, size


class Model:
    """What all tasks get; a hash and a class for each clustered word, the rest is fixed by the parameters above."""

    def __init__(self, listed: Listed, listed_class: np.ndarray, further: Listed, further_class: np.ndarray, endings: Endings, classes: int):
        self.listed, self.listed_class, self.endings = listed, listed_class, endings
        self.further, self.further_class = further, further_class
        self.classes, self.end, self.start = classes, classes, classes + 1

    def tokens(self, words: Words):
        """Listed position and class of all words."""
        hashes = words.hashes()
        at = self.listed.find(hashes)
        kind = np.append(self.listed_class, 0)[at].astype(np.int64)
        rare = np.flatnonzero(at < 0)
        place = self.further.find(hashes[rare])
        kind[rare] = np.append(self.further_class, 0)[place]
        rare = rare[place < 0]
        if len(rare):
            kind[rare] = self.endings.classes(_eight(words.data), words.end[rare], (words.end - words.start)[rare])
        return hashes, at, kind

    def with_ends(self, words: Words, kind: np.ndarray):
        """Classes with the end of each document, those before them, and the document of each."""
        n, docs = words.counts, np.arange(len(words.counts))
        places = words.first[1:] + docs  # of the ends
        now = np.full(len(kind) + len(docs), self.end, np.int64)
        inside = np.ones(len(now), bool)
        inside[places] = False
        now[inside] = kind
        before = np.empty(len(now), np.int64)
        before[1:] = now[:-1]
        before[words.first[:-1] + docs] = self.start
        return now, before, np.repeat(docs, n + 1)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words that make a class bigram model likely: each word in turn moves to its best class.

    ``bigrams[a, b]`` counts word b after word a.  The gain is the change of
    sum n(c, d) log n(c, d) - sum n(c, .) log n(c, .) - sum n(., d) log n(., d).
    """
    words = len(bigrams)
    of = np.arange(words) % classes
    member = np.eye(classes)[of]
    table = member.T @ bigrams @ member
    after, before = bigrams @ member, bigrams.T @ member  # by word: class that follows, that comes before

    def f(x):
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, loop = of[w], bigrams[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= loop
            into[a] -= loop
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= loop
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            n_out, n_in = out.sum() + loop, into.sum() + loop
            fixed = f(table)
            # into class c: row c gains out, column c gains into; their crossing gains both and the loop
            gain = (f(table + out) - fixed).sum(axis=1) + (f(table + into[:, None]) - fixed).sum(axis=0)
            crossing = np.diag(table)
            gain += f(crossing + out + into + loop) - f(crossing + out) - f(crossing + into) + f(crossing)
            gain -= f(rows + n_out) - f(rows) + f(columns + n_in) - f(columns)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += loop
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[:, a] -= bigrams[w]
                before[:, b] += bigrams[w]
        if not moved:
            break
    return of


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    keys, counts, tails = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return keys, np.bincount(back, counts, len(keys)).astype(np.int64), tails[first]


def _words(batches):
    """Counts of all words, in parts that add up to them, and their last bytes: low ones the bytes, above them how many."""

    def rows(keys, counts, tails):
        for a in range(0, len(keys), 50_000):
            cut = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[cut])), pa.array(counts[cut]), pa.array(tails[cut])], ["word", "n", "tail"])

    held, pending = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in chunks(batches):
        words = Words(batch.column("text"), lower=True)
        own, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
        end = words.end[first]
        size = np.minimum(end - words.start[first], ENDING)
        tail = _eight(words.data)[end - size] & ((_U(1) << (_U(8) * size.astype(np.uint64))) - _U(1))
        held.append((own, n, tail.astype(np.int64) + (size.astype(np.int64) << 8 * ENDING)))
        pending += len(own)
        if pending > max(HELD // 4, len(held[0][0])):
            held, pending = [_merged(held)], 0
            if len(held[0][0]) > HELD:
                yield from rows(*held[0])
                held = [tuple(x[:0] for x in held[0])]
    yield from rows(*_merged(held))


def _bigrams(clustered: Listed):
    """Counts of neighbours among clustered words, from training texts."""
    k = len(clustered.hashes)

    def apply(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=True)
            at = clustered.find(words.hashes())
            same = np.ones(max(len(at) - 1, 0), bool)
            starts = words.first[1:-1]
            same[starts[(starts > 0) & (starts < len(at))] - 1] = False
            pair = np.flatnonzero(same & (at[:-1] >= 0) & (at[1:] >= 0)) if len(at) > 1 else np.zeros(0, np.int64)
            own, n = np.unique(at[pair] * k + at[pair + 1], return_counts=True)
            merged, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(merged)).astype(np.int64)
            keys = merged
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000]), pa.array(counts[a : a + 50_000])], ["pair", "n"])

    return apply


def _contexts(seeds: Listed, seed_class: np.ndarray, further: Listed, classes: int):
    """How often the seeds of each class come after (slots from 0) and before (from ``classes``) each further word, from training texts."""
    slots = 2 * classes

    def apply(batches):
        keys, counts, parts, pending = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every, back = np.unique(np.concatenate([keys, *[x for x, _ in parts]]), return_inverse=True)
            return every, np.bincount(back, np.concatenate([counts, *[n for _, n in parts]]), len(every)).astype(np.int64)

        def rows():
            for a in range(0, len(keys), 50_000):
                key = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(key // slots), pa.array((key % slots).astype(np.int32)), pa.array(counts[a : a + 50_000])], ["place", "slot", "n"])

        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=True)
            hashes = words.hashes()
            if len(hashes) < 2:
                continue
            seed = seeds.find(hashes)
            place = further.find(hashes)
            kind = np.append(seed_class, 0)[seed]
            same = np.ones(len(hashes) - 1, bool)
            starts = words.first[1:-1]
            same[starts[(starts > 0) & (starts < len(hashes))] - 1] = False
            left = np.flatnonzero(same & (place[:-1] >= 0) & (seed[1:] >= 0))
            right = np.flatnonzero(same & (seed[:-1] >= 0) & (place[1:] >= 0)) + 1
            parts.append(np.unique(np.concatenate([place[left] * slots + kind[left + 1], place[right] * slots + classes + kind[right - 1]]), return_counts=True))
            pending += len(parts[-1][0])
            if pending > max(HELD // 4, len(keys)):
                keys, counts = merged()
                parts, pending = [], 0
                if len(keys) > HELD:
                    yield from rows()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield from rows()

    return apply


def best_classes(table: np.ndarray, out: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The class into which each further word is exchanged: the gain of ``exchange`` with the classes' counts as they are.

    ``out[w, c]`` and ``into[w, c]`` count class c after and before word w.
    """

    def f(x):
        return x * np.log(np.maximum(x, 1e-12))

    rows, columns, crossing, fixed = table.sum(axis=1), table.sum(axis=0), np.diag(table), f(table)
    best = np.zeros(len(out), np.int64)
    for a in range(0, len(out), 256):
        o, i = out[a : a + 256], into[a : a + 256]
        gain = (f(table + o[:, None, :]) - fixed).sum(axis=2) + (f(table + i[:, :, None]) - fixed).sum(axis=1)
        gain += f(crossing + o + i) - f(crossing + o) - f(crossing + i) + f(crossing)
        gain -= f(rows + o.sum(axis=1, keepdims=True)) - f(rows) + f(columns + i.sum(axis=1, keepdims=True)) - f(columns)
        best[a : a + 256] = gain.argmax(axis=1)
    return best


def _exchanged(table: np.ndarray):
    """Classes of words from their contexts, gathered by word."""
    classes = len(table)

    def apply(batches):
        for batch in batches:
            slots, n = batch.column("slots"), batch.column("times")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
            held = np.zeros((batch.num_rows, 2 * classes))
            np.add.at(held, (owner, slots.flatten().to_numpy(zero_copy_only=False)), n.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(best_classes(table, held[:, :classes], held[:, classes:]).astype(np.int32))], ["place", "class"])

    return apply


def _counts(model: Model):
    """Class transitions (negative keys) and listed words, from training texts."""
    k = model.classes + 2

    def apply(batches):
        steps, words_seen = np.zeros(k * k, np.int64), np.zeros(len(model.listed.hashes), np.int64)
        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=True)
            _, at, kind = model.tokens(words)
            now, before, _ = model.with_ends(words, kind)
            steps += np.bincount(before * k + now, minlength=k * k)
            words_seen += np.bincount(at[at >= 0], minlength=len(words_seen))
        i, j = np.flatnonzero(steps), np.flatnonzero(words_seen)
        key, n = np.concatenate([-1 - i, j]), np.concatenate([steps[i], words_seen[j]])
        for a in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 50_000]), pa.array(n[a : a + 50_000])], ["key", "n"])

    return apply


def _sums(model: Model, log_step: np.ndarray, listed_log: np.ndarray, listed_seen: np.ndarray, end_log: float):
    """A row for each document with its sums over listed words and classes, and one for each of its rare words."""
    k = model.classes + 1

    def apply(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in chunks(batches):
            words = Words(batch.column("text"), lower=True)
            hashes, at, kind = model.tokens(words)
            now, before, owner = model.with_ends(words, kind)
            docs = batch.num_rows
            word_owner = words.documents()
            hit = at >= 0
            steps = np.bincount(owner, log_step[before, now], docs)
            logs = np.bincount(word_owner[hit], listed_log[at[hit]], docs) + end_log
            known = np.bincount(word_owner[hit], listed_seen[at[hit]], docs).astype(np.int64) + 1
            by_class = np.bincount(owner * k + now, minlength=docs * k).astype(np.int32)
            ids = number + np.arange(docs)
            number += docs
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column("row"), batch.column("held_out"), pa.array(words.counts + 1), pa.array(known), pa.array(logs), pa.array(steps), pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * k), pa.array(by_class)), pa.nulls(docs, pa.int64()), pa.nulls(docs, pa.int32())],
                ["id", "row", "held_out", "n_tokens", "known", "logs", "steps", "by_class", "word", "class"],
            )
            rare = np.flatnonzero(~hit)
            if len(rare):
                order = rare[np.lexsort((hashes[rare], word_owner[rare]))]
                own, doc = hashes[order], word_owner[order]
                lead = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
                times = np.diff(np.append(lead, len(order)))
                n = len(lead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc[lead]]), pa.nulls(n, batch.schema.field("row").type), batch.column("held_out").take(pa.array(doc[lead])), pa.array(times), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(signed(own[lead])), pa.array(kind[order[lead]].astype(np.int32))],
                    ["id", "row", "held_out", "n_tokens", "known", "logs", "steps", "by_class", "word", "class"],
                )

    return apply


def score_documents(docs: DataFrame, folds: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, listed: int = LISTED) -> DataFrame:
    """Log10 probability of every document under a class model learned from the training documents.

    Documents whose ``crc32(id) % folds`` is ``held_out`` are scored but not learned from.
    Tokens are lower-cased words and an end.  Returns ``row`` (the columns of ``docs`` but
    for the text), ``held_out``, ``n_tokens``, ``n_known`` (seen in training),
    ``train_tokens``, ``base_score`` (unigrams, 0.1 added to each count) and ``score``.

    * null or empty text: the end token alone;
    * null id: never learned from, counted as held out;
    * no training document: every token is unknown, scores come from the smoothing alone;
    * ties: equally frequent words in the order of their hashes, equally good classes the lower one;
    * very long texts and words: whole, held by one task at a time;
    * other columns keep their names inside ``row``, so none can clash;
    * repeated rows count as often as they are there; an empty table gives an empty table.
    """
    fold = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.coalesce(fold == held_out, F.lit(True)).alias("held_out"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    training = given.where("not held_out").select("text")

    found = training.mapInArrow(_words, "word long, n long, tail long").groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))
    found = written(found, "words")
    top = most_frequent(found, "n", "word", max(listed, clustered))
    hashes, weights = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64)
    spelled = [(x & ((1 << 8 * ENDING) - 1)).to_bytes(ENDING, "little")[: x >> 8 * ENDING] for x in top["tail"].tolist()]  # their ends
    k = min(clustered, len(hashes))
    classes = max(1, min(classes, k))
    small = Listed(hashes[:k])
    by_hash = np.argsort(hashes[:k])
    pairs = training.mapInArrow(_bigrams(small), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # clustered**2 rows at most
    bigrams = np.zeros(max(k * k, 1))
    bigrams[pairs["pair"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.float64)
    frequent_first = np.argsort(by_hash)  # small's positions, most frequent word first
    square = bigrams.reshape(max(k, 1), -1)[np.ix_(frequent_first, frequent_first)] if k else np.zeros((0, 0))
    of = exchange(square, classes) if k else np.zeros(0, np.int64)
    member = np.eye(classes)[of] if k else np.zeros((0, classes))
    seed_class = of[by_hash]
    further = found.where(F.col("n") >= FROM).select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64)  # 8 bytes for each clustered word
    further = Listed(np.setdiff1d(further, hashes[:k]))
    contexts = training.mapInArrow(_contexts(small, seed_class, further, classes), "place long, slot int, n long").groupBy("place", "slot").agg(F.sum("n").alias("n"))
    gathered = contexts.groupBy("place").agg(F.collect_list(F.struct("slot", "n")).alias("x")).select("place", F.col("x.slot").alias("slots"), F.col("x.n").alias("times"))
    moved = gathered.mapInArrow(_exchanged(member.T @ square @ member), "place long, class int").toPandas()
    further_class = np.full(len(further.hashes), -1, np.int64)
    further_class[moved["place"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int64)
    further, further_class = Listed(further.hashes[further_class >= 0]), further_class[further_class >= 0]  # without a seed beside it: by its ending

    at = further.find(hashes)
    listed_class = np.append(further_class, -1)[at]
    listed_class[:k] = of
    clear = np.flatnonzero(listed_class >= 0)
    endings = Endings([spelled[i] for i in clear], listed_class[clear], weights[clear], classes)
    data, start, end, size = _spread(spelled)
    listed_class = np.where(listed_class >= 0, listed_class, endings.classes(data, end, size))
    order = np.argsort(hashes[:listed])
    seeds_beyond = np.arange(listed, k)  # seeds that aren't listed
    beyond = np.concatenate([further.hashes, hashes[seeds_beyond]])
    by_hash = np.argsort(beyond)
    table = Listed(hashes[:listed])
    model = Model(table, listed_class[:listed][order], Listed(beyond), np.concatenate([further_class, listed_class[seeds_beyond]])[by_hash], endings, classes)

    counted = training.mapInArrow(_counts(model), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # listed words and classes**2 rows at most
    key, n = counted["key"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    every = classes + 2
    steps = np.zeros(every * every)
    steps[-1 - key[key < 0]] = n[key < 0]
    steps = steps.reshape(every, every)[:, :-1]  # nothing goes to the start
    log_step = np.log10((steps + 0.5) / (steps.sum(axis=1, keepdims=True) + 0.5 * steps.shape[1]))
    seen = np.zeros(len(table.hashes))
    seen[key[key >= 0]] = n[key >= 0]
    ends = steps[:, model.end].sum()

    out = StructType().add("id", LongType()).add("row", given.schema["row"].dataType).add("held_out", BooleanType())
    for name, kind in (("n_tokens", LongType()), ("known", LongType()), ("logs", DoubleType()), ("steps", DoubleType()), ("by_class", ArrayType(IntegerType())), ("word", LongType()), ("class", IntegerType())):
        out = out.add(name, kind)
    rows = written(given.mapInArrow(_sums(model, log_step, np.log10(seen + ADDED), (seen > 0).astype(np.float64), float(np.log10(ends + ADDED))), out), "sums")
    documents, rare = rows.where("word is null"), rows.where("word is not null")

    total = rare.groupBy("word").agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens")).otherwise(0)).alias("c"), F.first("class").alias("class"))
    by_class = total.where("c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    tokens, types = np.zeros(classes + 1), np.zeros(classes + 1)
    np.add.at(tokens, by_class["class"].to_numpy(np.int64), by_class["c"].to_numpy(np.float64))
    np.add.at(types, by_class["class"].to_numpy(np.int64), by_class["v"].to_numpy(np.float64))
    np.add.at(tokens, model.listed_class, seen)
    np.add.at(types, model.listed_class, (seen > 0).astype(np.float64))
    tokens[model.end], types[model.end] = ends, ends > 0
    all_tokens, all_types = int(tokens.sum()), int(types.sum())
    below = np.log10(tokens + ADDED * (types + 1))

    # A rare word's count goes back to its documents; no word here is frequent, so no key is hot.
    added = rare.select("id", "word", "n_tokens").join(total.select("word", "c"), "word").groupBy("id").agg(F.sum(F.col("n_tokens") * F.log10(F.col("c") + ADDED)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n_tokens")).otherwise(0)).alias("rare_known"))
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    weights_of = F.array(*[F.lit(float(x)) for x in below])
    emission = F.aggregate(F.zip_with("by_class", weights_of, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # Without any training document the end isn't known either.
    known = F.col("known") - (0 if ends else 1) + F.coalesce("rare_known", F.lit(0))
    return documents.join(added, "id", "left").select(
        "row",
        "held_out",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(all_tokens + ADDED * (all_types + 1)))).alias("base_score"),
        (logs + F.col("steps") - emission).alias("score"),
    )
