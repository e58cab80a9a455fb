"""Packing of token pieces into sequences by bin completion.

Lengths are whole numbers up to the sequence length, so the whole corpus is one small
histogram: the search runs on counts by length, and its size doesn't depend on the
number of documents.  A bin is completed around the largest piece that is left: the
undominated fillings of the gap are enumerated, tried in the order of their waste, and
branches are cut whose waste can't beat the best solution so far; best-fit decreasing
gives the first one.  A filling is applied as often as the counts allow.  The plan then
hands each piece its place from its length and its rank among the pieces of that length.

The search is bounded: a few descents that leave the first filling late, then branch and
bound over all undominated fillings, each at every multiplicity, with a lower bound at
every node.  Histograms whose tree fits the budget are settled exactly; others keep the
best solution found.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from denspark.llm.runs import column
from denspark.storage import checkpointed
from denspark.llm.tokens import Encoder
from denspark.llm.words import chunks

#: Branches of bin completion that are looked at before the best solution so far is taken.
NODES = 4000
#: Fillings of one gap that are tried on a descent.
WIDTH = 12
#: Work of branch and bound: steps of enumeration, comparisons of fillings, and lengths at each node.
WORK = 1_000_000
#: Steps in which the fillings of one gap are enumerated.
STEPS = 4000

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that any packing needs: by volume, and by pieces that can't share a bin (Martello and Toth)."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(x)] for x in lengths], np.int64)
    if not n.sum():
        return 0
    best = -(-int((lengths * n).sum()) // size)
    for least in [0, *lengths[lengths <= size // 2].tolist()]:
        alone = int(n[lengths > size - least].sum())
        large = (lengths > size // 2) & (lengths <= size - least)
        small = (lengths >= least) & (lengths <= size // 2)
        room = int(n[large].sum()) * size - int((lengths * n)[large].sum())
        rest = int((lengths * n)[small].sum()) - room
        best = max(best, alone + int(n[large].sum()) + max(0, -(-rest // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing on the histogram; equal bins are kept together."""
    bins: dict[int, Counter] = {}
    rooms: list[int] = []

    def add(filling: tuple[int, ...], room: int, n: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            bisect.insort(rooms, room)
        bins[room][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                many = size // length  # new bins, filled up with this length
                full, rest = divmod(left, many)
                if full:
                    add((length,) * many, size - many * length, full)
                if rest:
                    add((length,) * rest, size - rest * length, 1)
                break
            room = rooms[i]
            filling, n = next(iter(bins[room].items()))
            k = min(n, left)
            bins[room][filling] -= k
            if not bins[room][filling]:
                del bins[room][filling]
                if not bins[room]:
                    del bins[room]
                    rooms.pop(i)
            add((*filling, length), room - length, k)
            left -= k
    return [(filling, n) for room in sorted(bins) for filling, n in bins[room].items()]


def fillings(counts: dict[int, int], lengths: list[int], gap: int) -> list[tuple[int, ...]]:
    """Up to WIDTH undominated fillings of a gap, least waste first: a first piece of the 4 * WIDTH largest lengths that fit, and what best fit adds.

    A filling is dominated if another one has a piece that can stand for several of its
    pieces; so a single piece that fits exactly leaves no others.
    """
    if counts.get(gap):
        return [(gap,)]

    def largest(upto: int, used: tuple[int, ...]) -> int:
        i = bisect.bisect_right(lengths, upto)
        while i:
            i -= 1
            x = lengths[i]
            if counts[x] > used.count(x):
                return x
        return 0

    found: dict[tuple[int, ...], int] = {}
    i = bisect.bisect_right(lengths, gap)
    for x in reversed(lengths[max(0, i - 4 * WIDTH) : i]):
        filling, room = (x,), gap - x
        if counts[x] < 1:
            continue
        while room and (y := largest(room, filling)):
            filling, room = (*filling, y), room - y
        found.setdefault(tuple(sorted(filling, reverse=True)), room)
        if not room and len(filling) <= 2:
            break
    kept: list[tuple[int, ...]] = []
    for filling in sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f))):
        if not any(_dominates(other, filling) for other in kept):
            kept.append(filling)
        if len(kept) == WIDTH:
            break
    return kept


def undominated(counts: dict[int, int], gap: int, steps: int = STEPS) -> tuple[list[tuple[int, ...]], int]:
    """All undominated fillings of a gap, least waste first, or as many as ``steps`` give; and the work it took.

    No piece that is left fits beside the pieces of a filling.
    """
    given = steps
    lengths = sorted(x for x, n in counts.items() if n and x <= gap)
    if counts.get(gap):
        return [(gap,)], 1
    found: list[tuple[int, ...]] = []
    stack: list[tuple[tuple[int, ...], int, int]] = [((), gap, len(lengths))]
    while stack and steps:
        steps -= 1
        filling, room, upto = stack.pop()
        fits = False
        for i in range(min(upto, bisect.bisect_right(lengths, room))):
            x = lengths[i]
            if counts[x] > filling.count(x):
                fits = True
                stack.append(((*filling, x), room - x, i + 1))
        if not fits and not any(x <= room and counts[x] > filling.count(x) for x in lengths):
            found.append(filling)
    kept: list[tuple[int, ...]] = []
    for filling in sorted(found, key=lambda f: (-sum(f), len(f), tuple(-x for x in f))):
        if steps > -given and not any(_dominates(other, filling) for other in kept):
            kept.append(filling)
        steps -= len(kept)
    return kept, given - steps


def _branch_and_bound(counts: dict[int, int], size: int, bound: int, best: Plan, fewest: int) -> Plan:
    """The best plan that WORK finds by completing the bin of the largest piece in every undominated way."""
    work = WORK

    def children(left: dict[int, int], used: int, done):
        nonlocal work
        top = max(left)
        left = dict(left)
        left[top] -= 1
        choices, took = undominated(left, size - top)
        work -= took
        for filling in choices or [()]:
            need = Counter((top, *filling))
            left[top] += 1
            most = min(left[x] // k for x, k in need.items())
            left[top] -= 1
            for n in range(most, 0, -1):
                rest = {x: m - n * need[x] + (x == top) for x, m in left.items()}
                yield {x: m for x, m in rest.items() if m}, used + n, ((top, *filling), n, done)

    stack = [children(counts, 0, None)] if counts else []
    while stack and work > 0 and fewest > bound:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            continue
        left, used, done = child
        work -= 10 * len(left)
        if not left:
            if used < fewest:
                fewest, best = used, []
                while done:
                    best.append((done[0], done[1]))
                    done = done[2]
        elif used + lower_bound(left, size) < fewest:
            stack.append(children(left, used, done))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b can be laid into those of a, as bins, first fit; each piece of a is used up once."""
    if sum(a) < sum(b):
        return False
    room = list(a)
    for x in b:
        for i, y in enumerate(room):
            if x <= y:
                room[i] -= x
                break
        else:
            return False
    return True


def bin_completion(counts: dict[int, int], size: int, nodes: int = NODES) -> Plan:
    """As few bins as the search finds; it ends where the lower bound is met, or where the descents' ``nodes`` and WORK are used up."""
    counts = {k: v for k, v in counts.items() if v}
    bound = lower_bound(counts, size)
    best = best_fit(counts, size)
    fewest = sum(n for _, n in best)
    total = sum(k * v for k, v in counts.items())

    def solve(left: dict[int, int], lengths: list[int], used: int, done: Plan, remaining: int, late: int) -> None:
        """late: how many more times a filling other than the first may be taken (limited discrepancy)."""
        nonlocal best, fewest, budget
        while lengths:
            if fewest == bound or budget <= 0 or used + -(-remaining // size) >= fewest:
                return
            budget -= 1
            top = lengths[-1]
            left[top] -= 1
            choices = fillings(left, lengths, size - top) or [()]
            left[top] += 1
            if late and left[top] and len(choices) > 1:
                for i, other in enumerate(choices[1:], 1):
                    if i > late:
                        break
                    apply(dict(left), lengths, top, other, used, done, remaining, late - i)
            taken, n = _take(left, top, choices[0])
            done = [*done, (taken, n)]
            used += n
            remaining -= n * sum(taken)
            lengths = [x for x in lengths if left[x]]
        if used < fewest:
            best, fewest = done, used

    def apply(left, lengths, top, filling, used, done, remaining, late) -> None:
        taken, n = _take(left, top, filling)
        solve(left, [x for x in lengths if left[x]], used + n, [*done, (taken, n)], remaining - n * sum(taken), late)

    for late in range(3):
        budget = nodes
        if fewest > bound:
            solve(dict(counts), sorted(counts), 0, [], total, late)
    return _branch_and_bound(counts, size, bound, best, fewest) if fewest > bound else best


def _take(left: dict[int, int], top: int, filling: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Use a completed bin as often as the counts allow."""
    taken = (top, *filling)
    need = Counter(taken)
    n = min(left[x] // k for x, k in need.items())
    for x, k in need.items():
        left[x] -= n * k
    return taken, n


def _cut_pieces(path: str, size: int, end_id: int, with_ids: bool):
    def apply(batches):
        from pyspark import TaskContext

        encoder, part = Encoder(path), TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, np.int64)
        for batch in chunks(batches, size=1 << 20):  # parts are Python strings, some ten times the text
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            total = counts + 1
            pieces = -(-total // size)
            first = total - (pieces - 1) * size
            document = np.repeat(np.arange(len(total)), pieces)
            number = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.where(number == 0, first[document], size)
            start = np.where(number == 0, 0, first[document] + (number - 1) * size)
            at = np.repeat(np.cumsum(total) - total, pieces) + start
            raw = memoryview(ids.tobytes())
            cut = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            run = np.append(True, length[order][1:] != length[order][:-1])
            lead = np.flatnonzero(run)
            rank = np.empty(len(length), np.int64)
            rank[order] = ranks[length[order]] + np.arange(len(order)) - np.repeat(lead, np.diff(np.append(lead, len(order))))
            ranks += np.bincount(length, minlength=size + 1)
            columns = {
                "row": batch.column("row").take(pa.array(document)),
                "piece": pa.array(number.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                "part": pa.array(np.full(len(length), part)),
                "rank": pa.array(rank),
            }
            if with_ids:
                columns["ids"] = pa.array([bytes(x) for x in cut], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return apply


def _placed(plan: Plan):
    """Sequence and offset for each piece from its length and global rank."""
    rows, given, sequence = [], Counter(), 0
    for filling, n in plan:
        offset = 0
        for length in filling:
            rows.append((length, given[length], sequence, offset))
            given[length] += n
            offset += length
        sequence += n
    rows.sort()
    length, start, sequences, offsets = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
    key = (length << 44) + start

    def apply(batches):
        for batch in batches:
            own, rank = column(batch, "length"), column(batch, "rank") + column(batch, "before")
            i = np.searchsorted(key, (own << 44) + rank, "right") - 1
            names = [x for x in batch.schema.names if x not in ("part", "rank", "before")]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(sequences[i] + rank - start[i]), pa.array(offsets[i])],
                [*names, "sequence_id", "offset"],
            )

    return apply


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of at most ``size`` tokens and place them into few sequences.

    A document is its text's ids and then ``end_id``.  Only longer ones are cut, into pieces
    of ``size``; the first may be shorter.  Returns a row for each piece: ``row`` (the columns
    of ``docs`` but for the text), ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` and, if asked for, ``ids`` as little-endian 32-bit numbers.

    Null and empty texts are the end token alone; null ids are as good as any.  Repeated rows
    are documents of their own.  Ties are placed in the order of tasks and rows.  Other
    columns stay inside ``row``, so no name can clash.  A very long text is many pieces, held
    by one task at a time.  An empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    given = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

    out = StructType([given.schema["row"]]).add("piece", IntegerType())
    for name in ("start", "length", "ids_crc32", "part", "rank"):
        out = out.add(name, LongType())
    if with_ids:
        out = out.add("ids", BinaryType())
    # A piece's rank depends on the order of rows in a task: written once, it can't change when a task runs again.
    pieces = checkpointed(given.mapInArrow(_cut_pieces(tokenizer, size, end_id, with_ids), out))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    plan = bin_completion(counts, size)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))
    placed = StructType([f for f in out.fields if f.name not in ("part", "rank")]).add("sequence_id", LongType()).add("offset", LongType())
    return pieces.join(before, ["part", "length"]).select(*[c for c in pieces.columns], "before").mapInArrow(_placed(plan), placed)
