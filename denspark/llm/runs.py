"""Streams over partitions that are sorted by a key: constant memory for any length of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def repeated(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the rows whose key occurs twice or more; rows come sorted by the key."""

    def apply(batches):
        held: pa.RecordBatch | None = None  # one row, whose key has come once so far
        shown = None  # the last key, where it has come twice or more
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
            k = column(batch, key)
            same = k[1:] == k[:-1]
            keep = np.zeros(len(k), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if shown is not None:
                head = int(np.argmax(k != shown)) if (k != shown).any() else len(k)
                keep[:head] = True
            if keep[-1]:
                shown = k[-1]
            else:
                shown, held = None, batch.slice(len(k) - 1, 1)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return apply


def run_heads(k: np.ndarray, last) -> np.ndarray:
    """True where a run of equal keys begins; ``last`` is the key before the first, or None."""
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    if last is not None and len(k):
        head[0] = k[0] != last
    return head
