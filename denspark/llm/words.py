"""Whole-batch byte, word and hash primitives on Arrow string columns.

A batch of texts is looked at as one UTF-8 byte buffer with document offsets, so
that cutting into words, lower-casing and hashing are a few NumPy passes over the
bytes and never a Python step per word.  Words are the runs ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64-bit and the same in every process and at every size.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at in one go, which bounds a task's memory.
CHUNK_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Words of more bytes get a cryptographic hash, which bounds the passes over a batch.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[: n + 1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; a null is an empty text."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    n = len(texts)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system; a worker that is used again otherwise keeps the most that any task before held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc's
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text, one whole document at least."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a batch: ``start`` and ``end`` in ``data``, and ``first[i]:first[i+1]`` are those of document i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.offsets = text_buffer(texts)
        self.data = LOWER[data] if lower else data
        n = len(data)
        if n:
            apart = SEPARATOR[data]
            edge = np.zeros(n + 1, bool)
            edge[self.offsets] = True
            before = np.empty(n, bool)
            before[0], before[1:] = True, apart[:-1]
            after = np.empty(n, bool)
            after[-1], after[:-1] = True, apart[1:]
            self.start = np.flatnonzero(~apart & (before | edge[:-1]))
            self.end = np.flatnonzero(~apart & (after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def documents(self) -> np.ndarray:
        """Number of the document, for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = self.end - self.start
        out = mix((eight[self.start] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at = 8
        while len(more):
            part = eight[self.start[more] + at] & _KEEP[np.minimum(size[more] - at, 8)]
            out[more] = mix(out[more] * _STEP + part)
            at += 8
            more = more[size[more] > at]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; len(words) - k + 1 of them, across documents too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : n + i]
    return mix(out)


def sequence_hash(words: np.ndarray, seed: int = 0) -> int:
    """Order-dependent hash of a whole word sequence."""
    n = len(words)
    step = _U((0xD1B54A32D192ED03 + 2 * seed) % (1 << 64))
    total = np.sum(mix(words + _U(seed)) * powers(step, n)[:n], dtype=np.uint64) + _U(n)
    return int(mix(np.array([total]))[0])


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
