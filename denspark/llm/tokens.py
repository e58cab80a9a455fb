"""Byte-level BPE ids for whole batches of texts.

The vocabulary is the JSON file of a public byte-level BPE tokenizer.  Such a tokenizer
never joins bytes across a single space that a visible character follows, so a text is
cut there, and each distinct part is encoded once for as long as a bounded cache holds
it.  Strings of added tokens are cut out of the text first and get their own ids.  The ids
are those of the ``tokenizers`` library on the whole text; a test holds the two against
each other.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Distinct parts that a worker remembers.
CACHE_PARTS = 400_000
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


def _byte_of_letter() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stays, the rest moves up from 256."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in stays]
    return {chr(b): b for b in stays} | {chr(256 + i): b for i, b in enumerate(moved)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        added = described.get("added_tokens", [])
        if any(x.get(c) for x in added for c in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what stands beside them aren't supported")
        special = {x["content"]: x["id"] for x in added}
        self._special = special
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in described["model"]["vocab"].items() if piece not in special}
        self._bpe = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self._bytes[i] = len(piece)
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._pool = np.zeros(1 << 20, np.uint32)
        self._used = 0
        self._at = np.zeros(1 << 16, np.int64)
        self._size = np.zeros(1 << 16, np.int64)
        for content, i in self._special.items():  # as a part of its own; no other part can be equal to it
            k = len(self._number)
            self._number[content], self._pool[k], self._at[k], self._size[k] = k, i, k, 1
        self._used = len(self._number)

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts. One that starts a text has a space before it as its key, others have none."""
        inside = [x for x in parts if x[:1] != " "]
        bulk = np.array(self._bpe.encode_ordinary(" " + " ".join(inside)) if inside else [], np.uint32)
        ends = np.cumsum([len(x.encode()) + 1 for x in inside], dtype=np.int64)
        sizes = np.diff(np.searchsorted(np.cumsum(self._bytes[bulk]), ends, "right"), prepend=0)
        alone = [self._bpe.encode_ordinary(x[1:]) for x in parts if x[:1] == " "]
        ids = np.concatenate([bulk, np.array([i for x in alone for i in x], np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in alone], np.int64)])
        n, known = len(parts), len(self._number)
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while known + n > len(self._at):
            self._at, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._at, self._size))
        self._pool[self._used : self._used + len(ids)] = ids
        self._at[known : known + n] = self._used + np.cumsum(sizes) - sizes
        self._size[known : known + n] = sizes
        self._used += len(ids)
        self._number.update(zip([*inside, *(x for x in parts if x[:1] == " ")], range(known, known + n), strict=True))

    @staticmethod
    def _parts(text: str) -> list[str]:
        own = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        own[0] = " " + own[0]
        return own

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self._number) > CACHE_PARTS:
            self._clear()
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            before = len(parts)
            if any(x in text for x in self._special):
                for k, piece in enumerate(self._added.split(text)):
                    if k % 2:
                        parts.append(piece)
                    elif piece:
                        parts += self._parts(piece)
            else:
                parts += self._parts(text)
            counts[i] = len(parts) - before
        new = set(parts).difference(self._number)
        if new:
            self._learn(sorted(new))
        codes = np.fromiter(map(self._number.__getitem__, parts), np.int64, len(parts))
        size = self._size[codes]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self._pool[np.repeat(self._at[codes] - (upto - size), size) + np.arange(total)]
        per_part = np.append(0, upto)
        ends = np.cumsum(counts)
        return ids, per_part[ends] - per_part[ends - counts]
