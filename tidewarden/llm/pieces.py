"""Texts cut at spaces and handled per distinct chunk.

A chunk is a space and what follows up to the next one; the first has no space. Every chunk gets a
number, the work on a chunk is done once, and numpy puts the results in the places of the chunk.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

_FIRST = "\0"
_LATEST: list = []
_CUT = re.compile(r"(?<=\S)(?= )")


def remember_only(owner) -> None:
    """One worker serves many jobs: whatever another one remembers is forgotten. None: everything."""
    if _LATEST and _LATEST[0] is not owner:
        _LATEST[0]._forget()
    _LATEST[:] = [] if owner is None else [owner]


class Chunks(dict):
    """Numbers of chunks, and the items (of one dtype) that work gives for each chunk as raw bytes.

    Keys are chunks without their space, or with a mark in front if they have none. What is remembered
    is bounded: beyond the bound all of it is forgotten, between two calls.
    """

    def __init__(self, work, dtype: str = "<u4", bound: int = 500_000, forget_too=lambda: None):
        super().__init__()
        self.work, self.dtype, self.bound, self.forget_too = work, np.dtype(dtype), bound, forget_too
        self._empty()

    def _forget(self):
        self._empty()
        self.forget_too()

    def _empty(self):
        self.clear()
        self.new: list[str] = []
        self.flat, self.first, self.size, self.odd = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def __missing__(self, key):
        number = self[key] = len(self)
        self.new.append(key)
        return number

    def _numbers(self, keys: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self.new:
            new, self.new = self.new, []
            parts = self.work([k[1:] if k[:1] == _FIRST else " " + k for k in new])
            flat = np.frombuffer(b"".join(parts), self.dtype)
            size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            # A space after one of these follows white space.
            self.odd = np.concatenate([self.odd, np.fromiter((not k or k[-1].isspace() for k in new), bool, len(new))])
        return out

    def items(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:  # not the items of a dict: those of texts
        """Items of the texts, one after another, and items per text. Joined, a text's chunks are the text.

        A chunk starts at each space that follows something else than white space.
        """
        remember_only(self)
        if len(self) > self.bound:
            self._empty()
        cut = []
        for text in texts:
            if _FIRST in text:
                parts = [_FIRST + c for c in _CUT.split(text)]
            else:
                parts = text.split(" ")
                parts[0] = _FIRST + parts[0]
            cut.append(parts)
        index = self._numbers(list(chain.from_iterable(cut)))
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        if self.odd[index].any():
            again = np.unique(row_of(lengths)[self.odd[index]]).tolist()
            for i in again:
                cut[i] = [_FIRST + c for c in _CUT.split(texts[i])]
            index = self._numbers(list(chain.from_iterable(cut)))
            lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        n = self.size[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, len(self.flat)) < 1 << 30 else np.int64
        out = self.flat[np.arange(total, dtype=small) + np.repeat((self.first[index] - (ends - n)).astype(small), n)]
        return out, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])])


def sections(column: pa.Array, rows: int = 512):
    """Lists of texts of an Arrow column, null as empty, so that the numbers of a long batch never lie in memory together."""
    return ([t or "" for t in column.slice(i, rows).to_pylist()] for i in range(0, len(column), rows))


def row_of(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


#: Places inside a chunk where byte-level pre-tokenizers always cut: before marks that end a word, and around a single line break.
_SAFE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?|*#$%&]+(?:\s|$))|(?<=\S)(?=\n)|(?<=\S\n)(?=\S)")


def token_chunks(encode, bound: int = 500_000) -> Chunks:
    """Chunks whose items are token ids (uint32); encode(list of strings) gives raw ids of each, or a number for all of them.

    Chunks are cut further where the tokenizer cuts too, so that fewer distinct strings are encoded.
    `bound` is what the Chunks remember; of the strings encoded, three fifths of that.
    """
    known: dict[str, bytes] = {}

    def work(new: list[str]) -> list[bytes]:
        if len(known) > bound * 3 // 5:
            known.clear()
        cut = [[c] if c[1:].isalpha() else _SAFE.split(c) for c in new]
        fresh = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in known]
        known.update(zip(fresh, encode(fresh)))
        return [known[some[0]] if len(some) == 1 else b"".join([known[p] for p in some]) for some in cut]

    return Chunks(work, bound=bound, forget_too=known.clear)
