"""Token ids of whole texts by way of their distinct chunks.

Arrow cuts a block of texts at spaces and numbers the distinct chunks; only these meet Python. What a
chunk gives is remembered in two generations: when the younger one is full it becomes the older one,
and what is met again moves over. Both together stay within a bound in bytes.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewarden.llm.pieces import remember_only, row_of
from tidewarden.llm.word_ranks import ranges

_FIRST = "\0"
_CUT = re.compile(r"(?<=\S)(?= )")
#: Where both kinds of pre-tokenizers cut: between a word and marks that end it, and around a single line break.
_SAFE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?|*#$%&]+(?:\s|$))|(?<=\S)(?=\n)|(?<=\S\n)(?=\S)")
#: What a remembered string costs beside its letters and ids: its object, its place in a dict, its number.
_COST = 150


class _Generation:
    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.first, self.size, self.odd = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.bytes = 0


class ChunkIds:
    """encode: list of strings -> (ids of all of them, how many each). spaced: whether a space belongs to the chunk behind it."""

    def __init__(self, encode, spaced: bool, bound: int = 160 << 20):
        self.encode, self.spaced, self.bound = encode, spaced, bound
        self._forget()

    def _forget(self) -> None:
        self.young, self.old, self.words, self.word_bytes = _Generation(), _Generation(), {}, 0

    def _learn(self, keys: list[str]) -> None:
        """Give the keys, which are new to the younger generation, their numbers and ids."""
        young, old = self.young, self.old
        known = [old.number.get(k, -1) for k in keys]
        fresh = [k for k, n in zip(keys, known) if n < 0]
        if self.spaced:
            strings = [k[1:] if k[:1] == _FIRST else " " + k for k in fresh]
            cut = [[s] if s[1:].isalpha() else _SAFE.split(s) for s in strings]
        else:
            cut = [[k] if k.isalpha() else _SAFE.split(k) for k in fresh]
        if self.word_bytes > self.bound // 3:
            self.words, self.word_bytes = {}, 0
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.words]
        if new:
            ids, size = self.encode(new)
            raw, ends = ids.tobytes(), (4 * np.cumsum(size)).tolist()
            self.words.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends))))
            self.word_bytes += len(raw) + sum(map(len, new)) + _COST * len(new)
        made = [self.words[c[0]] if len(c) == 1 else b"".join([self.words[w] for w in c]) for c in cut]
        # Those the older generation knows follow behind the fresh ones.
        again = np.array([n for n in known if n >= 0], np.int64)
        kept = old.flat[ranges(old.first[again], old.size[again])] if len(again) else np.zeros(0, np.uint32)
        size = np.concatenate([np.fromiter(map(len, made), np.int64, len(made)) // 4, old.size[again] if len(again) else np.zeros(0, np.int64)])
        flat = np.concatenate([np.frombuffer(b"".join(made), np.uint32), kept])
        names = fresh + [k for k, n in zip(keys, known) if n >= 0]
        base = len(young.number)
        young.number.update(zip(names, range(base, base + len(names))))
        young.first = np.concatenate([young.first, len(young.flat) + np.cumsum(size) - size])
        young.size, young.flat = np.concatenate([young.size, size]), np.concatenate([young.flat, flat])
        if self.spaced:
            young.odd = np.concatenate([young.odd, np.fromiter((not k or k[-1].isspace() for k in names), bool, len(names))])
        young.bytes += sum(map(len, names)) + flat.nbytes + _COST * len(names)

    def _numbers(self, keys: list[str]) -> np.ndarray:
        get = self.young.number.get
        new = [k for k in keys if get(k) is None]
        if new:
            self._learn(list(dict.fromkeys(new)))
        return np.fromiter(map(self.young.number.__getitem__, keys), np.int64, len(keys))

    def items(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and ids per text. A null has none."""
        remember_only(self)
        if self.young.bytes > self.bound // 3:
            self.old, self.young = self.young, _Generation()
        lists = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), " ")
        chunks = lists.flatten()
        coded = chunks.dictionary_encode()
        index = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        if self.spaced:
            starts = np.cumsum(lengths) - lengths
            index[starts] = self._numbers([_FIRST + k for k in chunks.take(pa.array(starts)).to_pylist()])
            # A space after white space does not open a chunk: such texts are cut again.
            for i in np.unique(row_of(lengths)[self.young.odd[index]])[::-1].tolist():
                own = self._numbers([_FIRST + c for c in _CUT.split(texts[i].as_py())])
                index = np.concatenate([index[: starts[i]], own, index[starts[i] + lengths[i] :]])
                lengths[i] = len(own)
        n = self.young.size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.young.flat[ranges(self.young.first[index], n)], np.diff(ends[np.concatenate([[0], np.cumsum(lengths)])])
