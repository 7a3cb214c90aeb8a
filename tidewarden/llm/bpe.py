"""Byte-level BPE as a monoid over byte strings.

Encoding: a long piece is cut at the largest power of two within it, so that equal halves of a run are
encoded once; both parts are encoded on their own and then joined. A join
re-encodes a window of tokens at the border, one token on each side at first, and grows it until the
tokens at its edges agree with their neighbours outside: two adjacent tokens agree if the bytes of
both together encode to just these two. A sequence whose tokens all agree pairwise is the encoding
of its bytes, so then nothing outside the window can change. Decoding joins bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from tidewarden.llm.pieces import Chunks, list_array, sections

LEAF = 48


class Merges:
    """Ranks of a vocabulary, byte strings to ids, and the pieces its pattern cuts."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.none = max(self.ranks.values(), default=0) + 1
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.text_of = np.array([str(i) for i in range(max(self.bytes_of, default=0) + 1)])
        self.find = regex.compile(pattern).findall
        self.agreed: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks = Chunks(self.encode, forget_too=self._forget)

    def _forget(self) -> None:
        self.pieces.clear()
        self.agreed.clear()

    def leaf(self, data: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > 2 * LEAF:
            return self.wide_leaf(data)
        rank, none = ranks.get, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs:
            least = min(costs)
            if least == none:
                break
            at = costs.index(least)
            merged = parts[at] = parts[at] + parts.pop(at + 1)
            del costs[at]
            if at < len(costs):
                costs[at] = rank(merged + parts[at + 1], none)
            if at:
                costs[at - 1] = rank(parts[at - 1] + merged, none)
        return [ranks[p] for p in parts]

    def wide_leaf(self, data: bytes) -> list[int]:
        """As `leaf`, in time n log n: live parts are linked by their starts, pairs wait in a heap."""
        rank, none, n = self.ranks.get, self.none, len(data)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        costs = [rank(data[i : i + 2], none) for i in range(n - 1)] + [none]
        pairs = [(c, i) for i, c in enumerate(costs) if c < none]
        heapify(pairs)
        while pairs:
            cost, at = heappop(pairs)
            if costs[at] != cost:
                continue
            middle = after[at]
            after[at] = end = after[middle]
            before[end] = at
            costs[middle] = none
            costs[at] = new = rank(data[at : after[end]], none) if end < n else none
            if new < none:
                heappush(pairs, (new, at))
            if at:
                left = before[at]
                costs[left] = new = rank(data[left:end], none)
                if new < none:
                    heappush(pairs, (new, left))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : after[at]]])
            at = after[at]
        return out

    def agree(self, a: int, b: int) -> bool:
        known = self.agreed.get((a, b))
        if known is None:
            if len(self.agreed) > 200_000:
                self.agreed.clear()
            known = self.agreed[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.agree(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = self.leaf(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            fits_left = i == len(left) or self.agree(left[-i - 1], window[0])
            fits_right = j == len(right) or self.agree(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if fits_left else min(len(left), 2 * i)
            j = j if fits_right else min(len(right), 2 * j)

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = 1 << (len(data) - 1).bit_length() - 1
        first, second = data[:half], data[half:]
        left = self.piece(first)
        return self.join(left, left if first == second else self.piece(second))

    def encode(self, strings: list[str]) -> list[bytes]:
        """Raw uint32 ids of each string; its pieces are encoded separately."""
        known = self.pieces
        if len(known) > 400_000:
            known.clear()
        out = []
        for found in map(self.find, strings):
            for p in found:
                if p not in known:
                    known[p] = np.array(self.piece(p.encode()), "<u4").tobytes()
            out.append(known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], Merges] = {}


def merges(path: str, pattern: str) -> Merges:
    """The vocabulary, loaded once in a Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Merges(path, pattern)
    return _LOADED[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids; a null or empty text has none. path: a rank file that every executor can read."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        own = merges(path, pattern)
        out = []
        for some in sections(texts):
            items, n = own.chunks.items(some)
            out.append(list_array(items.astype(np.int32), n))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of token ids; null gives null. An id that the vocabulary lacks fails the job."""

    @F.arrow_udf("binary")
    def data(lists: pa.Array) -> pa.Array:
        own = merges(path, pattern)
        return pa.array([None if x is None else own.decode(x) for x in (lists[i].as_py() for i in range(len(lists)))], pa.binary())

    return data(ids)


def digests(ids: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): of the decimal ids joined by commas, and of the decoded bytes."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def of(lists: pa.Array) -> pa.Array:
        own = merges(path, pattern)
        n, first, second = [], [], []
        for i in range(len(lists)):
            x = lists[i].values.to_numpy(zero_copy_only=False)
            n.append(len(x))
            first.append(hashlib.sha256(",".join(own.text_of[x].tolist()).encode()).hexdigest())
            second.append(hashlib.sha256(own.decode(x.tolist())).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(ids)
