"""Phrase collocations from bidirectional FM-indexes, one per shard.

A shard is a run of texts of one language in one task. Over its word numbers stand two Burrows-Wheeler
transforms, of the text and of its reverse. A phrase is an interval in both; one step extends all
intervals of a length at once, to the left by the first transform and to the right by the second, and
keeps both in step. Orders only matter as deep as the phrases that are extended: a level sorts its
transforms to that depth from the word numbers, which take half the room of both transforms.

Counts go up level by level. A shard sends the extensions of what is frequent everywhere, dealt to
cells by a hash; a cell adds up the shards, numbers what stays frequent and tells each shard its part.
Arrays, not rows, are shuffled, and the numbers of a shard, a bucketed table, are never moved.

Of two-word phrases most are rare. They are sieved first: shards send sums over buckets of phrases, and
only phrases of buckets with enough occurrences go to the cells. A phrase travels as one number, the pair
of its ends' numbers permuted; cells are ranges of such numbers, so their steps are as small as can be.
What a shard is told are places in the list it sent, which it works out again.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.llm.word_ranks import ranges
from tidewarden.sources.staging import shared_folder, stage

#: Words after which a shard is closed, and entries that a cell adds up at once, about.
SHARD_WORDS, CELL_ENTRIES = 1 << 21, 1 << 21
#: Buckets must leave out so many bits of a phrase's number, or sieving saves nothing.
SIEVE_BITS = 4
_STOP = b"."
_TABLE = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 22
#: words: in the order of their bytes, with a space between; counts (first of the separator) in the same order; text: numbers as byte planes.
INDEX = "shard long, lang string, words binary, counts binary, text binary"


class _Shard:
    """Word numbers of the texts of one language; 0 stands between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = {_STOP: 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.size = 0

    def add(self, text: str) -> None:
        raw, at = text.encode("utf-8", "surrogatepass").translate(_TABLE), 0
        while at < len(raw):  # long texts in blocks that end with a piece
            end = len(raw) if len(raw) - at <= _BLOCK else raw.find(_STOP, at + _BLOCK) + 1 or len(raw)
            found = raw[at:end].replace(_STOP, b" . ").split()
            number = self.number
            for word in set(found).difference(number):
                number[word] = len(number)
            self.parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
            self.size, at = self.size + len(found), end
        self.parts.append(np.zeros(1, np.int32))

    def row(self, shard: int, lang: str) -> dict:
        text = np.concatenate(self.parts)
        text = text[np.append(True, (text[1:] != 0) | (text[:-1] != 0))]  # one separator is enough
        words = sorted(self.number.keys() - {_STOP})
        counts = np.bincount(text, minlength=len(self.number))
        by_name = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        number = np.zeros(len(counts), np.int32)
        number[by_name] = _ranks(counts[by_name])
        return {"shard": shard, "lang": lang, "words": b" ".join(words), "counts": np.append(counts[0], counts[by_name]).astype("<i8").tobytes(), "text": _planes(number[text])}


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Numbers of words in a shard, from 1: frequent ones are small, equal ones in order."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(1, len(counts) + 1)
    return rank


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view("<i4")


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0; if they are not long, 16 bits at a time, which numpy sorts in linear time."""
    bits = int(keys.max(initial=0)).bit_length()
    if bits > 48:
        return np.argsort(keys, kind="stable")
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys >> keys.dtype.type(shift)).astype(np.uint16)[order], kind="stable")]
    return order


def transform(text: np.ndarray, depth: int = 3) -> np.ndarray:
    """The word before each place, places in the order of the `depth` words from them on; the text is a ring."""
    bits = int(text.max(initial=0)).bit_length()
    following = [np.roll(text, -i).astype(np.int64) for i in range(depth)]
    if bits * depth < 64:
        key = following[0]
        for f in following[1:]:
            key = key << bits | f
        order = _order(key)
    else:
        order = np.lexsort(following[::-1])
    return np.roll(text, 1)[order].astype("<i4")


def indexes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of INDEX. Texts do not move: a task makes shards of the texts it reads."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def build(batches):
        from pyspark import TaskContext

        task, made, open_shards, held = TaskContext.get().partitionId(), 0, {}, 0

        def close(lang):
            nonlocal made, held
            shard = open_shards.pop(lang)
            held -= shard.size
            made += 1
            return pa.RecordBatch.from_pylist([shard.row((task << 32) + made - 1, lang)], _SCHEMA)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for lang, text in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()):
                    own = open_shards.setdefault(lang, _Shard())
                    before = own.size
                    own.add(text)
                    held += own.size - before
                    if own.size >= shard_words:
                        yield close(lang)
                    while held >= 2 * shard_words:  # many languages in one task
                        yield close(max(open_shards, key=lambda name: open_shards[name].size))
        for lang in list(open_shards):
            yield close(lang)

    return rows.mapInArrow(build, INDEX)


_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in INDEX.split(", "))])


class FmIndex:
    """Both transforms of one shard (or the one that is needed), and the intervals of phrases in them."""

    def __init__(self, counts: bytes, back: bytes | None, forth: bytes | None):
        self.counts = np.frombuffer(counts, "<i8")
        self.start = np.cumsum(self.counts) - self.counts
        self.side = {side: (np.frombuffer(raw, "<i4"), None) for side, raw in (("left", back), ("right", forth)) if raw is not None}

    @classmethod
    def of_text(cls, counts: np.ndarray, text: np.ndarray, size: int) -> FmIndex:
        """Deep enough to reach phrases of `size` words by steps to the right and to the left in turn."""
        depth = {_side(n): n - 1 for n in range(2, size + 1)}
        back = transform(text, depth["left"]).tobytes() if "left" in depth else None
        return cls(counts.tobytes(), back, transform(text[::-1], depth["right"]).tobytes())

    def _steps(self, side: str) -> np.ndarray:
        """For each place of a transform where its word's interval starts plus how often the word stood before."""
        words, step = self.side[side]
        if step is None:
            step = np.empty(len(words), np.int64)
            step[_order(words)] = np.arange(len(words))
            self.side[side] = words, step
        return step

    def words(self, chosen: np.ndarray) -> dict[str, np.ndarray]:
        """Intervals of single words: `left` and `right` say where they start in either transform."""
        return {"left": self.start[chosen], "right": self.start[chosen], "size": self.counts[chosen]}

    def extend(self, phrases: dict[str, np.ndarray], side: str, further: bool = True) -> dict[str, np.ndarray]:
        """All phrases one word longer on one side: `of` (the phrase extended), `word`, and their intervals (only the size if they go no further)."""
        words = self.side[side][0]
        other = "left" if side == "right" else "right"
        rows = ranges(phrases[side], phrases["size"])
        bits = len(self.counts).bit_length()
        key = np.repeat(np.arange(len(phrases["size"])), phrases["size"]) << bits | words[rows]
        order = _order(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        of, word = key[first] >> bits, key[first] & ((1 << bits) - 1)
        out = {"of": of, "word": word, "size": np.diff(np.append(first, len(key)))}
        if further:
            # Smaller words of the same phrase come before in the other transform.
            inside = first - (np.cumsum(phrases["size"]) - phrases["size"])[of]
            out |= {side: self._steps(side)[rows[order[first]]], other: phrases[other][of] + inside}
        return _take(out, word > 0)


def _side(size: int) -> str:
    """Where phrases grow to `size` words."""
    return "right" if size % 2 == 0 else "left"


def _take(columns: dict[str, np.ndarray], chosen: np.ndarray) -> dict[str, np.ndarray]:
    return {name: c[chosen] for name, c in columns.items()}


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def frequent_extensions(index: FmIndex, words: tuple[np.ndarray, np.ndarray], levels: list) -> dict[str, np.ndarray]:
    """Phrases one word longer than the last level whose both ends are frequent: numbers of the ends (`head`, `tail`), `size`.

    words: local and global numbers of the shard's frequent words. levels: for phrases of two words and
    more, a function from heads and tails to the number of the phrase, -1 if it is not frequent. Lengths
    grow to the right and to the left in turn.
    """
    local, number = words
    place = np.full(len(index.counts), -1)
    place[local] = np.arange(len(local))
    now = index.words(local) | {"id": number, "first": np.arange(len(local)), "last": np.arange(len(local))}
    for size in range(2, len(levels) + 3):
        side = _side(size)
        more = index.extend(now, side, size < len(levels) + 2)
        more["word"] = place[more["word"]]
        more = _take(more, more["word"] >= 0)
        of, word = more["of"], more["word"]
        # One end is the phrase extended; the other is that phrase's own other end, with the new word.
        if size == 2:
            more["head"], more["tail"] = of, word
        elif side == "right":
            more["head"], more["tail"] = of, _pairs(now["head"], now["last"])(now["tail"][of], word)
        else:
            more["head"], more["tail"] = _pairs(now["tail"], now["first"])(now["head"][of], word), of
        more["first"], more["last"] = (now["first"][of], word) if side == "right" else (word, now["last"][of])
        more = _take(more, (more["head"] >= 0) & (more["tail"] >= 0))
        head, tail = now["id"][more["head"]], now["id"][more["tail"]]
        if size == len(levels) + 2:
            return {"head": head, "tail": tail, "size": more["size"]}
        more["id"] = levels[size - 2](head, tail)
        now = _take(more, more["id"] >= 0)
    raise AssertionError("a level is always asked for")


def _pairs(a: np.ndarray, b: np.ndarray):
    """A function (a, b) -> place of that pair, -1 if there is none."""
    key = a << 32 | b
    order = _order(key)

    def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = _find(key[order], a << 32 | b)
        return np.where(at >= 0, order[at], -1) if len(order) else at

    return find


def _cells_for(entries: int | None) -> int:
    return max(1, -(-(entries or 0) // CELL_ENTRIES))


def _deal(cell: np.ndarray):
    """(cell, its members) for each cell that has any."""
    order = _order(cell)
    at = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(cell) else np.zeros(0, np.int64)
    return [(int(cell[part[0]]), part) for part in np.split(order, at[1:]) if len(part)]


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _mixed(head: np.ndarray, tail: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of numbers below 2**bits, permuted: spread evenly over the numbers below 4**bits."""
    half, mask = np.uint64(bits), np.uint64((1 << 2 * bits) - 1)
    x = (head.astype(np.uint64) << half | tail.astype(np.uint64)) * _ODD & mask
    return (x ^ x >> half) * _ODD & mask


def _unmixed(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    half, mask = np.uint64(bits), np.uint64((1 << 2 * bits) - 1)
    x = x.astype(np.uint64) * _BACK & mask
    x = (x ^ x >> half) * _BACK & mask
    return (x >> half).astype(np.int64), (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def _cell_of(x: np.ndarray, bits: int, cells: int) -> np.ndarray:
    """Which of so many equal ranges of the numbers below 2**bits."""
    top = x >> np.uint64(bits - 32) if bits > 32 else x << np.uint64(32 - bits)
    return (top * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _sent(x: np.ndarray, bits: int, cells: int) -> list[tuple[int, int, int]]:
    """(cell, from, to) for the ranges that sorted numbers fall into."""
    cell = _cell_of(x, bits, cells)
    at = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
    return list(zip(cell[at].tolist(), at, [*at[1:], len(x)]))


def _squeezed(numbers: np.ndarray, rising: bool = True) -> bytes:
    """Whole numbers as steps from one to the next (as they are if not `rising`), sign last, all first bytes before all second ones, compressed."""
    step = np.diff(numbers.astype(np.int64), prepend=0) if rising else numbers.astype(np.int64)
    planes = ((step << 1) ^ (step >> 63)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(step).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _widened(raw: bytes, rising: bool = True) -> np.ndarray:
    size = 8 * int.from_bytes(raw[:8], "little")
    planes = pa.Codec("zstd").decompress(raw[8:], size, asbytes=True)
    step = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")
    step = (step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64)
    return np.cumsum(step) if rising else step


def _joined(words: list[bytes]) -> bytes:
    """Words, which hold no space, as one compressed text."""
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 9).compress(raw, asbytes=True)


def _parted(raw: bytes) -> pa.Array:
    text = pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
    return pc.split_pattern(pa.array([text], pa.binary()), " ").flatten()


def _word_entries(index: DataFrame, cells: int) -> DataFrame:
    """Per shard and cell: the shard's words, their places in its list of words and counts."""

    def entries(batches):
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                words, counts = r["words"].split(b" ") if r["words"] else [], _ints(r["counts"])[1:]  # the first is the separator
                cell = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % cells
                for c, part in _deal(cell):
                    yield pa.RecordBatch.from_pydict({
                        "lang": [r["lang"]], "cell": [c], "shard": [r["shard"]], "words": pa.array([_joined([words[i] for i in part.tolist()])], pa.binary()),
                        "local": [_squeezed(part)], "counts": [_squeezed(counts[part], False)],
                    })

    return index.select("shard", "lang", "words", "counts").mapInArrow(entries, "lang string, cell long, shard long, words binary, local binary, counts binary")


def _frequent_words(entries: DataFrame, least: int) -> DataFrame:
    """Per cell a row of its frequent words, and per shard which of its words they are (`at`) and their numbers in the cell."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        coded = pa.concat_arrays([_parted(x) for x in rows["words"].to_pylist()]).dictionary_encode()
        index, counts = coded.indices.to_numpy(), np.concatenate([_widened(x, False) for x in rows["counts"].to_pylist()])
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, index, counts)
        kept = np.flatnonzero(total >= least)
        kept = kept[pc.sort_indices(coded.dictionary.take(pa.array(kept))).to_numpy()]  # as in the shards, so numbers rise
        number = np.full(len(total), -1)
        number[kept] = np.arange(len(kept))
        lang, cell = rows["lang"][0].as_py(), rows["cell"][0].as_py()
        out = [{"lang": lang, "cell": cell, "n": int(total.sum()), "words": coded.dictionary.take(pa.array(kept)).to_pylist(), "f": total[kept].tolist()}]
        at = 0
        for shard, raw in zip(rows["shard"].to_pylist(), rows["local"].to_pylist()):
            local = _widened(raw)
            own = number[index[at : at + len(local)]]
            at += len(local)
            out.append({"lang": lang, "cell": cell, "shard": shard, "at": _squeezed(local[own >= 0]), "ids": _squeezed(own[own >= 0])})
        return pa.Table.from_pylist(out, _WORDS)

    return entries.groupBy("lang", "cell").applyInArrow(add, "lang string, cell long, shard long, n long, words array<binary>, f array<long>, at binary, ids binary")


_WORDS = pa.schema([("lang", pa.string()), ("cell", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("f", pa.list_(pa.int64())), ("at", pa.binary()), ("ids", pa.binary())])


def _kept(x: np.ndarray, bits: int, cells: int, told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted list that a shard has sent: the places that it was told, and their numbers."""
    begin = {c: a for c, a, _ in _sent(x, bits, cells)}
    at = [np.zeros(0, np.int64), *(begin[t["cell"]] + _widened(t["at"]) for t in told)]
    ids = [np.zeros(0, np.int64), *(_widened(t["ids"]) * cells + t["cell"] for t in told)]
    return np.concatenate(at), np.concatenate(ids)


class _Candidates:
    """The two-word phrases that a shard sends (all longer ones are sent): those of buckets that the sieve kept."""

    def __init__(self, cells: int, drop: int | None, told: list[dict] | None):
        self.cells, self.drop, self.told = cells, drop, told

    def of(self, head: np.ndarray, tail: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Their numbers in order, and which of the given phrases each is."""
        x = _mixed(head, tail, bits)
        order = _order(x)
        x = x[order]
        if self.drop is not None:
            bucket, size = _runs(x >> np.uint64(self.drop))
            chosen = np.zeros(len(bucket), bool)
            chosen[_kept(bucket, 2 * bits - self.drop, self.cells, self.told)[0]] = True
            chosen = np.repeat(chosen, size)
            x, order = x[chosen], order[chosen]
        return x, order

    def numbers(self, bits: int, told: list[dict]):
        """A function from heads and tails to the numbers that the cells gave them."""

        def find(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
            x, order = self.of(head, tail, bits)
            at, ids = _kept(x, 2 * bits, self.cells, told)
            out = np.full(len(head), -1)
            out[order[at]] = ids
            return out

        return find


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of sorted numbers, and how many there are of each."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _phrase_entries(index: DataFrame, told: list[DataFrame], bits: list[int], words_cells: int, cells: int, drop: int | None, sieve: DataFrame | None) -> DataFrame:
    """Per shard and cell: the next longer phrases (numbers made of both ends' numbers) and their counts.

    bits: of the numbers of each level told. drop: bits of a two-word phrase's number that its bucket leaves
    out (None: no sieve). Without what the sieve kept, the entries are those of the sieve: the buckets.
    """
    lists = None
    for name, level in [*((f"level{i}", x) for i, x in enumerate(told)), *([("sieve", sieve)] if sieve is not None else [])]:
        own = level.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("cell", "at", "ids")).alias(name))
        lists = own if lists is None else lists.join(own, "shard")
    # The small side moves to the buckets of the index.
    rows = index.select("shard", "lang", "counts", "text").join(lists.hint("shuffle_hash"), "shard")
    sieving, n_levels = drop is not None and sieve is None, len(told)

    def entries(batches):
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                counts = _ints(r["counts"])
                rank = _ranks(counts[1:])
                by_rank = np.empty_like(counts)
                by_rank[0], by_rank[rank] = counts[0], counts[1:]
                at, ids = (np.concatenate(x) for x in zip(*((_widened(t["at"]), _widened(t["ids"]) * words_cells + t["cell"]) for t in r["level0"])))
                pairs, longer = _Candidates(cells, drop, r.get("sieve")), _Candidates(cells, None, None)
                levels = [(pairs if i == 1 else longer).numbers(bits[i - 1], r[f"level{i}"]) for i in range(1, n_levels)]
                fm = FmIndex.of_text(by_rank, _unplaned(r["text"]), n_levels + 1)
                found = frequent_extensions(fm, (rank[at], ids), levels)
                width = 2 * bits[-1]
                if sieving:
                    x, order = longer.of(found["head"], found["tail"], bits[-1])
                    width -= drop
                    x, n = _runs(x >> np.uint64(drop))
                    size = np.add.reduceat(found["size"][order], np.cumsum(n) - n) if len(x) else n
                else:
                    x, order = (pairs if n_levels == 1 else longer).of(found["head"], found["tail"], bits[-1])
                    size = found["size"][order]
                for c, a, e in _sent(x, width, cells):
                    yield pa.RecordBatch.from_pydict({"lang": [r["lang"]], "cell": [c], "shard": [r["shard"]], "phrases": [_squeezed(x[a:e])], "size": [_squeezed(size[a:e], False)]})

    return rows.mapInArrow(entries, "lang string, cell long, shard long, phrases binary, size binary")


def _frequent_phrases(entries: DataFrame, least: int, bits: int | None) -> DataFrame:
    """Per cell a row of its frequent phrases, and per shard which of those it sent they are (`at`) and their numbers in the cell.

    bits: of the numbers of the phrases' ends; None for buckets, which need no numbers.
    """

    def add(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        parts = [_widened(x).view(np.uint64) for x in rows["phrases"].to_pylist()]
        x, size = np.concatenate(parts), np.concatenate([_widened(x, False) for x in rows["size"].to_pylist()])
        order = _order(x)
        phrase, n = _runs(x[order])
        total = np.add.reduceat(size[order], np.cumsum(n) - n)
        kept = total >= least
        number = np.empty(len(x), np.int64)
        number[order] = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1), n)
        lang, cell = rows["lang"][0].as_py(), rows["cell"][0].as_py()
        out = []
        if bits is not None and kept.any():
            heads, tails = _unmixed(phrase[kept], bits)
            out.append({"lang": lang, "cell": cell, "heads": heads.tolist(), "tails": tails.tolist(), "f": total[kept].tolist()})
        begin = 0
        for shard, part in zip(rows["shard"].to_pylist(), parts):
            own = number[begin : begin + len(part)]
            begin += len(part)
            at = np.flatnonzero(own >= 0)
            if len(at):
                out.append({"lang": lang, "cell": cell, "shard": shard, "at": _squeezed(at), "ids": _squeezed(own[at] if bits is not None else own[:0])})
        return pa.Table.from_pylist(out, _PHRASES)

    return entries.groupBy("lang", "cell").applyInArrow(add, "lang string, cell long, shard long, heads array<long>, tails array<long>, f array<long>, at binary, ids binary")


_PHRASES = pa.schema([("lang", pa.string()), ("cell", pa.int64()), ("shard", pa.int64()), *[(k, pa.list_(pa.int64())) for k in ("heads", "tails", "f")], *[(k, pa.binary()) for k in ("at", "ids")]])


def _id(cells: int) -> Column:
    """Numbers of all cells in turn, so that they stay small."""
    return F.col("pos").cast("long") * cells + F.col("cell")


def _bits(numbered: DataFrame, cells: int) -> int:
    """Bits of the largest number that a level's cells have given."""
    most = numbered.agg(F.max(F.size("f"))).first()[0] or 0
    bits = max(1, (most * cells - 1).bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 frequent phrases of one length")
    return bits


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and for each length from 1 to `longest` a table of the frequent phrases.

    Their columns: lang, id, phrase, last (its last word), f, head and tail (id of the phrase without its
    last and first word), before and after (f of its beginnings and of its endings, one word first).
    """
    spark = docs.sparkSession
    name = f"tidewarden_fm_{uuid.uuid4().hex}"
    built = indexes(docs, text_col, lang_col)
    # Fewer buckets than shuffle partitions, and a join would deal the index out again.
    buckets = max(min(8192, docs.rdd.getNumPartitions()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    built.write.bucketBy(buckets, "shard").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    index = spark.table(name)
    sizes = index.agg(F.sum(F.octet_length("counts") / 8).cast("long").alias("words"), F.sum(F.octet_length("text") / 4).cast("long").alias("places")).first()
    words_cells, cells = _cells_for(sizes["words"]), _cells_for(sizes["places"])
    told = [stage(_frequent_words(_word_entries(index, words_cells), least), "frequent-words")]
    own = told[0].where("shard is null")
    totals = own.groupBy("lang").agg(F.sum("n").alias("n"))
    bits = [_bits(own, words_cells)]
    # Enough buckets that half of what makes a phrase frequent falls into each if all are alike.
    drop = 2 * bits[0] - max(1, (2 * (totals.agg(F.max("n")).first()[0] or 0) // max(least, 1)).bit_length())
    drop = drop if drop >= SIEVE_BITS else None
    sieve = None
    if drop is not None and longest > 1:
        sieve = stage(_frequent_phrases(_phrase_entries(index, told, bits, words_cells, cells, drop, None), least, None), "frequent-buckets")
    nothing = F.array().cast("array<bigint>")
    words = own.select("lang", "cell", F.posexplode(F.arrays_zip("words", "f")).alias("pos", "x"))
    word = F.col("x.words").cast("string")
    tables = [words.select("lang", _id(words_cells).alias("id"), word.alias("phrase"), word.alias("last"), F.col("x.f").alias("f"), nothing.alias("before"), nothing.alias("after"))]
    for size in range(2, longest + 1):
        told.append(stage(_frequent_phrases(_phrase_entries(index, told, bits, words_cells, cells, drop, sieve), least, bits[-1]), f"frequent-{size}"))
        own = told[-1].where("shard is null")
        bits.append(_bits(own, cells))
        own = own.select("lang", "cell", F.posexplode(F.arrays_zip("heads", "tails", "f")).alias("pos", "x"))
        own = own.select("lang", _id(cells).alias("id"), "x.heads", "x.tails", "x.f").withColumnsRenamed({"heads": "head", "tails": "tail"})
        head = tables[-1].select("lang", F.col("id").alias("head"), F.col("phrase").alias("_p"), F.col("f").alias("_hf"), F.col("before").alias("_b"))
        tail = tables[-1].select("lang", F.col("id").alias("tail"), "last", F.col("f").alias("_tf"), F.col("after").alias("_a"))
        full = own.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).select(
            "lang", "id", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", "f", "head", "tail",
            F.array_append("_b", F.col("_hf")).alias("before"), F.array_append("_a", F.col("_tf")).alias("after"),
        )
        tables.append(stage(full, f"phrases-{size}"))
    spark.sql(f"DROP TABLE {name}")
    return totals, tables


def mine(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to `longest` words of each language.

    a: occurrences; l and r: those of both sides of the lowest-scoring cut (of equal ones the first);
    n: words of the language; score floor(2000000 a / (l + r)). A phrase is dropped if a longer one
    around it occurs at least four times for every five of its own; one word more decides, as phrases
    longer still occur no more often. By score, then a (falling), then the phrase's bytes.

    Null texts are empty, null languages are `und`; repeated rows count repeatedly; no frequent phrase, no
    row. Counts are exact; the score is worked out in decimals.
    """
    totals, tables = frequent_phrases(docs, least, longest, text_col, lang_col)
    rows = None
    for size, table in enumerate(tables[1:], 2):
        cuts = [
            F.struct(
                F.expr(f"cast((cast(2000000 AS decimal(38, 0)) * f) div (before[{k - 1}] + after[{size - k - 1}]) AS bigint)").alias("score"),
                F.lit(k).alias("k"), F.col("before")[k - 1].alias("l"), F.col("after")[size - k - 1].alias("r"),
            )
            for k in range(1, size)
        ]
        own = table.select("lang", "id", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut"))
        if size < longest:
            around = tables[size].select("lang", F.explode(F.array("head", "tail")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("_f"))
            own = own.join(around, ["lang", "id"], "left").where("_f is null or cast(100 AS decimal(38, 0)) * _f < 80 * a")
        own = own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        rows = own if rows is None else rows.unionByName(own)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
