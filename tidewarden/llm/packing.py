"""Best-fit packing of documents into sequences of bounded length, by linear grouping.

Lengths are whole numbers up to the capacity, so the packing is decided on their histogram, which never
has more rows than the capacity, however many documents there are:

1. Large lengths, in falling order, are cut into groups of equal size, and each is rounded up to its
   group's largest. Few sizes remain.
2. Configurations of these sizes are optimised by column generation (a knapsack prices them), and used a
   whole number of times.
3. The true lengths replace the rounded ones, which only leaves more room.
4. Small lengths, and large ones that whole numbers of configurations left over, go where they fit best.

The plan names for each length, by rank, the sequences and places; documents look theirs up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewarden.llm.chunk_ids import ChunkIds
from tidewarden.llm.word_ranks import encoder
from tidewarden.sources.staging import stage

CAPACITY = 2048
#: Groups of large lengths, and the part of the capacity up to which a length is small. What suits depends on the
#: lengths: all are tried on the histogram, and the plan of fewest sequences is taken.
GROUPINGS = ((64, 1 / 8), (48, 1 / 4), (32, 1 / 3), (32, 1 / 2))
_MEMORY: dict[str, ChunkIds] = {}
_SECTION = 2048
_RANK_BITS = 48


@dataclass
class Sequences:
    """`count` sequences of equal make-up: (length, times) in order, and the room left."""

    count: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def with_more(self, count: int, length: int, times: int) -> Sequences:
        return Sequences(count, self.room - length * times, [*self.items, (length, times)] if times else list(self.items))


def _dearest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the prices add up to most within the capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist())):
        if price <= 0:
            continue
        for _ in range(capacity // size):
            offer = value[:-size] + price
            better = offer > value[size:] + 1e-12
            if not better.any():
                break
            value[size:][better] = offer[better]
            last[size:][better] = i
    take, c = np.zeros(len(sizes), np.int64), int(np.argmax(value))
    while last[c] >= 0:
        take[last[c]] += 1
        c -= int(sizes[last[c]])
    return take


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (how often each size stands in a configuration) and how often to use each, fractions included.

    Revised simplex over all configurations; one enters as long as its prices add up to more than a sequence costs.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    for done in range(1, 40 * n + 1):
        prices = inverse.sum(0)
        column = _dearest(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        use, way = inverse @ demand, inverse @ column
        ratio = np.where(way > 1e-10, use / np.where(way > 1e-10, way, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if done % 50 == 0:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    return basis.astype(np.int64), np.linalg.solve(basis, demand)


def _grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Rounded sizes, falling, and per size the true [length, count] it stands for, falling. Groups of one size are one."""
    total, before = int(counts.sum()), 0
    sizes, members = [], []
    current = -1
    for length, count in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        while count:
            group = before * groups // total
            here = min(count, -(-(group + 1) * total // groups) - before)
            if group != current and (not sizes or sizes[-1] != length):
                sizes.append(length)
                members.append([])
            current = group
            if members[-1] and members[-1][-1][0] == length:
                members[-1][-1][1] += here
            else:
                members[-1].append([length, here])
            count, before = count - here, before + here
    return np.array(sizes, np.int64), members


def _taken(members: list[list[int]], count: int) -> list[tuple[int, int]]:
    """`count` true lengths off the front, as (length, count)."""
    out = []
    while count:
        here = min(count, members[0][1])
        out.append((members[0][0], here))
        members[0][1] -= here
        count -= here
        if not members[0][1]:
            members.pop(0)
    return out


def _best_fit(kinds: list[Sequences], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Sequences]:
    """Place `counts` of `lengths`, longest first, each where the least room that suffices is; new sequences last."""
    by_room: list[list[Sequences]] = [[] for _ in range(capacity + 1)]
    for kind in kinds:
        by_room[kind.room].append(kind)
    filled = np.array([bool(x) for x in by_room])

    def put(kind: Sequences) -> None:
        if kind.count:
            by_room[kind.room].append(kind)
            filled[kind.room] = True

    for length, left in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        for room in (np.flatnonzero(filled[length:]) + length).tolist():
            if not left:
                break
            times, here = room // length, by_room[room]
            by_room[room], filled[room] = [], False
            for i, kind in enumerate(here):
                whole = min(kind.count, left // times)
                put(kind.with_more(whole, length, times))
                left -= whole * times
                part = int(whole < kind.count and left > 0)
                if part:
                    put(kind.with_more(1, length, left))
                    left = 0
                put(kind.with_more(kind.count - whole - part, length, 0))
        times = capacity // length
        fresh = Sequences(1, capacity)
        put(fresh.with_more(left // times, length, times))
        if left % times:
            put(fresh.with_more(1, length, left % times))
    return [kind for kinds in by_room for kind in kinds]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groupings: tuple[tuple[int, float], ...] = GROUPINGS) -> np.ndarray:
    """Rows (length, first rank, sequence, times, offset), by length and rank; of all groupings the one of fewest sequences.

    The pieces of a length from that rank on go `times` to a sequence, from the offset on, into consecutive sequences.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    kinds = min((packed(lengths, counts, capacity, *g) for g in groupings), key=lambda kinds: sum(k.count for k in kinds))
    rows, sequence, rank = [], 0, dict.fromkeys(lengths.tolist(), 0)
    for kind in kinds:
        offset = 0
        for length, times in kind.items:
            rows.append((length, rank[length], sequence, times, offset))
            rank[length] += kind.count * times
            offset += length * times
        sequence += kind.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int, small: float) -> list[Sequences]:
    """The sequences under one grouping."""
    kinds = []
    large = (lengths > small * capacity) & (lengths < capacity)
    rest = dict(zip(lengths[~large].tolist(), counts[~large].tolist()))
    if large.any():
        sizes, members = _grouped(lengths[large], counts[large], groups)
        columns, use = configurations(sizes, np.array([sum(n for _, n in m) for m in members], float), capacity)
        for column, often in zip(columns.T, np.floor(use + 1e-9).astype(np.int64).tolist()):
            often = min([often, *[sum(n for _, n in members[i]) // column[i] for i in np.flatnonzero(column)]])
            if often <= 0:
                continue
            slots = [_taken(members[i], often) for i in np.flatnonzero(column) for _ in range(column[i])]
            ends = sorted({e for s in slots for e in np.cumsum([n for _, n in s]).tolist()})
            at = 0
            for end in ends:
                items: dict[int, int] = {}
                for s in slots:
                    edges = np.cumsum([n for _, n in s])
                    length = s[int(np.searchsorted(edges, at, "right"))][0]
                    items[length] = items.get(length, 0) + 1
                kinds.append(Sequences(end - at, capacity - sum(a * b for a, b in items.items()), list(items.items())))
                at = end
        for length, n in (x for m in members for x in m):  # what whole numbers left over
            rest[length] = rest.get(length, 0) + n
    return _best_fit(kinds, np.array(list(rest), np.int64), np.array(list(rest.values()), np.int64), capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its number among those of its length in its task.

    A null or empty text is a document of the end id. Repeated rows are documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches):
        from pyspark import TaskContext

        if tokenizer not in _MEMORY:
            _MEMORY[tokenizer] = ChunkIds(encoder(tokenizer), spaced=False)
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for keys, texts in ((b.column(0).slice(i, _SECTION), b.column(1).slice(i, _SECTION)) for b in batches for i in range(0, b.num_rows, _SECTION)):
            tokens, n = _MEMORY[tokenizer].items(pa.array([_lowered(t or "") for t in texts.to_pylist()], pa.string()))
            ends = np.cumsum(n)
            tokens, n = np.insert(tokens, ends, end_id).astype("<u4"), n + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            at = (np.cumsum(n) - n)[doc] + start
            raw = tokens.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            # Numbers within a length: those seen before, then in order.
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - (np.cumsum(many) - many)[length[order]]
            nth += seen[length]
            seen += many
            columns = [keys.take(pa.array(doc)), piece.astype(np.int32), start, length, pa.array(crc, pa.int64()), np.full(len(doc), block, np.int32), nth]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long")


def _lowered(text: str) -> str:
    """Lower case where Python and the library surely agree, so that fewer distinct chunks are remembered."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document.

    A document is the ids of its text and the end id; longer ones are cut into pieces of `capacity`.
    Pieces of equal length change places freely, ties included. Repeated rows are packed again, a null
    or empty text is the end id alone, an empty table gives no rows.

    To the driver come the histogram (at most `capacity` rows) and nothing else; the plan that tasks get
    depends on lengths and groups, not on how many documents there are. The number of a piece among
    those of its length is a count per task and length plus those of earlier tasks, so that a length
    that a third of all pieces have is no task of its own.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    tasks = stage(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    histogram = tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()
    rows = plan(np.array([r["length"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    ranked = pieces.join(tasks.select("length", "block", before.alias("before")), ["length", "block"])
    key = (rows[:, 0] << _RANK_BITS) + rows[:, 1]

    def placed(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            run = np.searchsorted(key, (length << _RANK_BITS) + rank, "right") - 1
            _, first, sequence, times, offset = rows[run].T
            more = [pa.array(sequence + (rank - first) // times), pa.array(offset + (rank - first) % times * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *more], [*b.schema.names[:5], "sequence_id", "offset"])

    found = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return found.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
