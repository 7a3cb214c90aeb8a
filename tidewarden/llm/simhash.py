"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints: 64 majority bits of the hashed word shingles of a text.

Search: bits that move together form one part, so that parts differ little among themselves. With
parts p1..pm and thresholds t1..tm that sum to `limit - m + 1` (a part with -1 is not asked), two
fingerprints within `limit` bits are within ti bits in some part i. Every fingerprint gets its own
thresholds, by dynamic programming over the estimated number of candidates and probes of each part.
It asks for all values within ti bits of its own, and the candidates' bits are compared.

A fingerprint whose cheapest plan costs more than its ball of `limit / 2` bits goes another exact
way: two such fingerprints within `limit` bits share a value halfway between them, so all of a
halfway value's owners are linked to the smallest of them, and never pair by pair.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.components import components
from tidewarden.llm.pieces import remember_only
from tidewarden.sources.staging import stage

BITS = 64
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The hash of each shingle, in the text's order."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends)), np.uint64, len(starts))


def _fingerprint(text: str | None, shingle: int) -> int:
    hashes = shingle_hashes(words_of(text), shingle)
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256) @ _OF_BYTE
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a text as a signed 64-bit integer; a null or empty text has 0.

    A-Z is lower-cased, words are runs without ASCII white space, a shingle is `shingle` words joined
    by spaces (all words if fewer), hashed by XXH64 with seed 42. A bit is set if over half the hashes have it.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        remember_only(None)
        return pa.array([_fingerprint(x, shingle) for x in texts.to_pylist()], pa.int64())

    return of(text)


def _bit_pairs(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set: one small matrix a task."""

    def count(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(values), both + (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slot": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})

    rows = prints.select("print").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for slot, n in rows:
        flat[slot] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of equal size: each starts with the free bit of the strongest ties and takes in what goes with it most."""
    one = both.diagonal() / max(n, 1)
    spread = np.sqrt(one * (1 - one))
    tie = np.abs(both / max(n, 1) - np.outer(one, one)) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(tie, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS * (k + 1) // m - BITS * k // m
        left = sorted(free)
        part = [max(left, key=lambda i: (tie[i, left].sum(), -i))]
        while len(part) < size:
            part.append(max(sorted(free - set(part)), key=lambda i: (tie[i, part].sum(), -i)))
        free -= set(part)
        parts.append(sorted(part))
    return parts


def _ball(bits: list[int], radius: int) -> np.ndarray:
    """Masks with at most `radius` of the bits set."""
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)], np.uint64).view(np.int64)


def _plan_cost(n: int, m: int, limit: int) -> float:
    """Probes and candidates of one fingerprint among n even ones, with thresholds as equal as can be."""
    total, width = limit - m + 1, BITS // m
    given = [total // m + (k < total % m) for k in range(m)]
    balls = sum(sum(comb(width, r) for r in range(t + 1)) for t in given if t >= 0)
    return balls * (1 + n / 2**width)


def thresholds(counts: np.ndarray, n: int, widths: list[int], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint (row of counts, how many share its value in each part): thresholds of least cost, and that cost.

    The cost of part i at t is its probes plus its candidates, estimated as those that share the value
    and an even share of the rest. choice[i][s] is the best t where parts 0..i sum to s - m.
    """
    m, rows = len(widths), len(counts)
    total = limit - m + 1
    slots = total + m + 1  # sums from -m to total
    best = np.full((rows, slots), np.inf)
    best[:, m] = 0  # nothing spent
    choice = np.zeros((m, rows, slots), np.int8)
    for i, width in enumerate(widths):
        after = np.full((rows, slots), np.inf)
        ball = 0
        for t in range(-1, min(total + m - 1, width) + 1):
            ball += comb(width, t) if t >= 0 else 0
            cost = (counts[:, i] - 1 + ball + (ball - 1) * n / 2.0**width) if t >= 0 else np.zeros(rows)
            moved = np.full((rows, slots), np.inf)
            if t >= 0:
                moved[:, t:] = best[:, : slots - t]
            else:
                moved[:, :-1] = best[:, 1:]
            moved += cost[:, None]
            better = moved < after
            after = np.where(better, moved, after)
            choice[i][better] = t
        best = after
    out, at = np.zeros((rows, m), np.int8), np.full(rows, slots - 1)
    for i in reversed(range(m)):
        out[:, i] = choice[i][np.arange(rows), at]
        at = at - out[:, i]
    return out, best[:, -1]


def links(prints: DataFrame, limit: int = 4, most: float | None = None) -> DataFrame:
    """Pairs a < b of the distinct values in column `print` that connect all that differ in `limit` bits or fewer.

    Values whose plan costs more than `most` (default: the size of a ball of half the limit) are linked
    through halfway values. Every returned pair is within the limit; of dense places not every pair is returned.
    """
    n, both = _bit_pairs(prints)
    m = min(range(min(2, limit + 1), limit + 2), key=lambda k: _plan_cost(n, k, limit))
    parts = _parts(n, both, m)
    masks = [sum(1 << b for b in p) for p in parts]
    masks = [x - (1 << 64) if x >> 63 else x for x in masks]
    widths = [len(p) for p in parts]
    half = _ball(list(range(BITS)), limit // 2 + limit % 2)
    most = float(len(half)) if most is None else most

    cut = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(x)) for x in masks])).alias("part", "value"))
    index = stage(cut, "simhash-index")
    shared = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    counted = index.join(shared, ["part", "value"]).groupBy("print").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(m)])

    def probe(batches):
        balls = [[_ball(p, t) for t in range(min(limit, len(p)) + 1)] for p in parts]
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)], 1).astype(np.float64)
                given, cost = thresholds(counts, n, widths, limit)
                sparse = cost <= most
                for i in range(m):
                    for t in range(min(limit, widths[i]) + 1):
                        own = x[sparse & (given[:, i] == t)]
                        if len(own):
                            value = ((own & masks[i])[:, None] ^ balls[i][t][None, :]).ravel()
                            yield pa.RecordBatch.from_pydict({"part": np.full(len(value), i, np.int32), "value": value, "asks": np.repeat(own, len(balls[i][t]))})
                dense = x[~sparse]
                for some in (dense[i : i + 64] for i in range(0, len(dense), 64)):
                    value = (some[:, None] ^ half[None, :]).ravel()
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(value), -1, np.int32), "value": value, "asks": np.repeat(some, len(half))})

    asked = stage(counted.mapInArrow(probe, "part int, value long, asks long"), "simhash-probes")
    found = asked.where("part >= 0").join(index, ["part", "value"]).select(F.least("asks", "print").alias("a"), F.greatest("asks", "print").alias("b"))
    halfway = asked.where("part < 0").select("value", "asks")
    firsts = halfway.groupBy("value").agg(F.min("asks").alias("a"), F.count("*").alias("n")).where("n > 1")
    through = halfway.join(firsts, "value").select("a", F.col("asks").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    return found.where((F.col("a") < F.col("b")) & near).union(through.where((F.col("a") < F.col("b")) & near)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """Per row of docs: its id, print (signed fingerprint), component_id (smallest id of its component) and root.

    Fingerprints are linked at `limit` or fewer differing bits, equal ones always; root is the smallest
    fingerprint of the component. Null texts have fingerprint 0. A row without an id stays, and never names
    a component unless no member has an id. Repeated rows stay. An empty table gives no rows. Other columns are not looked at.
    """
    rows = stage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("print")), "simhash-prints")
    firsts = stage(rows.groupBy("print").agg(F.min("id").alias("first")), "simhash-distinct")
    return named(rows, firsts, components(links(firsts, limit)), id_col)


def named(rows: DataFrame, firsts: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, print) with the component_id and root of their print; firsts has each print's smallest id, roots those of linked prints."""
    roots = roots.withColumnRenamed("node", "print")
    rooted = stage(firsts.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root")), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(named, "root").select("print", "root", "component_id")
    return rows.join(members, "print").select(F.col("id").alias(id_col), "print", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, mark=fingerprint) -> DataFrame:
    """The rows of docs that stay when each group of near-duplicates keeps the row with its smallest id.

    find(docs, id_col, text_col) gives the groups, mark(text) a row's print in them.
    Where several rows of a group have that id (or no row has one), one of them stays. Columns and order of columns stay.
    """
    held = [f"held_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*held)
    own, text = held[docs.columns.index(id_col)], held[docs.columns.index(text_col)]
    groups = find(plain, own, text)
    kept = groups.where(F.col(own).eqNullSafe(F.col("component_id"))).groupBy(own, "root").agg(F.min("print").alias("print"), F.count("*").alias("n"))
    kept = stage(kept, "simhash-kept")
    #: Ids are rarely repeated; only rows with such an id need their fingerprint again.
    clear = kept.groupBy(own).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.min("root").alias("root"))
    ids = F.col(own).isNotNull() & (F.col("k") == 1) & (F.col("n") == 1)
    all_ids = groups.groupBy(own).agg(F.count("*").alias("rows"))
    single = clear.where(ids).join(all_ids.where("rows = 1"), own).select(own)
    first = plain.join(single, own, "left_semi")
    rest = plain.join(kept.select(own).distinct().join(single, own, "left_anti").withColumnRenamed(own, "again"), F.col(own).eqNullSafe(F.col("again")), "left_semi")
    rest = rest.withColumn("print", mark(F.col(text)))
    rest = rest.join(kept.select(F.col(own).alias("again"), F.col("print").alias("mark")), F.col(own).eqNullSafe(F.col("again")) & (F.col("print") == F.col("mark")), "left_semi")
    return first.union(rest.dropDuplicates([own, "print"]).select(*held)).toDF(*docs.columns)
