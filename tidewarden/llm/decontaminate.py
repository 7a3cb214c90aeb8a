"""Benchmark decontamination by a Wu-Manber search over words.

Patterns are windows of 13 consecutive words of a benchmark item (all words of a shorter one). Patterns
of one length are searched together: the shift table says for a block of two words how far the window
may move because no pattern holds that block nearer to its end; where the shift is zero, the bucket
of the block holds the patterns that end with it, and their words are compared one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.pieces import Chunks, remember_only, sections
from tidewarden.sources.staging import stage

WINDOW = 13
#: A set of patterns has about so many words at most; larger benchmarks are searched set by set.
SET_WORDS = 2_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_SQL = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of digits, letters and characters beyond ASCII."""
    return _WORD.findall(text.encode().lower())


class Patterns:
    """Tables of one set of patterns, by pattern length."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.items, self.window = items, window
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.base = len(self.number) + 1
        self.classes = {}
        for pattern, own in owners.items():
            size = len(pattern)
            shift, bucket = self.classes.setdefault(size, ({}, {}))
            for end in range(1 if size > 1 else 0, size):
                block = (pattern[end - 1] if size > 1 else 0) * self.base + pattern[end]
                shift[block] = min(shift.get(block, size), size - 1 - end)
            bucket.setdefault(block, []).append((pattern, own))
        self.chunks = Chunks(self._ids)

    def __reduce__(self):
        return Patterns, (self.items, self.window)

    def _ids(self, strings: list[str]) -> list[bytes]:
        get = self.number.get
        return [np.array([get(w, 0) for w in words_of(s)], "<u4").tobytes() for s in strings]

    def search(self, texts: list[str]) -> list[tuple[int, list[int], list]]:
        """Per text: its words, the places of words inside an occurrence, and the items that occur."""
        ids, n = self.chunks.items(texts)
        ids = ids.astype(np.int64)
        # A block with a word that no pattern has is 0 and so in no table.
        pairs = np.concatenate([[0], np.where((ids[1:] > 0) & (ids[:-1] > 0), ids[:-1] * self.base + ids[1:], 0)]) if len(ids) else ids
        out, at = [], 0
        for size in n.tolist():
            hit, items = set(), set()
            own = ids[at : at + size]
            for length, (shift, bucket) in self.classes.items():
                blocks = (pairs if length > 1 else ids)[at : at + size].tolist()
                far, i = max(1, length - 1), length - 1
                while i < size:
                    step = shift.get(blocks[i], far)
                    if step:
                        i += step
                        continue
                    for pattern, owner in bucket.get(blocks[i], ()):
                        if own[i - length + 1 : i + 1].tolist() == list(pattern):
                            hit.update(range(i - length + 1, i + 1))
                            items |= owner
                    i += 1
            out.append((size, sorted(hit), [x for x in items if x is not None]))
            at += size
        return out


def _searcher(spark, items: list[tuple[int, str]], window: int):
    sent = spark.sparkContext.broadcast(Patterns(items, window))

    @F.arrow_udf("struct<n_words: long, hit: array<int>, items: array<long>>")
    def search(texts: pa.Array) -> pa.Array:
        remember_only(None)
        found = [x for s in sections(texts) for x in sent.value.search(s)]
        n, hit, items = zip(*found) if found else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], ["n_words", "hit", "items"])

    return search


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, found: str = "found", set_words: int = SET_WORDS) -> DataFrame:
    """docs with a column `found`: struct(n_words, hit, items).

    hit: places of the words inside any occurrence of a pattern; items: ids with such patterns. Null texts
    have no words, items of null text no patterns; an item without an id marks words but is not listed;
    repeated items count once. Rows of docs stay as they are, repeated ones too. An empty benchmark hits nothing.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(item_text_col, F.lit("")).alias("words"))
    size = items.agg(F.sum(F.regexp_count("words", F.lit(_WORD_SQL)))).first()[0] or 0
    sets = max(1, -(-size // set_words))
    spark = docs.sparkSession
    for k in range(sets):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(sets)) == k)
        own = _searcher(spark, sorted({(r["item"], r["words"]) for r in part.toLocalIterator()}, key=str), window)(F.col(text_col))
        if k == 0:
            docs = docs.withColumn(found, own)
        else:
            more, had = own, F.col(found)
            docs = stage(docs, "decontaminate").withColumn("more_found", more)
            merged = F.struct(had["n_words"].alias("n_words"), F.array_union(had["hit"], F.col("more_found.hit")).alias("hit"), F.array_union(had["items"], F.col("more_found.items")).alias("items"))
            docs = docs.withColumn(found, merged).drop("more_found")
    return docs


def report(marked: DataFrame, id_col: str = "doc_id", found: str = "found") -> DataFrame:
    """id, n_words, n_hit, items (sorted as strings), contaminated: some word hit, and a twentieth of the words at least."""
    n, hit = F.col(f"{found}.n_words"), F.size(f"{found}.hit").cast("long")
    items = F.array_sort(F.transform(f"{found}.items", lambda x: x.cast("string")))
    return marked.select(F.col(id_col), n.alias("n_words"), hit.alias("n_hit"), items.alias("items"), ((hit > 0) & (20 * hit >= n)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    held = [f"held_{i}" for i in range(len(docs.columns))]
    marked = mark(docs.toDF(*held), benchmark, held[docs.columns.index(text_col)])
    n, hit = F.col("found.n_words"), F.size("found.hit")
    return marked.where(~((hit > 0) & (20 * hit >= n))).select(*held).toDF(*docs.columns)
