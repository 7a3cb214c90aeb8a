"""Token ids in block files: frequency-ranked, byte-aligned, with separate control bytes.

A block holds consecutive documents of ascending id. Its ids are replaced by their rank of frequency
in the block (rank table in the block), so frequent ids take one byte and nearly all others two.
Values take one to four bytes; a control byte holds the sizes of four of them, apart from the data.
Blocks are rows of a Parquet table: binary columns, written and committed by Spark, whole on their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewarden.llm.chunk_ids import ChunkIds
from tidewarden.llm.word_ranks import encoder

BLOCK = "part int, seq long, first_token long, n_tokens long, n_docs long, docs binary, ranks binary, control binary, data binary"
SECTION = 2048
_NULL_ID = np.iinfo(np.int64).min
#: Per control byte: the sizes of its four values, and where each starts within their bytes.
_SIZES = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1
_OFFSETS = np.cumsum(_SIZES, 1) - _SIZES
_TOTALS = _SIZES.sum(1)


_SCHEMA = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in BLOCK.split(", "))])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers; any number of them, none included."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers that pack() took."""
    codes = np.frombuffer(control, np.uint8)
    starts = np.cumsum(_TOTALS[codes]) - _TOTALS[codes]
    at = (starts[:, None] + _OFFSETS[codes]).ravel()[:n]
    size = _SIZES[codes].ravel()[:n]
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(size > k, padded[np.minimum(at + k, len(padded) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def _block(part: int, seq: int, first: int, ids: list, lengths: list, tokens: np.ndarray) -> dict:
    counts = np.bincount(tokens)
    order = np.lexsort((np.arange(len(counts)), -counts))
    ranked = order[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    control, data = pack(rank[tokens])
    docs = np.array([ids, lengths], "<i8").tobytes()
    return {"part": part, "seq": seq, "first_token": first, "n_tokens": len(tokens), "n_docs": len(ids), "docs": docs, "ranks": ranked.tobytes(), "control": control, "data": data}


_MEMORY: dict[str, ChunkIds] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write blocks in ascending order of id (equal ids by a hash of the text, null ids first).

    A block closes once it has block_tokens ids and never cuts a document. A null or empty text has the
    end id only. Repeated rows are written again. tokenizer: a file that every executor can read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Texts are moved before they are encoded: range bounds come from a look at the ids, which must not encode twice.
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("id", "mark").sortWithinPartitions("id", "mark")

    def write(batches):
        from pyspark import TaskContext

        if tokenizer not in _MEMORY:
            _MEMORY[tokenizer] = ChunkIds(encoder(tokenizer), spaced=True)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids, lengths, held, size = [], [], [], 0
        for keys, texts in ((b.column(0).slice(i, SECTION), b.column(1).slice(i, SECTION)) for b in batches for i in range(0, b.num_rows, SECTION)):
            tokens, n = _MEMORY[tokenizer].items(texts)
            ends = np.cumsum(n)
            tokens, n = np.insert(tokens, ends, end_id), n + 1
            keys = np.where(keys.is_null().to_numpy(zero_copy_only=False), _NULL_ID, keys.fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            for key, count in zip(keys.tolist(), n.tolist()):
                ids.append(key)
                lengths.append(count)
                held.append(tokens[at : at + count])
                at, size = at + count, size + count
                if size >= block_tokens:
                    yield pa.RecordBatch.from_pylist([_block(part, seq, first, ids, lengths, np.concatenate(held))], _SCHEMA)
                    seq, first, ids, lengths, held, size = seq + 1, first + size, [], [], [], 0
            held = [np.concatenate(held)] if held else []
        if ids:
            yield pa.RecordBatch.from_pylist([_block(part, seq, first, ids, lengths, np.concatenate(held))], _SCHEMA)

    coded = rows.select("id", "text").mapInArrow(write, BLOCK)
    coded.write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start (ids of all documents before it), n_tokens, ids (array), ids_crc32."""
    return _read(spark, path, id_col, True)


def read_checks(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """As read_tokens, without the ids."""
    return _read(spark, path, id_col, False)


def _read(spark, path: str, id_col: str, with_ids: bool) -> DataFrame:
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per file
    rows = blocks.join(before, "part").select((F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "n_docs", "docs", "ranks", "control", "data")

    def decode(batches):
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            tokens = np.frombuffer(row["ranks"], "<u4")[unpack(row["control"], row["data"], row["n_tokens"])]
            ids, n = np.frombuffer(row["docs"], "<i8").reshape(2, -1)
            ends = np.cumsum(n)
            raw = tokens.astype("<u4").tobytes()
            out = {
                "id": pa.array(ids, mask=ids == _NULL_ID), "start": row["start"] + ends - n, "n_tokens": n,
                "ids_crc32": [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(tokens.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(decode, schema).withColumnRenamed("id", id_col)
