"""Exact top-k by inner product over whole-number vectors, by MaxScore.

A term of a query is a component with a weight; its postings are the rows of a block whose component
has the sign of the weight, so that they add to the score, and the other rows lose by it. The bound of a
term is its weight times the largest such component of the block. Terms are taken by falling bound. The
last ones, whose bounds together cannot reach the k-th best score so far, are non-essential: a row in no
posting of an essential term is never looked at. The others' scores are completed term by term while
what is left could still lift them to the k-th best. Blocks keep k rows per query; these are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidewarden.sources.staging import stage

BLOCK_ROWS, QUERY_ROWS = 4096, 4096


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and x = floor(scale * component) of rows whose vector and components are there and finite."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * scale).cast("long"))
    good = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of the lists, zeros where a vector is shorter than the longest, which has `size` components."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size), np.int64)
    out[np.arange(size) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def search_block(ids: np.ndarray, columns: np.ndarray, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best (score, id) of `best` and a block (columns: components x rows), ties to smaller ids, without id `own`."""
    high, low = columns.max(1), columns.min(1)
    bound = np.maximum(np.where(query > 0, query * high, query * low), 0)
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what terms i.. can add at most
    floor = best[k - 1][0] if len(best) >= k else None
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    if floor is not None:
        essential = int(np.count_nonzero(rest[:-1] >= floor)) if floor > 0 else len(order)
        in_posting = np.zeros(len(alive), bool)
        for d in order[:essential]:
            in_posting |= columns[d, alive] * query[d] > 0
            if in_posting.all():
                break
        alive = alive[in_posting] if floor > 0 else alive
        score = np.zeros(len(alive), np.int64)
    step = 4
    for at in range(0, len(order), step):
        own_terms = order[at : at + step]
        score += query[own_terms] @ columns[own_terms][:, alive]
        if floor is not None:
            keep = score + rest[min(at + step, len(order))] >= floor
            if not keep.all():
                alive, score = alive[keep], score[keep]
        if not len(alive):
            return best
    found = {i: s for s, i in best}
    take = np.lexsort((ids[alive], -score))
    for j in take.tolist():
        i, s = int(ids[alive[j]]), int(score[j])
        if len(found) >= k and s < min(found.values()):
            break
        found[i] = max(s, found.get(i, s))
        if len(found) > 4 * k:
            found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])
    return sorted(((s, i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k]


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), row_id, score: the k best rows for each query, ties to the smaller id.

    queries and rows: id and x (array<long>). A query is not compared with rows of its own id. Of several
    rows with one id the best counts, of several queries with one id the smallest vector. A shorter vector
    ends in zeros. Queries go out in sets of about query_rows, each against all rows; fewer than k rows give
    fewer results, no rows or queries none.
    """
    spark = rows.sparkSession
    asked = stage(queries.groupBy("id").agg(F.min("x").alias("x")), "maxscore-queries")
    rows = stage(rows, "maxscore-rows")
    size = max(rows.agg(F.max(F.size("x"))).first()[0] or 0, asked.agg(F.max(F.size("x"))).first()[0] or 0)
    sets = max(1, -(-asked.count() // query_rows))
    schema = "query_id long, row_id long, score long"
    found = None
    for number in range(sets):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == number).orderBy("id").collect()  # about query_rows
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in some], np.int64), [r["x"] for r in some]))

        def search(batches, sent=sent):
            own, lists = sent.value
            wanted = _matrix(pa.array(lists, pa.list_(pa.int64())), size) if len(lists) else np.zeros((0, size), np.int64)
            best = [[] for _ in own]
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    columns = np.ascontiguousarray(_matrix(part.column(1), size).T)
                    for q in range(len(own)):
                        best[q] = search_block(ids, columns, wanted[q], int(own[q]), k, best[q])
            out = [(int(own[q]), i, s) for q in range(len(own)) for s, i in best[q]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["query_id", "row_id", "score"])

        one = stage(rows.mapInArrow(search, schema), "maxscore-found")
        found = one if found is None else found.union(one)
    best = found.groupBy("query_id", "row_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")  # k rows from each task
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")
