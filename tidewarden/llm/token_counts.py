"""Token counts for every context limit from one exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.llm.pieces import remember_only, sections
from tidewarden.sources.staging import stage

_LOADED: dict[tuple[str, str], object] = {}
#: Lengths are summed in ranges first, so that no window runs over all of them.
RANGE = 1024
#: Characters of a text that the library gets at once, about, and texts that are Python strings at once.
BLOCK, SECTION = 1 << 20, 256
#: Pre-tokenizers always cut before a space that follows something else than white space.
_CUT = re.compile(r"\S(?= )")


def _summed(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    ends = np.cumsum(lengths)
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return upto[ends] - upto[ends - lengths]


def _blocks(text: str):
    at = 0
    while len(text) - at > BLOCK and (cut := _CUT.search(text, at + BLOCK)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def _library(path: str, pattern: str):
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def counts(texts: pa.Array, path: str, pattern: str) -> np.ndarray:
    """Tokens of each text. Texts go to the library as they are: a number per distinct word costs more than the word's tokens, and room."""
    remember_only(None)
    encode = _library(path, pattern).encode_ordinary
    found = [[len(encode(block)) for block in _blocks(text)] for some in sections(texts, SECTION) for text in some]
    return _summed(np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found)))


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text under a rank file, special tokens as ordinary text; null or empty: 0."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counts(texts, path, pattern), pa.int64())

    return count(text)


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Columns n_tokens and n_docs: every length that occurs. Null lengths are left out."""
    return lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For every length as a context limit: what lies at or above it, and totals when texts are cut there.

    context_limit, n_docs (of just this length), docs_over (longer ones), docs_within, tokens_over (all
    tokens of longer documents), tokens_within, truncated_total (tokens if longer documents are cut at the
    limit), lost_tokens, share_within (of documents; the limit is that quantile). An empty histogram has no rows.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    ranged = hist.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    sums = ranged.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per range of lengths
    zero = F.lit(0)
    above = sums.select("range", F.coalesce(F.sum("d").over(later), zero).alias("d_above"), F.coalesce(F.sum("t").over(later), zero).alias("t_above"))
    total = sums.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", F.coalesce(F.sum("n_docs").over(inside), zero).alias("d_in"), F.coalesce(F.sum(tokens).over(inside), zero).alias("t_in"))
    out = out.join(above, "range").withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")  # one row
    over, tokens_over = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    within = F.col("all_tokens") - tokens_over
    return out.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", over.alias("docs_over"), (F.col("all_docs") - over).alias("docs_within"),
        tokens_over.alias("tokens_over"), within.alias("tokens_within"), (within + F.col("n_tokens") * over).alias("truncated_total"),
        (tokens_over - F.col("n_tokens") * over).alias("lost_tokens"), ((F.col("all_docs") - over) / F.col("all_docs")).alias("share_within"),
    )


def at_limits(table: DataFrame, wanted: list[int]) -> DataFrame:
    """Rows of limits() carried over to any context limits: asked, docs_over, truncated_total, lost_tokens.

    A limit between two lengths follows from the next lower one: every longer document is cut a bit later.
    """
    floor = table.agg(*[F.max(F.when(F.col("context_limit") <= x, F.struct("context_limit", "docs_over", "truncated_total", "lost_tokens"))).alias(f"l{x}") for x in sorted(set(wanted))], F.sum("n_docs").alias("all"), F.sum(F.col("n_docs") * F.col("context_limit")).alias("tokens"))
    pairs = F.array(*[F.struct(F.lit(int(x)).cast("long").alias("asked"), F.col(f"l{x}").alias("at")) for x in sorted(set(wanted))])
    row = floor.select(F.explode(pairs).alias("p"), "all", "tokens").select("p.asked", "p.at", "all", "tokens")
    more = (F.col("asked") - F.coalesce("at.context_limit", F.lit(0))) * F.coalesce("at.docs_over", "all")
    cut = F.coalesce("at.truncated_total", F.lit(0)) + more
    return row.where("all is not null").select("asked", F.coalesce("at.docs_over", "all").alias("docs_over"), cut.alias("truncated_total"), (F.col("tokens") - cut).alias("lost_tokens"))


def quantile(table: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length that holds each share of documents: share, n_tokens."""
    found = table.agg(*[F.min(F.when(F.col("share_within") >= s, F.col("context_limit"))).alias(f"q{i}") for i, s in enumerate(shares)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("x")).select("x.*")


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """limits() of the histogram of all texts of docs. Null texts count as empty; repeated rows count again.

    The histogram is written first: its readers would each encode all texts.
    """
    hist = histogram(docs.select(token_count(F.col(text_col), path, pattern).alias("n_tokens")))
    return limits(stage(hist, "token-lengths"))
