"""Corpus cleaning: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.llm import bpe, decontaminate, pii, simhash, toxicity
from tidewarden.llm.labelled import fold
from tidewarden.sources.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from labelled rows of all folds but one.

    Null and empty texts have a score like any other; repeated rows stay or go together; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return docs.where(toxicity.score(spark, model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by fingerprints of four-word shingles at most 4 bits apart.

    Null and empty texts share the fingerprint zero and so are one group; of rows that repeat a doc_id one stays.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages; a text without words stays."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away replaced in the text; n_chars follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes they decode to, which must be the text's.

    A null or empty text has no ids; every row, repeated ones too, gives a row.
    """
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "text", bpe.encode(F.col("text"), path, pattern).alias("ids"))
    rows = rows.select("doc_id", "ids", "text", bpe.digests(F.col("ids"), path, pattern).alias("d"))
    same = F.col("d.decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)
    return rows.select("doc_id", "d.n_tokens", "ids", "d.ids_sha256", "d.decoded_sha256", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise_personal_data),
    ("byte_bpe", encode),
]

#: SQL has neither the classifier, the fingerprints nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
