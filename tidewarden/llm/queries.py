"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from tidewarden.llm import bpe, collocations, decontaminate, licenses, maxscore, packing, pii, quality, simhash, token_counts, token_files, toxicity, whitening
from tidewarden.llm.labelled import fold
from tidewarden.sources.staging import shared_folder

REGISTRY = {}
ORACLES = {}


def register(f):
    REGISTRY[f.__name__] = f
    return f


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_simhash_dedup(spark, sf_dir):
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@register
def op2_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


@register
def op3_token_files(spark, sf_dir):
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_checks(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def _bpe(docs):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return docs.select("doc_id", bpe.digests(bpe.encode(F.col("text"), path, pattern), path, pattern).alias("d")).select("doc_id", "d.*")


@register
def op4_byte_bpe(spark, sf_dir):
    return _bpe(_table(spark, sf_dir, "documents"))


@register
def op5_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op6_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held)
    rows = docs.select("doc_id", held.alias("held_out"), quality.score(spark, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def _toxicity(spark, docs, sf_dir):
    return toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


@register
def op7_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = _toxicity(spark, docs, sf_dir)
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.score(spark, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register
def op8_pii(spark, sf_dir):
    rows = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@register
def op9_decontaminate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.report(decontaminate.mark(docs, _table(spark, sf_dir, "benchmark")))
    joined = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined, "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op9_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(w) >= size),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM di),
occ AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
places AS (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register
def op10_top_k(spark, sf_dir):
    rows = maxscore.whole_numbers(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    best = maxscore.top_k(rows.where(F.col("id") % 50 == 0), rows, 5)
    return best.select("query_id", "rank", F.col("row_id").alias("vec_id"), "score")


ORACLES["op10_top_k"] = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register
def op13_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op11_phrase_collocations(spark, sf_dir):
    return collocations.mine(_table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) s WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
cut AS (SELECT lang, phrase, size, a, k, w, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS k) s WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, cut.size, cut.a, cut.k, x.a AS l, y.a AS r, CAST(2000000 * CAST(cut.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, size - m + 2)]) AS phrase, a AS fa FROM c, (SELECT unnest([2, 3]) AS m) s WHERE m < size),
around AS (SELECT lang, phrase, max(fa) AS fa FROM inside GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN around USING (lang, phrase) WHERE fa IS NULL OR 100 * fa < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


@register
def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
