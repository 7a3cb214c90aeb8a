"""Every query against its plain definition, over real and awkward texts and over empty tables."""

import brute
import duckdb
import pytest
from compare import connect, differences
from conftest import SF

import corpus_pipeline
from tidewarden.llm.queries import ORACLES, REGISTRY

DIRS = ["real", "odd"]


def run(spark, name, where, sf_dir):
    at = SF if where == "real" else sf_dir
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    return docs, [r.asDict() for r in REGISTRY[name](spark, at).collect()]


@pytest.mark.parametrize("where", DIRS)
def test_op1(spark, sf_dir, where):
    docs, rows = run(spark, "op1_simhash_dedup", where, sf_dir)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == brute.near_duplicates(docs)


@pytest.mark.parametrize("where", DIRS)
def test_op2(spark, sf_dir, where):
    docs, rows = run(spark, "op2_license_scan", where, sf_dir)
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows}
    assert got == {i: brute.licenses(t) for i, t in docs}
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("where", DIRS)
def test_op3(spark, sf_dir, where):
    docs, rows = run(spark, "op3_token_files", where, sf_dir)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == brute.token_files(docs)


@pytest.mark.parametrize("where", DIRS)
def test_op4(spark, sf_dir, where):
    docs, rows = run(spark, "op4_byte_bpe", where, sf_dir)
    library = brute.ranks("byte_bpe_multi_50k.tiktoken")
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {i: brute.bpe(t, library) for i, t in docs}


@pytest.mark.parametrize("where", DIRS)
def test_op5(spark, sf_dir, where):
    docs, rows = run(spark, "op5_token_counts", where, sf_dir)
    library = brute.ranks("byte_bpe_50k.tiktoken")
    n = [len(library.encode_ordinary(t or "")) for _, t in docs]
    assert sorted(r["context_limit"] for r in rows) == sorted(set(n))
    for r in rows:
        limit = r["context_limit"]
        assert r["truncated_total"] == sum(min(x, limit) for x in n) and r["lost_tokens"] == sum(n) - r["truncated_total"]
        assert (r["n_docs"], r["docs_over"], r["docs_within"]) == (n.count(limit), sum(x > limit for x in n), sum(x <= limit for x in n))
        assert (r["tokens_over"], r["tokens_within"]) == (sum(x for x in n if x > limit), sum(x for x in n if x <= limit))


@pytest.mark.parametrize("where", DIRS)
def test_op8(spark, sf_dir, where):
    docs, rows = run(spark, "op8_pii", where, sf_dir)
    got = {r["doc_id"]: tuple(r[f"n_{k}"] for k in brute.BASE) + (r["base_sha256"],) for r in rows}
    assert got == {i: brute.pii(t) for i, t in docs}


@pytest.mark.parametrize("where", DIRS)
def test_op9(spark, sf_dir, where):
    docs, rows = run(spark, "op9_decontaminate", where, sf_dir)
    got = {r["doc_id"]: tuple(r[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows}
    at = SF if where == "real" else sf_dir
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(docs, items) if where == "odd" else None
    assert want is None or got == want


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    assert differences(REGISTRY[name](spark, SF), connect(SF), ORACLES[name]) == []


def test_op10_on_awkward_vectors(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet/*.parquet') WHERE vec_id IS NOT NULL")
    assert differences(REGISTRY["op10_top_k"](spark, sf_dir), con, ORACLES["op10_top_k"]) == []


@pytest.mark.parametrize("name", ["op6_quality", "op7_toxicity"])
@pytest.mark.parametrize("where", DIRS)
def test_classifiers_return_every_document(spark, sf_dir, name, where):
    docs, rows = run(spark, name, where, sf_dir)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    line = 0.7 if name == "op6_quality" else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= line) for r in rows)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_empty_tables(spark, empty_dir, name):
    assert REGISTRY[name](spark, empty_dir).collect() == []


def test_pipeline(spark, sf_dir, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
    rows = corpus_pipeline.run(spark, SF).collect()
    library = brute.ranks("byte_bpe_multi_50k.tiktoken")
    assert rows and all(r["round_trip"] and library.decode_bytes(r["ids"]).decode() and len(r["ids"]) == r["n_tokens"] for r in rows)


def test_pipeline_stages_against_plain_definitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {c for _, _, c in brute.near_duplicates(plain)}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {w for _, t in items for w in brute.words(t)}
    some = [(i, t) for i, t in plain if len(held & set(brute.words(t))) > 12][:40]
    found = brute.contamination(some, items)
    left = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs.where(docs.doc_id.isin([i for i, _ in some])), SF).collect()}
    assert left == {i for i, x in found.items() if not x[-1]}
