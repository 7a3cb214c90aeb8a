import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewarden.llm import whitening
from tidewarden.llm.queries import REGISTRY


def plain(vectors):
    """x per row, and over the distinct ones: n, sums, eigenvalues and vectors by numpy, trace."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    c = np.array((n * fit - sums), float) / n
    v = c.T @ c / n
    values, basis = np.linalg.eigh(v)
    return x, n, sums, values[::-1], basis[:, ::-1], np.trace(v)


def valid(v):
    return v is not None and all(e is not None and math.isfinite(e) for e in v)


def compare(rows, table, components=16):
    vectors = [v for _, v in table]
    x, n, sums, values, basis, trace = plain(vectors)
    k = max(r["component"] for r in rows)
    assert len(rows) == k * len(table)
    own = {}
    for r in rows:
        own.setdefault(r["vec_id"], {})[r["component"]] = r
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9
    got = np.array([[own[i][j + 1]["whitened"] for j in range(k)] for i, _ in table])
    want = (np.array([[n * a - s for a, s in zip(row, sums)] for row in x], float) / n) @ basis[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(0))
    for (i, _), row in zip(table, x):
        r = own[i][1]
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(row, sums))
    for j in range(k):
        assert abs(own[table[0][0]][j + 1]["explained"] / (values[j] / trace) - 1) < 1e-9
        gap = min(abs(values[j] - values[i]) for i in range(len(values)) if i != j) / values[0]
        if gap > 1e-6:
            assert np.allclose(got[:, j] * sign[j], want[:, j], atol=1e-12 / gap + 1e-9)


def test_query_on_the_table(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if valid(r["embedding"])]
    rows = REGISTRY["op12_embedding_whitening"](spark, SF).collect()
    assert max(r["component"] for r in rows) == 16
    compare(rows, table)


def test_wide_vectors_with_slowly_falling_variance(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 150)) * np.linspace(3, 1, 150)
    table = [(i, row.astype(np.float32).tolist()) for i, row in enumerate(data)]
    compare(whitening.whiten(spark.createDataFrame(table, "vec_id long, v array<float>"), "vec_id", "v").collect(), table)


def test_repeated_rows_are_fitted_once_and_returned_each_time(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 5)).tolist()
    table = [(i, v) for i, v in enumerate(base + [base[0]] * 300)]
    compare(whitening.whiten(spark.createDataFrame(table, "vec_id long, v array<double>"), "vec_id", "v").collect(), table)


def test_flat_directions_give_no_component(spark):
    table = [(i, [float(i % 7), 2.0 * (i % 7), 1.0, float(i % 3)]) for i in range(50)]
    rows = whitening.whiten(spark.createDataFrame(table, "vec_id long, v array<double>"), "vec_id", "v").collect()
    assert max(r["component"] for r in rows) == 2
    compare(rows, table)


def test_odd_rows_and_empty_table(spark, sf_dir, empty_dir):
    rows = REGISTRY["op12_embedding_whitening"](spark, sf_dir).collect()
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if valid(r["embedding"])]
    assert {r["vec_id"] for r in rows} == {i for i, _ in table} and max(r["component"] for r in rows) <= 3
    out = REGISTRY["op12_embedding_whitening"](spark, empty_dir)
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, v array<double>")
    assert whitening.whiten(one, "vec_id", "v").count() == 0


@pytest.mark.parametrize("d, wanted", [(5, 5), (64, 16), (300, 16)])
def test_eigenpairs_of_close_and_tied_values(d, wanted):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(np.concatenate([[5, 5, 4.999], rng.uniform(1, 4, d - 3)]))[::-1]
    v = (basis * values) @ basis.T
    calls = []
    got, vectors = whitening.leading_eigenpairs(lambda w: calls.append(1) or v @ w, d, wanted)
    assert np.allclose(got, values[:wanted], rtol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * got, axis=0).max() < 1e-12 * 5
    assert len(calls) < 400
    print(len(calls))
