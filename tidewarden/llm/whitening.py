"""Whitening of embeddings by the leading eigenvectors of their covariance, found by block Jacobi-Davidson.

The covariance is never formed. A Spark job multiplies it with a block of vectors: every task centres
its rows first and adds up C' (C w). The driver holds a search space of a few dozen vectors, improves it
by corrections from an inner MINRES solver, and locks eigenpairs, largest first, whose residuals reach
double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.sources.staging import stage

EPS = np.finfo(float).eps
#: A residual this small, against the largest eigenvalue, is rounding.
DONE = 64 * EPS
#: Where rounding may already stop the fall.
NEAR = 100 * DONE
#: Eigenvalues below this part of the largest one are rounding too: such directions hold no variance to whiten.
FLAT = 1e-11
_INNER, _PATIENCE = 6, 4

Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(rows: DataFrame, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """`rows` plus x, the whole numbers floor(scale * entry) + shift, for rows whose vector has finite entries only.

    Vectors of another length than the commonest one (of equally common ones the longest) take no part either.
    """
    finite = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vector_col, lambda e: F.floor(e.cast("double") * scale) + F.lit(shift).cast("long"))
    kept = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(vector_col) > 0)).withColumn("x", whole)
    most = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return kept.where(F.size("x") == (most["d"] if most else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of every dimension; exact."""

    def add(batches):
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + _matrix(b.column(0), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([*range(d), d]), pa.array([*total.tolist(), n])], ["at", "v"])

    sums = {r["at"]: int(r["v"]) for r in fit.select("x").mapInArrow(add, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return sums.get(d, 0), [sums.get(i, 0) for i in range(d)]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the numerator is a whole number, so nothing is lost before the division."""
    return (n * x - sums) / n


def covariance_product(fit: DataFrame, n: int, sums: list[int]) -> Product:
    """w (d x b) -> covariance times w, by one job; a task sends d rows, and they are added up before the driver sees them."""
    d, s = len(sums), np.array(sums)
    at = pa.array(range(d), pa.int32())

    def product(w: np.ndarray) -> np.ndarray:
        names = [f"v{i}" for i in range(w.shape[1])]

        def multiply(batches):
            total = np.zeros(w.shape)
            for b in batches:
                c = _centred(_matrix(b.column(0), d), n, s)
                total += c.T @ (c @ w)
            yield pa.RecordBatch.from_arrays([at, *map(pa.array, total.T)], ["at", *names])

        parts = fit.select("x").mapInArrow(multiply, ", ".join(["at int", *[f"{v} double" for v in names]]))
        out = np.zeros(w.shape)
        for r in parts.groupBy("at").agg(*[F.sum(v).alias(v) for v in names]).collect():
            out[r["at"]] = [r[v] for v in names]
        return out / n

    return product


def _orthogonal(new: np.ndarray, *to: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` has beside `to`; nearly dependent directions are left out."""
    for _ in range(2):
        for old in to:
            new = new - old @ (old.T @ new)
    u, size, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, size > 1e-10 * max(size.max(initial=0), 1e-300)]
    for old in to:
        u = u - old @ (old.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def _corrections(product: Product, theta: np.ndarray, ritz: np.ndarray, residual: np.ndarray, locked: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on (I - qq')(V - theta)(I - qq') t = -residual, one equation per column; q: the locked vectors and the column's own.

    All columns share a product, so a step is one job.
    """

    def projected(t: np.ndarray) -> np.ndarray:
        t = t - locked @ (locked.T @ t)
        return t - ritz * (ritz * t).sum(0)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    v = projected(-residual)
    size = np.linalg.norm(v, axis=0)
    v, eta, first = over(v, size), size, size
    before, w, w_before, t = (np.zeros(v.shape) for _ in range(4))
    beta, s, s_before = (np.zeros(v.shape[1]) for _ in range(3))
    c, c_before = np.ones(v.shape[1]), np.ones(v.shape[1])
    for _ in range(steps):
        next_v = projected(product(v) - theta * v)
        alpha = (v * next_v).sum(0)
        next_v = next_v - alpha * v - beta * before
        next_beta = np.linalg.norm(next_v, axis=0)
        delta = c * alpha - c_before * s * beta
        rho = np.hypot(delta, next_beta)
        next_w = over(v - (s * alpha + c_before * c * beta) * w - s_before * beta * w_before, rho)
        c_before, c, s_before, s = c, over(delta, rho), s, over(next_beta, rho)
        t = t + c * eta * next_w
        eta = -s * eta
        w_before, w, before, v, beta = w, next_w, v, over(next_v, next_beta), next_beta
        if (np.abs(eta) <= 0.05 * first).all():
            break
    return projected(t)


def leading_eigenpairs(product: Product, d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit vectors as columns.

    The search starts from random directions, a few more than wanted. Pairs are locked in order of
    their values, so none is passed over while a larger one is still on its way.
    """
    rng = np.random.default_rng(seed)
    locked, spare = np.zeros((d, 0)), min(d, wanted + 4)
    most = min(d, 3 * spare)
    space = _orthogonal(rng.standard_normal((d, spare)))
    image, best, waited = product(space), np.inf, 0
    while True:
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max(np.abs(theta).max(initial=0), 1e-300) if not locked.shape[1] else top
        need = wanted - locked.shape[1]
        bad = size > DONE * top
        worst = size[:need].max(initial=0)
        waited, best = (0, worst) if worst < best / 2 else (waited + 1, best)
        # Rounding may stop the fall a little above the mark, and a space of all dimensions has no more to find.
        if waited >= _PATIENCE and worst <= NEAR * top or locked.shape[1] + space.shape[1] == d and waited:
            bad[:] = False
        ready = int(np.argmax(bad)) if bad.any() else len(bad)
        if ready:
            take = min(ready, need)
            locked = np.linalg.qr(np.hstack([locked, space[:, :take]]))[0]
            space, image, theta, residual, size, bad = space[:, take:], image[:, take:], theta[take:], residual[:, take:], size[take:], bad[take:]
            best, waited = np.inf, 0
        if locked.shape[1] >= wanted:
            break
        act = np.flatnonzero(bad)[: wanted - locked.shape[1] + 2]
        more = _corrections(product, theta[act], space[:, act], residual[:, act], locked, _INNER)
        if space.shape[1] + len(act) > most:
            space, image = space[:, :spare], image[:, :spare]
        more = _orthogonal(more, locked, space)
        if more.shape[1]:
            space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    # The vectors together once more, by a fresh product.
    values, turn = np.linalg.eigh((lambda h: (h + h.T) / 2)(locked.T @ product(locked)))
    return values[::-1], locked @ turn[:, ::-1]


def whiten(rows: DataFrame, id_col: str, vector_col: str, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row per vector and component, from 1.

    The fit is over distinct whole-number vectors x = floor(scale * entry) + shift, each once however
    often it occurs; n is their number, deviation the exact sum over dimensions of (n x - sum)^2. All
    rows with finite vectors are returned, repeated ones repeatedly; null vectors and those with null
    or non-finite entries are not. There are never more components than dimensions or than n - 1, and
    none without variance (tied eigenvalues give any basis of their space); fewer than two distinct
    vectors, or no rows, give no rows. Whole numbers that pass 64 bits fail the job.
    """
    own = stage(whole_vectors(rows.select(F.col(id_col), F.col(vector_col)), vector_col, scale, shift).select(id_col, "x"), "whole-vectors")
    one = own.select(F.size("x").alias("d")).first()
    out = f"{id_col} {own.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stage(own.select("x").distinct(), "fit-list")
    d = one["d"] if one else 0
    n, sums = _sums(fit, d) if d else (0, [])
    wanted = min(components, d, n - 1)
    if wanted < 1:
        return own.select(id_col).limit(0).selectExpr(id_col, *[f"cast(null AS {kind}) AS {name}" for name, kind in (x.split() for x in out.split(", ")[1:])])
    product, s = covariance_product(fit, n, sums), np.array(sums)
    values, vectors = leading_eigenpairs(product, d, wanted)
    kept = values > FLAT * values[0]
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    unit = vectors / np.sqrt(values)
    error = float(np.abs(unit.T @ product(unit) - np.eye(len(values))).max())
    total = fit.agg(F.sum(_deviation(F.col("x"), n, sums).cast("double"))).first()[0]
    explained = values / (total / n / n / n)
    k = len(values)

    def project(batches):
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                c = _centred(_matrix(b.column(1), d), n, s)
                columns = [
                    b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                    pa.array(np.full(k * b.num_rows, n)), b.column(2).take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array((c @ unit).ravel()),
                    pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(k * b.num_rows, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in out.split(", ")])

    return own.select(id_col, "x", _deviation(F.col("x"), n, sums).alias("deviation")).mapInArrow(project, out)


def _deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n x - sum)^2, exact; beyond 64 bits the job fails."""
    off = F.zip_with(x, F.array(*[F.lit(v).cast("long") for v in sums]), lambda a, b: a * F.lit(n).cast("long") - b)
    return F.aggregate(off, F.lit(0).cast("long"), lambda total, o: total + o * o)
