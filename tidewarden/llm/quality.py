"""Quality scores from random-indexing word vectors and a small calibrated network.

Every token hashes to a bucket, and a bucket has a sparse random index vector. The vector of a bucket
is the sum of the index vectors of its neighbours over the whole corpus. A document is the mean and the
spread of its tokens' vectors; a two-layer network scores it, with probabilities calibrated by one temperature.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.labelled import bounded, with_text
from tidewarden.llm.pieces import Chunks, row_of, sections

BUCKETS, DIMS, WINDOW, NONZERO = 1 << 14, 32, 2, 4
#: At most so many labelled rows are fitted to.
MAX_LABELLED = 20_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _buckets(strings: list[str]) -> list[bytes]:
    return [np.array([zlib.crc32(t.encode()) % BUCKETS for t in _TOKEN.findall(s)], "<u4").tobytes() for s in strings]


_MEMORY = Chunks(_buckets)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    items, n = _MEMORY.items(texts)
    return items.astype(np.int64), n


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places and signs of its few non-zero components."""
    draw = np.random.default_rng(20240131)
    return draw.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO], draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMS unit vectors from the neighbours of every token of every text; a table of fixed size."""

    def count(batches):
        place, sign = _index_vectors()
        sums = np.zeros(BUCKETS * DIMS)
        for texts in (s for b in batches for s in sections(b.column(0), 2048)):
            tokens, n = _tokens(texts)
            doc = row_of(n)
            for gap in range(1, WINDOW + 1):
                same = doc[gap:] == doc[:-gap]
                left, right = tokens[:-gap][same], tokens[gap:][same]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        sums += np.bincount(word * DIMS + place[near, k], sign[near, k], BUCKETS * DIMS)
        table = sums.reshape(BUCKETS, DIMS)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32)} | {f"v{d}": table[used, d].astype(np.int64) for d in range(DIMS)})

    texts = docs.select(text_col)
    split, cores = texts.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    # A task sends a table of fixed size, so each takes several splits.
    texts = texts.coalesce(min(split, max(3 * cores, split // 8)))
    schema = "bucket int, " + ", ".join(f"v{d} long" for d in range(DIMS))
    rows = texts.mapInArrow(count, schema).groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)]).collect()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMS))
    for bucket, *vector in rows:
        table[bucket] = vector
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each text; no tokens give zeros."""
    tokens, n = _tokens(texts)
    doc = row_of(n)
    total, square = np.zeros((len(n), DIMS)), np.zeros((len(n), DIMS))
    for at in range(0, len(tokens), 100_000):
        some, own = vectors[tokens[at : at + 100_000]], doc[at : at + 100_000]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[first]] += np.add.reduceat(some, first, axis=0)
        square[own[first]] += np.add.reduceat(some * some, first, axis=0)
    size = np.maximum(n, 1)[:, None]
    mean = total / size
    return np.hstack([mean, np.sqrt(np.maximum(square / size - mean**2, 0))])


@dataclass
class Network:
    """Scales of the inputs, two layers and a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature is that of least log loss on the rest.

    With no rows the score is 0.5 everywhere, with one class the share of label 1, smoothed.
    """
    draw, size = np.random.default_rng(seed), x.shape[1]
    shift, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(size), np.ones(size))
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Network(shift, scale, draw.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return net
    order = draw.permutation(len(x))
    rest, train = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - shift) / scale
    net.w2 = draw.normal(0, hidden**-0.5, hidden)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        draw.shuffle(train)
        for at in range(0, len(train), 256):
            own = train[at : at + 256]
            h = np.tanh(z[own] @ values[0] + values[1])
            wrong = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -30, 30))) - y[own]) / len(own)
            back = wrong[:, None] * values[2] * (1 - h * h)
            slopes = [z[own].T @ back + 1e-4 * values[0], back.sum(0), h.T @ wrong + 1e-4 * values[2], np.array([wrong.sum()])]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for v, g, a, b in zip(values, slopes, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(values[3][0])
    if len(rest):
        logits, truth = net.logits(x[rest]), y[rest]
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, and the network fitted to at most `most` labelled rows that `train` allows."""
    vectors = word_vectors(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([row for s in sections(texts) for row in pooled(s, sent.value)], pa.list_(pa.float64()))

    sample = with_text(bounded(labels, id_col, label_col, train, most), docs, id_col, text_col)
    rows = sorted(sample.select("id", "label", features("text").alias("x")).collect())  # bounded by `most` and copies of ids
    x = np.array([r["x"] for r in rows]).reshape(len(rows), 2 * DIMS)
    return vectors, fit_network(x, np.array([r["label"] for r in rows]))


def score(spark, model: tuple[np.ndarray, Network], text: Column) -> Column:
    """Probability of label 1 for a text; a null text is scored as an empty one."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        vectors, net = sent.value
        out = [net.probability(pooled(s, vectors)) for s in sections(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return probability(text)
