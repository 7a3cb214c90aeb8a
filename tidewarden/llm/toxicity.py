"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic texts are labelled; everything else is unlabelled and holds toxic texts too. With
the share of toxic texts known, the risk on clean texts is that on unlabelled texts less the toxic part
of it; that estimate is kept from falling below zero, which would mean that single texts are learnt by heart.

Features are words whose document share among toxic texts lies clearly above that among all texts of the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.labelled import bounded
from tidewarden.llm.pieces import Chunks, remember_only, row_of, sections

#: Bounds of what is fitted to: confirmed toxic texts, unlabelled texts, candidate words, chosen words.
MAX_TOXIC, MAX_UNLABELLED, MAX_WORDS, MAX_FEATURES = 20_000, 20_000, 50_000, 4_096
_WORD = re.compile(r"[^\W_]+")
STEM = 5


def _features(text: str) -> list[str]:
    """Words of a lower-cased text, and the beginnings of those with five letters or more, which inflected forms share."""
    words = _WORD.findall(text)
    return words + [f"{w[:STEM]}^" for w in words if len(w) >= STEM]


class Lexicon:
    """Numbers of known words in texts."""

    def __init__(self, words: list[str]):
        self.words = words
        self.number = {w: i for i, w in enumerate(words)}
        self.chunks = Chunks(self._find)

    def __reduce__(self):
        return Lexicon, (self.words,)

    def _find(self, strings: list[str]) -> list[bytes]:
        get = self.number.get
        return [np.array([i for w in _features(s) if (i := get(w)) is not None], "<u4").tobytes() for s in strings]

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the known words in the lower-cased texts, each once per text."""
        items, n = self.chunks.items([t.lower() for t in texts])
        pairs = np.unique(row_of(n) * len(self.words) + items) if len(items) else np.zeros(0, np.int64)
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def probability(self, texts: list[str]) -> np.ndarray:
        row, word = self.lexicon.presence(texts)
        z = np.bincount(row, self.weights[word], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(toxic: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, epochs: int = 40, seed: int = 11) -> tuple[np.ndarray, float]:
    """Linear weights and bias of least non-negative risk under the sigmoid loss; rows are arrays of feature numbers."""
    draw = np.random.default_rng(seed)
    values = [np.zeros(size), np.array([-1.0])]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0

    def slope(rows, weight):
        """Gradient of sum(weight(z)) over rows, where weight gives d loss / d z."""
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        word = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        z = np.bincount(row_of(n), values[0][word], len(rows)) + values[1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = weight(s) / max(1, len(rows))
        return s, [np.bincount(word, np.repeat(d, n), size), np.array([d.sum()])]

    batches = max(1, -(-len(unlabelled) // 512))
    epochs = max(epochs, 2000 // batches)  # few rows take more rounds
    for epoch in range(epochs):
        p, u = draw.permutation(len(toxic)), draw.permutation(len(unlabelled))
        for k in range(batches):
            own_p = [toxic[i] for i in p[k::batches]] or [toxic[p[k % len(p)]]]
            own_u = [unlabelled[i] for i in u[k::batches]]
            sp, up = slope(own_p, lambda s: -s * (1 - s))  # loss 1 - s: toxic taken for clean
            su, uu = slope(own_u, lambda s: s * (1 - s))  # loss s: clean taken for toxic
            clean = su.mean() - prior * sp.mean() if len(su) else 0.0
            negative = [a + prior * b for a, b in zip(uu, up)]
            g = [prior * a + b for a, b in zip(up, negative)] if clean >= 0 else [-b for b in negative]
            g = [g[0] + 1e-5 * values[0], g[1]]
            step += 1
            rate = 0.1 * (1 - epoch / epochs) + 1e-3
            for v, x, a, b in zip(values, g, first, second):
                a += 0.1 * (x - a)
                b += 0.001 * (x * x - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return values[0], float(values[1][0])


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: Column | None = None) -> Model:
    """Model from the rows that `train` (on labels) and `train_docs` (on docs; default the same column) allow.

    Confirmed toxic texts count once each, however often they are copied. Word shares are counted over all
    texts. Without a toxic row all scores are near 0. Null texts are empty ones.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = labels.where(train & F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double")).alias("p")).first()
    prior = min(0.9, max(1e-3, known["p"] or 0.0))
    sample = bounded(labels.where(F.col(label_col) == 1), id_col, label_col, train, MAX_TOXIC)
    toxic = texts.join(F.broadcast(sample.select("id")), "id").select("text").dropDuplicates()  # bounded by MAX_TOXIC

    def words(batches):
        remember_only(None)
        for texts in (s for b in batches for s in sections(b.column(0))):
            found = [w for t in texts for w in set(_features(t.lower()))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    n_toxic = toxic.count()
    counted = toxic.mapInArrow(words, "word string").groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")
    candidates = [(r["word"], r["n"]) for r in counted.orderBy(F.col("n").desc(), "word").limit(MAX_WORDS).collect()]
    if not candidates:
        return Model(Lexicon([]), np.zeros(0), -5.0)
    sent = spark.sparkContext.broadcast(Lexicon([w for w, _ in candidates]))

    def shares(batches):
        remember_only(None)
        n, found = 0, np.zeros(len(sent.value.words), np.int64)
        for texts in (s for b in batches for s in sections(b.column(0))):
            n += len(texts)
            found += np.bincount(sent.value.presence(texts)[1], minlength=len(found))
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"word": np.append(used, -1), "n": np.append(found[used], n)})

    rows = texts.select("text").mapInArrow(shares, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # MAX_WORDS + 1 at most
    total = dict(map(tuple, rows))
    n_all = total.pop(-1)
    in_all = np.array([total.get(i, 0) for i in range(len(candidates))]) / n_all
    in_toxic = np.array([n for _, n in candidates]) / n_toxic
    clear = (in_toxic - in_all) / np.sqrt(np.maximum(in_all * (1 - in_all), 1e-9) / n_toxic)
    chosen = [i for i in np.argsort(-clear, kind="stable")[:MAX_FEATURES] if clear[i] > 4 and in_toxic[i] > 2 * in_all[i]]
    lexicon = Lexicon([candidates[i][0] for i in chosen])
    if not chosen:
        return Model(lexicon, np.zeros(0), -5.0)

    sent = spark.sparkContext.broadcast(lexicon)
    train_docs = train if train_docs is None else train_docs

    def features(batches):
        remember_only(None)
        for marks, texts in ((b.column(1).slice(i, 512), t) for b in batches for i, t in zip(range(0, b.num_rows, 512), sections(b.column(0), 512))):
            row, word = sent.value.presence(texts)
            n = np.bincount(row, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([marks, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(word.astype(np.int32)))], ["mark", "x"])

    # The sample is cut after the words are found, so that no texts are sorted or sent.
    unlabelled = docs.where(train_docs).select(F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(F.col(id_col)).alias("order"))
    x_toxic = [np.array(r["x"], np.int64) for r in toxic.withColumn("one", F.lit(1)).mapInArrow(features, "mark int, x array<int>").collect()]
    hashed = unlabelled.mapInArrow(features, "mark long, x array<int>").orderBy("mark").limit(MAX_UNLABELLED).collect()
    x_free = [np.array(r["x"], np.int64) for r in hashed]
    order = lambda rows: sorted(rows, key=lambda r: r.tobytes())  # noqa: E731  the same model whatever order rows come in
    weights, bias = fit_nnpu(order(x_toxic), order(x_free), len(chosen), prior)
    return Model(lexicon, weights, bias)


def score(spark, model: Model, text: Column) -> Column:
    """Score of a text from 0 to 1, toxic from 0.5 on; a null text is scored as an empty one."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        remember_only(None)
        out = [sent.value.probability(s) for s in sections(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return probability(text)
