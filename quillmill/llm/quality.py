"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a fitted temperature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKEN_KINDS, Words, by_bytes, held_out, labelled, table, text_bytes, with_rows

BUCKETS, DIM, REACH = 8192, 32, 2
WIDTH = 2 * DIM + 4
_R = np.random.default_rng(7)
_PLACE = _R.integers(0, DIM, (BUCKETS, 2))
_SIGN = _R.choice(np.array([-1.0, 1.0]), (BUCKETS, 2))


def _tokens(column: pa.Array) -> tuple[Words, np.ndarray]:
    w = Words(*text_bytes(column), kinds=TOKEN_KINDS, fold=False)
    return w, (w.hashes >> np.uint64(51)).astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of hashed words over all documents: the summed ternary index vectors of the REACH words on
    either side. Tasks emit their sums by bucket and Spark adds them up; BUCKETS rows of DIM numbers come to the driver."""

    def sums(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w, b = _tokens(part.column("text"))
                for step in range(1, REACH + 1):
                    same = w.row[step:] == w.row[:-step]
                    left, right = b[:-step][same], b[step:][same]
                    for word, near in ((left, right), (right, left)):
                        for k in range(2):
                            total += np.bincount(word * DIM + _PLACE[near, k], _SIGN[near, k], BUCKETS * DIM)
        rows = total.reshape(BUCKETS, DIM).astype(np.int64)
        used = np.flatnonzero(rows.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(rows[used, d]) for d in range(DIM)], names=["bucket"] + [f"d{d}" for d in range(DIM)])

    src = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = src.mapInArrow(sums, "bucket bigint, " + ", ".join(f"d{d} bigint" for d in range(DIM)))
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in parts.groupBy("bucket").agg(*[F.sum(f"d{d}") for d in range(DIM)]).collect():
        out[r[0]] = r[1:]
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-6)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its word vectors, the norm of the mean, how alike neighbouring words' vectors are, and
    the log of its length; zeros for a text without tokens."""
    w, b = _tokens(column)
    out = np.zeros((len(column), WIDTH), np.float32)
    full = np.flatnonzero(w.n)
    if len(full):
        v = vectors[b]
        n = w.n[full, None].astype(np.float32)
        mean = np.add.reduceat(v, w.first[full]) / n
        square = np.add.reduceat(v * v, w.first[full]) / n
        near = np.zeros(len(b), np.float32)
        near[1:] = (v[1:] * v[:-1]).sum(1) * (w.row[1:] == w.row[:-1])
        alike = np.add.reduceat(np.column_stack([near, near > 0.99]), w.first[full]) / n
        out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.linalg.norm(mean, axis=1, keepdims=True), alike, np.log1p(n) / 10])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.shift) / self.scale @ a + b) @ c + d

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(column, self.vectors)) / self.temperature, -30, 30))).astype(np.float64)


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(3)
    shift, scale = x.mean(0), x.std(0) + 1e-3
    z = ((x - shift) / scale).astype(np.float32)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 256):
            i = order[lo : lo + 256]
            h = np.tanh(z[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], e.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return shift, scale, p


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, between 1/4 and 8."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(spark: SparkSession, sf_dir: str, docs: DataFrame, most: int = 12_000, hidden: int = 16, epochs: int = 25) -> Model:
    """Word vectors from all of docs; the network from at most `most` labelled documents of the documents table, a fifth of
    which is kept to fit the temperature. Without labelled rows every score is one half."""
    vectors = context_vectors(docs)
    rows = F.broadcast(labelled(spark, sf_dir, "quality", most))  # at most `most` rows
    cast = spark.sparkContext.broadcast(vectors)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(rows, "doc_id").select("doc_id", "y", "text")
    got = with_rows(texts, lambda c: [pa.array(list(pooled(c, cast.value).astype(np.float64)), pa.list_(pa.float64()))], [("x", "array<double>")])
    found = sorted(got.select("doc_id", "y", "x").toLocalIterator(), key=lambda r: (r[0], r[1]))
    if not found:
        zero = [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), np.array(0.0)]
        return Model(vectors, np.zeros(WIDTH), np.ones(WIDTH), zero, 1.0)
    x, y = np.array([r[2] for r in found], np.float32), np.array([r[1] for r in found])
    kept = np.arange(len(y)) % 5 == 4 if len(y) >= 25 else np.ones(len(y), bool)
    learn = ~kept if len(y) >= 25 else kept
    model = Model(vectors, *_train(x[learn], y[learn], hidden, epochs), 1.0)
    model.temperature = _temperature(model.logits(x[kept]), y[kept])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, calibrated) and predicted (1 from threshold on).

    Null and empty texts have pooled zeros and so a score too. Rows are judged one by one, repeated ones alike; extra
    columns pass through, those named as an output are replaced; an empty table gives no rows.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the corpus

    def fn(column: pa.Array) -> list:
        s = np.round(cast.value.scores(column), 9)  # sums over other neighbours differ in their last digits
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return with_rows(docs, fn, [("score", "double"), ("predicted", "int")])


def classify(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    return score(docs, fit(spark, sf_dir, docs)).withColumn("held_out", held_out(F.col("doc_id")))
