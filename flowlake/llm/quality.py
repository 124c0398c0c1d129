"""7. Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters or of other marks, with case. A document's features are its distinct one- and two-word
n-grams hashed to 2^BITS places, each with weight 1 / sqrt(number of features); place 0 is the bias. Shards of a bounded
sample are trained side by side, each in a fixed order, and their weights averaged. Scoring is a sparse dot product.

Cases: null, empty and wordless texts have the bias alone; with no training rows every score is 0.5; repeated rows are
scored each; other columns are kept, score and predicted replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.hashing import words_of
from flowlake.llm.training import fold, labelled_sample

BITS = 18
#: At most about so many labelled documents are trained on, in shards of at least SHARD_ROWS.
TRAINING_ROWS = 8_000
SHARD_ROWS, SHARDS = 1_000, 4
EPOCHS = 5
ALPHA, BETA, L1, L2 = 10.0, 1.0, 0.0005, 0.01
THRESHOLD = 0.3


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Ascending places of each text's n-grams, the bias first."""
    words = words_of([(t or "").encode("utf-8", "replace") for t in texts], split_marks=True, lower=False)
    pairs = words.ngrams(2)
    places = np.uint64(2**BITS - 1)
    out = []
    for i in range(len(texts)):
        both = np.concatenate([words.of(i), pairs.of(i)]) % places + np.uint64(1)
        out.append(np.concatenate([[0], np.unique(both)]).astype(np.int64))
    return out


def values(places: np.ndarray) -> np.ndarray:
    x = np.full(len(places), 1.0 / np.sqrt(max(1, len(places) - 1)))
    x[0] = 1.0
    return x


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


class Ftrl:
    """FTRL-proximal: per-coordinate steps, weights kept as sums of gradients."""

    def __init__(self):
        self.z, self.n = np.zeros(2**BITS), np.zeros(2**BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w, x = self.weights(at), values(at)
        g = weight * (sigmoid(w @ x) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> np.ndarray:
    """Weights of all places (2^BITS numbers, whatever the input)."""
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, bound)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f.astype("<i4").tobytes() for f in features(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "places"])

    n = labels.where(F.col("quality").isNotNull()).count()
    shards = max(1, min(SHARDS, min(n, bound) // SHARD_ROWS))
    rows = sample.select("doc_id", "label", "text").mapInArrow(featurise, "doc_id long, label int, places binary")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(order=[hash((int(d) * 0x9E3779B97F4A7C15) % 2**61) for d in part["doc_id"]]).sort_values(["order", "doc_id", "label"])
        model = Ftrl()
        rows = [(np.frombuffer(p, dtype="<i4").astype(np.int64), int(y)) for p, y in zip(part["places"], part["label"])]
        ones = sum(label for _, label in rows)
        # the rarer label counts more, by the root of the ratio
        ratio = np.sqrt(np.clip(ones / max(1, len(rows) - ones), 1 / 16, 16))
        weight = (max(1.0, ratio), max(1.0, 1 / ratio))
        for _ in range(EPOCHS):
            for at, label in rows:
                model.learn(at, label, weight[label])
        w = model.weights(np.arange(2**BITS))
        used = np.flatnonzero(w)
        return pd.DataFrame({"place": used, "w": w[used]})

    fitted = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInPandas(fit, "place long, w double")
    merged = fitted.groupBy("place").agg((F.sum("w") / shards).alias("w")).toPandas()
    weights = np.zeros(2**BITS, dtype=np.float32)
    weights[merged["place"].to_numpy(dtype=np.int64)] = merged["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score and predicted."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                scores = [sigmoid(w[f] @ values(f)) for f in features(b.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
