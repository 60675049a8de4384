"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Features are hashes of words, of word shapes (runs of capitals, small letters, digits; other
characters as they are), of their bigrams, and of a word that repeats the one before. A text
is the L2-normalised vector of 1 + log counts. Training takes follow-the-regularised-leader
steps (McMahan et al., 2013) over a bounded sample of labelled rows in hash order; the L1 term
keeps most weights at zero. Scoring is a sparse dot product a text, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from stratasift.llm.common import mix64

#: Weights are 2**BITS; the fit takes at most SAMPLE labelled rows, EPOCHS times.
BITS, SAMPLE, EPOCHS = 18, 8192, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
#: Score from which a text counts as good.
THRESHOLD = 0.7

_RUNS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))


def _shape(word: bytes) -> bytes:
    marks = word.translate(_RUNS)
    return bytes(b for i, b in enumerate(marks) if i == 0 or b != marks[i - 1])


class Features:
    """Text to (indices, values); remembers a fixed number of words."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.limit = limit

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        pairs = []
        for w in words:
            if (p := known.get(w)) is None:
                p = known[w] = (xxh3_64_intdigest(w.lower()), xxh3_64_intdigest(b"\x00" + _shape(w)))
            pairs.append(p)
        both = np.array(pairs, dtype=np.uint64)
        w, s = both[:, 0], both[:, 1]
        with np.errstate(over="ignore"):
            pair_w = w[:-1] * np.uint64(3) + w[1:]
            pair_s = s[:-1] * np.uint64(3) + s[1:]
        again = np.full(int((w[:-1] == w[1:]).sum()), 12345, dtype=np.uint64)
        hashed = mix64(np.concatenate([w, s, pair_w, pair_s, again])) >> np.uint64(64 - BITS)
        index, count = np.unique(hashed.astype(np.int64), return_counts=True)
        value = 1 + np.log(count)
        return index, value / np.sqrt((value * value).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, the bias last, from (indices, values, label) rows in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for index, value, label in rows:
            i, x = np.append(index, 1 << BITS), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most `sample` rows of docs that labels (doc_id, label) names: those first by a hash of doc_id.

    Each task keeps its first rows; one task gets `sample` rows of features and no more,
    whatever the number of documents and however often a doc_id comes.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    texts = texts.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("d"), F.col("label").cast("int").alias("label"), "text")
    texts = texts.orderBy("h", "d", F.xxhash64("text")).limit(sample)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, rows = Features(), []
        for batch in batches:
            for h, d, y, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                index, value = make(text)
                rows.append(((h, d, xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))), index.astype(np.int32), value, y))
        rows.sort(key=lambda r: r[0])
        w = fit([(i, v, y) for _, i, v, y in rows])
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["i", "w"])

    w = np.zeros((1 << BITS) + 1)
    for r in texts.repartition(1).mapInArrow(fitted, "i long, w double").collect():  # 2**BITS + 1 weights at most
        w[r.i] = r.w
    return w


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row: doc_id, score (0 to 1), predicted. Null and empty texts get the bias's score.

    Repeated rows and null ids are scored like others; other columns are ignored; an empty
    table gives none.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = Features(), shared.value
        for batch in batches:
            logits = np.array([w[-1] + w[i] @ v for i, v in map(make, batch.column(1).to_pylist())])
            score = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array(score >= THRESHOLD).cast(pa.int32())], names=schema.names)

    return source.mapInArrow(run, schema)
