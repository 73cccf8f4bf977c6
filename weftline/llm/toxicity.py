"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its distinct words, pairs of neighbours and pairs with one word between,
hashed to 2**BITS indices. Learning is online with a rate of its own for each coordinate; the L1
penalty leaves few weights that are not zero, and only those are sent to the tasks that score.

Learning takes at most sample_rows labelled documents, the ones with the smallest hashes of their ids;
the bound is a parameter and keeps the learning task's memory bounded. Scoring covers whole texts of
all documents. Null and empty texts have no features and get the score of the bias. Rows that share a
doc_id are scored each; where labels share a doc_id the largest counts; null labels and ids teach
nothing. Very long texts are features of any number of words. Without labelled documents of both
classes there is no model: score gives 0.5 to all, keep_clean keeps all. An empty table gives an empty
result. Columns other than doc_id and text are not read; keep_clean passes them on as they are,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch, materialise, prepare, slices

BITS = 20
#: Rate, its smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 0.1
PASSES = 5
_RANDOM = np.random.default_rng(77)
_BYTE = _RANDOM.integers(1, 2**64, 256, np.uint64)
_PLACE = _RANDOM.integers(1, 2**64, 64, np.uint64) | np.uint64(1)
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_LETTER = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For all texts, which text each occurrence of a feature is in, and the feature's index."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inside = _LETTER[data]
    first = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
    value = _BYTE[data] * _PLACE[at & 63]
    value[~inside] = 0
    words = _mix(np.add.reduceat(value, first) + (last - first).astype(np.uint64))
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), first, "right")
    out = [(text, words)]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        same = text[gap:] == text[:-gap]
        out.append((text[gap:][same], _mix(words[:-gap] * factor + words[gap:])[same]))
    return np.concatenate([t for t, _ in out]), (np.concatenate([h for _, h in out]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal; coordinate 2**BITS is the bias, which has no penalty."""

    def __init__(self):
        self.z, self.n = np.zeros((2, 2**BITS + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 2**BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights that are not zero."""
    rows: list[np.ndarray] = []
    for a, b in slices(texts):
        which, index = features(texts[a:b])
        both = np.unique(which << np.int64(BITS) | index)
        bounds = np.searchsorted(both >> np.int64(BITS), np.arange(b - a + 1))
        rows += [np.append(both[x:y] & np.int64(2**BITS - 1), 2**BITS) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    model, order = Ftrl(), np.random.default_rng(5)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            model.learn(rows[k], labels[k])
    at = np.arange(2**BITS + 1)
    weights = model.weights(at)
    at = np.flatnonzero(weights)
    return at, weights[at]


def probabilities(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Scores of texts, by all weights."""
    which, index = features(texts)
    heavy = np.flatnonzero(weights[index])
    both = np.unique(which[heavy] << np.int64(BITS) | index[heavy])
    total = np.bincount(both >> np.int64(BITS), weights[both & np.int64(2**BITS - 1)], len(texts)) + weights[2**BITS]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", sample_rows: int = 12_000) -> DataFrame:
    """The model as rows (index, weight), from the documents that labels names."""
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")  # at most sample_rows rows of two numbers
    schema = pa.schema([("index", pa.int64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for rows in batches for r in zip(*(rows.column(k).to_pylist() for k in (0, 1, 2)), strict=True)), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or ""))
        if len({r[2] > 0 for r in found}) == 2:
            at, weights = train([r[1] or "" for r in found], [int(r[2] > 0) for r in found])
            yield batch(schema, index=at, weight=weights)

    return rows.repartition(1).mapInArrow(run, "index long, weight double")


def score(docs: DataFrame, model: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for each document."""
    spark = docs.sparkSession
    prepare(spark)
    rows = model.collect()  # L1 leaves a few of at most 2**BITS + 1 weights
    sparse = spark.sparkContext.broadcast((np.array([r["index"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float32)))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2**BITS + 1, np.float32)
        weights[sparse.value[0]] = sparse.value[1]
        for rows in batches:
            keys, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for a, b in slices(texts):
                p = probabilities(texts[a:b], weights)
                yield batch(schema, doc_id=keys[a:b], score=p, predicted=(p >= threshold).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; all, if there is no model. No shuffle."""
    rows = model.collect()  # as in score
    if not rows:
        return docs
    sparse = docs.sparkSession.sparkContext.broadcast((np.array([r["index"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float32)))
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2**BITS + 1, np.float32)
        weights[sparse.value[0]] = sparse.value[1]
        for rows in batches:
            texts = rows.column(at).to_pylist()
            p = np.concatenate([probabilities(texts[a:b], weights) for a, b in slices(texts)] or [np.zeros(0)])
            yield rows.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    """Whether a document's label must not be learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """Learns from the labels that are not held out, and scores all documents: doc_id, held_out, score, predicted."""
    model = materialise(learn(docs, labels.filter(~held_out(F.col("doc_id"))), sample_rows=sample_rows))
    return score(docs, model, threshold).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
