"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words.  Each passage is described by numbers that need no
language (share of capitals, digits, marks, repeated and distinct words, word lengths, hashed endings);
a learned layer encodes it, gated attention (tanh and sigmoid branches) weighs the passages of a
document, and the weighted sum is scored by a logistic unit.  Encoder, attention and scorer are learned
together from document labels by Adam, on a bounded sample of labelled rows.

Results for special cases: null or empty text is one passage without words; without labelled rows, or
with labels of one kind only, the score is the label rate (0.5 without labels); rows of labels with the
same doc_id count as one with the largest label; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restora.llm.textkit import Words, field, pieces, string_bytes

PASSAGE, HASHED, HIDDEN, ATTENTION = 64, 16, 32, 16
SHAPES = 14
WIDTH = SHAPES + HASHED

_CLASS = np.zeros((5, 256), dtype=bool)
_CLASS[0, 65:91] = True
_CLASS[1, 97:123] = True
_CLASS[2, 48:58] = True
_CLASS[3, 128:] = True
_CLASS[4, [c for c in range(33, 127) if not chr(c).isalnum()]] = True


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, row of every passage); each row has one at least."""
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    words = Words(data, offsets)
    count = np.bincount(words.doc, minlength=n) if len(words.doc) else np.zeros(n, np.int64)
    parts = np.maximum(-(-count // PASSAGE), 1)
    first = np.cumsum(parts) - parts
    row = np.repeat(np.arange(n), parts)
    out = np.zeros((len(row), WIDTH))
    if not len(words.doc):
        out[:, SHAPES - 1] = 1
        return out, row
    begin_word = np.cumsum(count) - count
    own = first[words.doc] + (np.arange(len(words.doc)) - begin_word[words.doc]) // PASSAGE
    new = np.r_[True, own[1:] != own[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(own)] - 1
    which = own[at]
    size = (last - at + 1).astype(float)
    start, end = words.start[at], words.end[last]
    letters = np.maximum(end - start, 1).astype(float)
    for k in range(5):
        total = np.r_[0, np.cumsum(_CLASS[k][data])]
        out[which, k] = (total[end] - total[start]) / letters
    length = (words.end - words.start).astype(float)
    mean = np.add.reduceat(length, at) / size
    out[which, 5] = np.minimum(mean / 10, 5)
    out[which, 6] = np.minimum(np.sqrt(np.maximum(np.add.reduceat(length**2, at) / size - mean**2, 0)) / 5, 5)
    same = np.r_[False, (words.hash[1:] == words.hash[:-1]) & ~new[1:]]
    out[which, 7] = np.add.reduceat(same.astype(float), at) / size
    key = own.astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24)
    distinct = np.unique(key)
    out[:, 8] = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=len(row))
    out[which, 8] /= size
    tail = data[words.end - 1]
    for k, c in ((9, _CLASS[4]), (10, _CLASS[2])):
        out[which, k] = np.add.reduceat(c[tail].astype(float), at) / size
    out[which, 11] = np.add.reduceat((length == 1).astype(float), at) / size
    out[which, 12] = np.log1p(size) / 5
    bins = (tail.astype(np.int64) * 7 + (length.astype(np.int64) % 5) * 3) % HASHED
    hashed = np.bincount(own * HASHED + bins, minlength=len(row) * HASHED).reshape(-1, HASHED)
    out[:, SHAPES:] = hashed
    out[which, SHAPES:] /= size[:, None]
    out[count[row] == 0, SHAPES - 1] = 1
    return out, row


class AttentionModel:
    """Encoder, gated attention and scorer; all arrays are small and fixed in size."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = np.zeros(WIDTH), np.ones(WIDTH), None
        self.p = {
            "E": draw.normal(size=(WIDTH, HIDDEN)) / np.sqrt(WIDTH), "e": np.zeros(HIDDEN),
            "V": draw.normal(size=(HIDDEN, ATTENTION)) / np.sqrt(HIDDEN), "U": draw.normal(size=(HIDDEN, ATTENTION)) / np.sqrt(HIDDEN),
            "w": draw.normal(size=ATTENTION) / np.sqrt(ATTENTION), "c": draw.normal(size=HIDDEN) / np.sqrt(HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, row: np.ndarray):
        """Scores of bags; row is ascending and has no gaps."""
        p = self.p
        h = np.maximum((x - self.mean) / self.scale @ p["E"] + p["e"], 0)
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        a = np.exp(a - np.maximum.reduceat(a, at)[row])
        a /= np.add.reduceat(a, at)[row]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -40, 40)))
        return s, (h, v, u, a, z)

    def score(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(int(row.max(initial=-1)) + 1, self.constant)
        return self.forward(x, row)[0]

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean log loss of bags with labels y."""
        s, (h, v, u, a, z) = self.forward(x, row)
        p = self.p
        ds = (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (h * dz[row]).sum(axis=1)
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        dl = a * (da - np.add.reduceat(a * da, at)[row])
        dv, du = dl[:, None] * p["w"] * u * (1 - v * v), dl[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz[row] + dv @ p["V"].T + du @ p["U"].T) * (h > 0)
        return {"E": ((x - self.mean) / self.scale).T @ dh, "e": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ dl, "c": z.T @ ds, "b": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 6) -> AttentionModel:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), np.maximum(every.std(axis=0), 0.02)
        draw, m1, m2, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                x = np.concatenate([bags[i] for i in pick])
                row = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
                p, step = self.p, step + 1
                grad = self.gradient(x, row, y[pick])
                for n, g in grad.items():
                    g = g + decay * p[n]
                    m1[n] = 0.9 * m1.get(n, 0) + 0.1 * g
                    m2[n] = 0.999 * m2.get(n, 0) + 0.001 * g * g
                    p[n] -= rate * m1[n] / (1 - 0.9**step) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, sample: int = 3000, epochs: int = 25) -> AttentionModel:
    """A model of labels (doc_id, label).

    `sample` bounds the labelled rows used: those with the smallest hashes of doc_id, with all their passages.
    """
    marked = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("marked_id"), F.col("label").cast("double").alias("label"))
    own = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("marked_id")).select("text", "label")  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, row = passages(field(batch, "text"))
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, y in enumerate(field(batch, "label").to_pylist()):
                bag = x[edge[i] : edge[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([y]), pa.array([bag.astype("<f4").tobytes()], pa.binary())], names=["label", "bag"])

    rows = own.mapInArrow(run, "label double, bag binary").collect()  # passages of at most `sample` documents
    rows.sort(key=lambda r: (r.label, bytes(r.bag)))  # the same model however rows arrive
    bags = [np.frombuffer(bytes(r.bag), dtype="<f4").reshape(-1, WIDTH).astype(float) for r in rows]
    return AttentionModel().fit(bags, np.array([r.label for r in rows]), epochs)


def scored(docs: DataFrame, model: AttentionModel, threshold: float = 0.3) -> DataFrame:
    """The columns of docs plus score and predicted (1 if score is at least threshold)."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = shared.value.score(*passages(field(batch, "text")))
            yield pa.RecordBatch.from_arrays([*(field(batch, n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels of documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~held_out)
    model = learn(docs, labels)
    return scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
