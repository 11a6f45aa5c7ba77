"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of ASCII letters and digits and of characters of
other scripts.  A text's features are the *presence* of hashed words, word
pairs, word triples and skip-grams (pairs with one or two words between); presence keeps very long
texts from drowning their few telling words.  Training walks a bounded sample of labelled
rows in one task with per-coordinate learning rates and L1 sparsity; the result
is a few thousand (index, weight) pairs, at most ``2**bits``, which is the
proven bound of what is broadcast.  Scoring is one narrow pass without shuffle.

Nulls and empties: a null text counts as empty and scores the bias alone; a null
label is no label; repeated label rows of a document count once (the largest
label holds).  A row without doc_id is scored and doesn't train; rows that repeat a doc_id are scored each and
train once.  A very long text is scored whole, and trains if the bytes bound leaves room.  Without training rows every score is
0.5; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

BITS = 22
#: Labelled rows that training uses at most, those of the smallest hashes of doc_id.
MAX_TRAIN_ROWS = 24_000
#: Bytes of text that training reads at most: rows in that order while their sum is within.
MAX_TRAIN_BYTES = 128 << 20
THRESHOLD = 0.3


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature index) of all n-grams and skip-grams of a window, with repeats."""
    _, _, h, doc = K.word_spans(raw, offsets, K.ALNUM)
    n, shift = len(h), np.uint64(64 - bits)
    docs, idx = [doc], [h >> shift]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            idx.append(K.mix64(h[:-gap] * np.uint64(salt) + h[gap:])[same] >> shift)
    if n > 2:
        same = doc[2:] == doc[:-2]
        docs.append(doc[2:][same])
        idx.append(K.mix64((h[:-2] * np.uint64(0x27D4EB2F165667C5) + h[1:-1]) * np.uint64(0x85EBCA77C2B2AE63) + h[2:])[same] >> shift)
    return np.concatenate(docs), np.concatenate(idx).astype(np.int64)


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) for presence features; coordinate ``2**bits`` is the bias, free of penalties."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.size, self.alpha, self.beta, self.l1, self.l2 = 1 << bits, alpha, beta, l1, l2
        self.z = np.zeros(self.size + 1, np.float32)
        self.n = np.zeros(self.size + 1, np.float32)

    def weights_at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == self.size, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= l1] = 0.0
        return w

    def learn(self, i: np.ndarray, label: float) -> None:
        """One step on a text whose distinct features are i (with the bias last)."""
        w = self.weights_at(i)
        g = np.float32(sigmoid(float(w.sum())) - label)
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        live = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        bias = self.weights_at(np.array([self.size]))[0]
        return live.astype(np.int32), self.weights_at(live).astype(np.float32), float(bias)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def _trainer(bits: int, epochs: int, params: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ends, labels, order = [], [np.zeros(1, np.int64)], [], []
        for batch in batches:
            raw, off = K.text_buffers(batch.column("text"))
            labels += batch.column("label").to_pylist()
            order += batch.column("rank").to_pylist()
            for i, j in K.windows(off):
                o = off[i : j + 1] - off[i]
                doc, idx = features(raw[off[i] : off[j]], o, bits)
                key = np.unique(doc << bits | idx)
                cut = np.searchsorted(key, np.arange(j - i + 1) << bits)
                parts.append((key & ((1 << bits) - 1)).astype(np.int32))
                ends.append(cut[1:] + ends[-1][-1])
        model = Ftrl(bits, **params)
        turn = sorted(range(len(labels)), key=order.__getitem__)
        features_, bounds = np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate(ends)
        del parts, ends
        for _ in range(epochs):
            for k in turn:
                model.learn(np.append(features_[bounds[k] : bounds[k + 1]], model.size), labels[k])
        i, w, bias = model.sparse()
        yield pa.RecordBatch.from_pydict({"idx": pa.array([i.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_TRAIN_ROWS, epochs: int = 3, max_bytes: int = MAX_TRAIN_BYTES, **params) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from the rows of ``docs`` (doc_id, text) that have a 0/1 ``label`` in ``labels`` (doc_id, label).

    The sample is the ``max_rows`` documents of the smallest hashes of doc_id, as far as their texts are
    within ``max_bytes``; the bounds are the parameters.  Of rows that repeat a doc_id the least text counts.  One task learns
    from them in that order.
    """
    marked = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"))
    ranked = sizes.join(marked, "doc_id").withColumn("rank", F.xxhash64("doc_id"))
    low = F.pmod(F.shiftright("rank", 20), F.lit(1 << 30))
    share = min(1.0, 1.1 * max_rows / max(1, ranked.count()))  # the limit then gathers a little more than it keeps
    chosen = ranked.where(low < int(share * (1 << 30))).orderBy(low, "rank", "doc_id").limit(max_rows)
    running = F.sum("bytes").over(W.orderBy(low, "rank", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))  # over max_rows rows at most
    chosen = chosen.withColumn("sum", running).where(F.col("sum") <= max_bytes).select("doc_id", "label", "rank")
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    picked = picked.select("text", "label", "rank").repartition(1)  # of bounded rows and bytes
    got = picked.mapInArrow(K.tidy(_trainer(bits, epochs, params)), "idx binary, w binary, bias double").collect()
    if not got:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    row = got[0]
    return np.frombuffer(row.idx, np.int32), np.frombuffer(row.w, np.float32), row.bias


_tables: dict[int, tuple[object, np.ndarray, np.ndarray]] = {}


def _table(value, bits: int) -> np.ndarray:
    """The sparse weights as a dense table, one per worker."""
    i, w, _ = value
    key = hash((i.tobytes(), w.tobytes()))
    if key not in _tables:
        _tables.clear()
        dense = np.zeros(1 << bits, np.float32)
        dense[i] = w
        _tables[key] = dense
    return _tables[key]


def score_texts(raw: np.ndarray, offsets: np.ndarray, dense: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    out = np.full(len(offsets) - 1, bias)
    for i, j in K.windows(offsets):
        o = offsets[i : j + 1] - offsets[i]
        doc, idx = features(raw[offsets[i] : offsets[j]], o, bits)
        live = np.flatnonzero(dense[idx])
        if len(live):
            key = np.unique(doc[live] << bits | idx[live])
            out[i:j] += np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=j - i)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1; takes the place of a column of that name), in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = _table(sent.value, bits), sent.value[2]
        for batch in batches:
            raw, off = K.text_buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(raw, off, dense, bias, bits))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(K.tidy(run), schema)


def held_out(column="doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns from rows that aren't held out."""
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    weights = train(docs.where(~held_out()), known)
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
