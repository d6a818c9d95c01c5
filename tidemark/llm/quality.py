"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, under a softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACE, crc_rest, parts, texts_of, utf8, word_hashes, words
from tidemark.llm.sample import bounded, within

#: Vectors of words, of 3- and of 4-byte n-grams, each in a table of 2^BITS rows of DIM numbers; the last row: a repeated word.
BITS, DIM = 15, 8
ROWS = 3 * (1 << BITS) + 1
PART_BYTES = 1 << 20


@dataclass
class Model:
    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def features(batch: pa.RecordBatch):
    """Groups of (row of the vector table, row of the batch) for all features of all texts: words, n-grams, repeats.

    n-grams lie inside a word, with the space before or after it; letters are lower-cased (A-Z)."""
    offsets, data = utf8(batch.column("text"))
    data = LOWER[data]
    starts, ends, row = words(offsets, data)
    hashes = word_hashes(data, starts, ends)
    yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), row
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) + 1
    yield np.full(len(again), ROWS - 1), row[again]
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 2, 32, np.uint8)  # a space before each text and after the last
    lengths = np.diff(offsets)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = data
    of = np.repeat(np.arange(n), lengths + 1)
    x = padded.astype(np.uint32)
    inner = ~SPACE[padded]
    three = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    ok = np.flatnonzero(inner[1:-1][: len(of)])
    yield ((three[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS), of[ok]
    four = three[:-1] | (x[3:] << np.uint32(24))
    ok = np.flatnonzero((inner[1:-2] & inner[2:-1])[: len(of)])
    yield ((four[ok] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS), of[ok]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.5, seed: int = 3) -> Model:
    """rows: distinct features, their shares of the text, label 0 or 1. Stochastic gradient descent with Adagrad steps."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    out = rng.standard_normal((DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(w.shape, 1e-6, np.float32) for w in (vectors, out, bias)]
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            at, share, y = rows[k]
            own = vectors[at]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = share[:, None] * (out @ p)
            for w, s, g, part in ((out, seen[1], np.outer(mean, p), ...), (bias, seen[2], p, ...), (vectors, seen[0], back, at)):
                s[part] += g * g
                w[part] -= now * g / np.sqrt(s[part])
    return Model(vectors, out, bias)


def learned(docs: DataFrame, labels: DataFrame, label: str, fold: int, out_rest: int, bound: int = 2000, most_bytes: int = 32 << 20) -> Model | None:
    """A model from about bound labelled documents (for each label at most) of most_bytes bytes in all, none of them in the
    fold that is held out. Null ids and labels don't count, repeated rows do, and an id with two labels or texts counts for
    each; a null text has no features. None without any row."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~crc_rest(fold).isin(out_rest, -1))
    taken = texts_of(docs).join(F.broadcast(bounded(known, bound, "doc_id", by="label")), "doc_id")
    taken = within(taken, most_bytes, "doc_id")

    def count(batches):
        for batch in parts(batches, PART_BYTES):
            groups = list(features(batch))
            key = np.concatenate([row * ROWS + at for at, row in groups])
            key, n = np.unique(key, return_counts=True)
            row, at = np.divmod(key, ROWS)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            cells = [(at[a:b].astype(np.int32), n[a:b] / max(1, n[a:b].sum())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([c[0].tobytes() for c in cells], pa.binary()), pa.array([c[1].astype(np.float32).tobytes() for c in cells], pa.binary())], ["doc_id", "label", "at", "share"])

    rows = taken.mapInArrow(count, "doc_id long, label int, at binary, share binary").sort("doc_id", "at").toArrow().to_pylist()
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32), r["label"]) for r in rows]
    return train(data) if data else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) of every row of docs.

    The softmax of an average is that of averaged differences, so that each feature adds one number of a table. A text
    without features (null, empty) has the score of the bias alone; without a model all scores are 0.5. One row out per
    row in; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    gain = (model.vectors @ (model.out[:, 1] - model.out[:, 0])).astype(np.float32) if model else np.zeros(ROWS, np.float32)
    bias = float(model.bias[1] - model.bias[0]) if model else 0.0

    def rows(batches):
        for batch in parts(batches, PART_BYTES):
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, row in features(batch):
                total += np.bincount(row, weights=gain[at], minlength=batch.num_rows)
                n += np.bincount(row, minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts_of(docs).mapInArrow(rows, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, fold: int = 3, out_rest: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row: scored() by a model learned() from labels.quality of other folds."""
    found = scored(docs, learned(docs, labels, "quality", fold, out_rest))
    return found.select("doc_id", (crc_rest(fold) == out_rest).alias("held_out"), "score", "predicted")
