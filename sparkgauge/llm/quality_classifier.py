"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every token has a sparse random index vector, a function of its hash. A token's word vector is the sum, over all its
occurrences in the whole corpus, of its neighbours' index vectors; token kinds share a fixed number of rows by hash, so
the table's size doesn't depend on the corpus. A document is pooled from its tokens' vectors (mean, spread, likeness of
neighbours, sameness of neighbours); a small network scores it, and a temperature makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

#: Rows of the vector table, its dimensions, non-zero entries of an index vector, and neighbours on either side.
ROWS, DIM, NONZERO, WINDOW = 1 << 13, 32, 2, 2
#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 11
SLICE = 1 << 19

#: Kinds of bytes: letters (and all beyond ASCII), digits, line ends, other signs; 0 is white space.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[0x30:0x3A] = 2
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
KIND[0x0A] = 4
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every token: runs of bytes of one kind, A-Z folded."""
    folded = FOLD[data]
    starts, ends, doc = textvec.runs(folded, offsets, KIND)
    return textvec.hashes(folded, starts, ends), doc


def _row(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(ROWS - 1)).astype(np.int64)


def _index(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the k-th non-zero entry of each token's index vector."""
    part = (h >> np.uint64(16 + 11 * k)) & np.uint64(0x7FF)
    return (part % np.uint64(DIM)).astype(np.int64), 1 - 2 * (part >> np.uint64(10)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROWS * DIM, np.int64)
    for batch in batches:
        for _, _, data, offsets in textvec.slices(batch.column(0), SLICE):
            h, doc = tokens(data, offsets)
            row = _row(h) * DIM
            for step in range(1, WINDOW + 1):
                near = doc[step:] == doc[:-step]
                left, right = row[:-step][near], row[step:][near]
                for k in range(NONZERO):
                    dim, sign = _index(h, k)
                    for at, ctx in ((left, slice(step, None)), (right, slice(None, -step))):
                        d, s = dim[ctx][near], sign[ctx][near]
                        total += np.bincount((at + d)[s > 0], minlength=len(total)) - np.bincount((at + d)[s < 0], minlength=len(total))
    table = total.reshape(ROWS, DIM)
    used = np.flatnonzero(table.any(1))
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIM), pa.array(table[used].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], ["row", "v"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The (ROWS, DIM) table of unit word vectors over all texts of ``docs``; the driver gets at most ROWS rows."""
    parts = docs.select(F.col(text)).mapInArrow(common.lean(_contexts), "row int, v array<long>")
    sums = parts.groupBy("row").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(DIM))).alias("v")).collect()
    table = np.zeros((ROWS, DIM))
    for r in sums:
        table[r["row"]] = r["v"]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 6


def pooled(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES): pooled vectors; all zero for a document without tokens."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, FEATURES), np.float32)
    h, doc = tokens(data, offsets)
    if not len(h):
        return out
    row = _row(h)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    there, n = doc[first], np.diff(np.append(first, len(h)))
    vectors = table[row]
    mean = np.add.reduceat(vectors, first) / n[:, None]
    spread = np.sqrt(np.maximum(np.add.reduceat(vectors * vectors, first) / n[:, None] - mean * mean, 0))
    like = np.zeros(len(h), np.float32)
    like[1:] = np.einsum("ij,ij->i", vectors[1:], vectors[:-1])
    like[first] = 0
    again = np.zeros((len(h), 2), np.float32)  # the same token as one or two before
    again[1:, 0], again[2:, 1] = h[1:] == h[:-1], h[2:] == h[:-2]
    kinds = np.unique(doc * np.int64(ROWS) + row) // ROWS
    out[there] = np.concatenate(
        [mean, spread, np.add.reduceat(again, first) / n[:, None], (np.add.reduceat(like, first) / n)[:, None], np.log1p(n)[:, None], (np.bincount(kinds, minlength=n_docs)[there] / n)[:, None], np.linalg.norm(mean, axis=1)[:, None]], axis=1
    )
    return out


def _mapped(model, make, name: str, kind: pa.DataType):
    """``make(model, data, offsets)`` for the column ``_text``, which its result replaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value
        for batch in batches:
            at = batch.schema.names.index("_text")
            others = [i for i in range(batch.num_columns) if i != at]
            for a, b, data, offsets in textvec.slices(batch.column(at), SLICE):
                got = make(value, data, offsets)
                column = pa.array(got, kind) if got.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in others), column], names=[*(batch.schema.names[i] for i in others), name])

    return run


@dataclass
class Model:
    """Word vectors, input scaling, the network's weights and the temperature. Its size is fixed by the parameters."""

    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """The network by Adam on four fifths of the rows, its temperature by likelihood on the rest.

    Without rows, or with one label only, the scores are one constant: that label's share, smoothed.
    """
    random = np.random.default_rng(SEED)
    w = [random.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(table, np.zeros(FEATURES), np.ones(FEATURES), [w[0] * 0, w[1], w[2] * 0, np.array([np.log(share / (1 - share))])])
    model = Model(table, x.mean(0), x.std(0) + 1e-3, w)
    order = random.permutation(len(y))
    check, learn = order[: len(y) // 5], order[len(y) // 5 :]
    z, t = (x[learn] - model.centre) / model.scale, y[learn].astype(float)
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(max(EPOCHS, 1500 * 64 // len(learn))):
        for part in np.array_split(random.permutation(len(learn)), max(1, len(learn) // 64)):
            hidden = np.tanh(z[part] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - t[part, None]) / len(part)
            back = error @ w[2].T * (1 - hidden**2)
            step += 1
            for i, g in enumerate([z[part].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logits, target = model.logits(x[check]), y[check]
    loss = lambda k: np.mean(np.logaddexp(0, -np.where(target == 1, 1, -1) * logits / k)) if len(check) else 0
    model.temperature = min(np.geomspace(0.125, 8, 49), key=loss)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """Word vectors over all of ``docs``; the network on at most ``rows`` labelled documents outside the held-out share.

    Of rows that share a doc_id one text, the smallest, is learned from.
    """
    spark = docs.sparkSession
    table = word_vectors(docs, text)
    sample = common.labelled_ids(labels, label, modulus, held_out, rows)
    chosen = common.sample_texts(docs, sample, text).select("label", "_text")
    features = chosen.mapInArrow(common.lean(_mapped(spark.sparkContext.broadcast(table), pooled, "x", pa.list_(pa.float32()))), "label int, x array<float>").toArrow()
    y = features.column("label").to_numpy()
    x = features.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES).astype(np.float64) if len(y) else np.zeros((0, FEATURES))
    order = np.lexsort((*x.T[:3], y))  # rows arrive in any order; the fit shouldn't depend on it
    return fit(table, x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of each row of ``docs``; null and empty texts get the score of a text without tokens."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(common.lean(_mapped(shared, lambda m, data, offsets: m.scores(pooled(m.table, data, offsets).astype(np.float64)), "score", pa.float64())), common.schema(rows, "_text", "score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score and predicted (1 where the score is at least ``threshold``) of every row of ``docs``.

    Labels are only read for training. Null texts and null labels are allowed; repeated rows come back as often as they
    are there; without any labels all scores are one half. Only ``doc_id``, ``keep`` and the text are read of ``docs``.
    """
    return score(docs, train(docs, labels), keep=keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all its columns) whose score is at least ``threshold``."""
    # the row travels as one struct, so its columns' names don't matter
    rows = docs.select(common.whole(docs).alias("row"), F.col(text).alias("text"))
    return score(rows, train(docs, labels, text=text), "text", ("row",)).where(F.col("score") >= threshold).select("row.*")
