"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, pairs of words, and n-grams of one to three word shapes (the pattern of
lower case, capitals, digits and marks, and whether a word repeats the one before). The indicators
are scaled by the log ratio of their smoothed counts in the two classes, and a linear hinge-loss
model is fitted to the scaled indicators by dual coordinate descent.

The model is fitted on a bounded sample of labelled documents (`sample`, the least hashes of their
ids); every document is then scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesets import GRAM_CODES, SOLID_BYTE, chunks, mix, span_hashes, spans
from .common import bounded, flat, kind_of, modest_batches, pick

#: Hashed features (a power of two), labelled documents to fit on, and the model's settings.
FEATURES, SAMPLE = 1 << 18, 6_000
SMOOTHING, COST, EPOCHS = 1.0, 0.1, 10
#: Documents with a score under this are rejected.
MARGIN = 0.0

#: Classes of bytes for shapes: 1 lower case and beyond ASCII, 2 capitals, 3 digits; marks stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct features of each text, sorted."""
    starts, ends, first = spans(raw, at, SOLID_BYTE)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = span_hashes(raw, starts, ends)
    shape = SHAPE[raw]
    fresh = np.concatenate(([True], shape[1:] != shape[:-1]))
    fresh[starts] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    shapes = span_hashes(shape[fresh], kept[starts], kept[ends])
    again = np.concatenate(([False], words[1:] == words[:-1]))
    shapes[again] = mix(shapes[again])
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    rows, keys = [], []
    for of, n, salt in ((words, 1, 0), (words, 2, 4), (shapes, 1, 1), (shapes, 2, 2), (shapes, 3, 3)):
        if len(of) < n:
            continue
        total = of if not salt else np.full(len(of) - n + 1, salt, np.uint64)
        for k in range(n if salt else 0):
            total = total + of[k : len(of) - n + 1 + k] * GRAM_CODES[k]
        inside = row[: len(total)] == row[n - 1 :]
        rows.append(row[: len(total)][inside])
        keys.append((mix(total) if salt else total)[inside])
    pairs = np.unique(np.concatenate(rows) * FEATURES + (np.concatenate(keys) & np.uint64(FEATURES - 1)).astype(np.int64))
    return pairs // FEATURES, pairs % FEATURES


def fit(rows: list[np.ndarray], good: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(weights, squared ratios, bias) for documents given by their features; None unless both classes are there."""
    if len(set(good.tolist())) < 2:
        return None
    size = np.array([len(r) for r in rows])
    flatrows = np.concatenate(rows).astype(np.int64)
    count = [np.bincount(flatrows[np.repeat(good == k, size)], minlength=FEATURES) + SMOOTHING for k in (False, True)]
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    scale = 1 / np.sqrt(np.maximum(1e-12, [np.square(ratio[r]).sum() for r in rows]))
    y = np.where(good, 1.0, -1.0)
    # The rarer class weighs as much as the other, so the cost is per class.
    cost = COST * len(y) / (2 * np.where(good, good.sum(), (~good).sum()))
    alpha, w, bias = np.zeros(len(y)), np.zeros(FEATURES), 0.0
    values = [ratio[r] * s for r, s in zip(rows, scale)]
    square = np.array([np.square(v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            after = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if after != alpha[i]:
                step = (after - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = after
    return w * ratio, np.square(ratio), bias


def training(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray, list]:
    """(features, good, doc_ids) of the sampled labelled documents, by doc_id, see bounded()."""
    own = bounded(docs, labels, "quality", sample, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, at in chunks(b.column(2)):
                row, key = features(raw, at)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                cells = [key[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(cells, pa.binary())], ["doc_id", "label", "f"])

    got = own.mapInArrow(run, f"doc_id {kind_of(own, 'doc_id')}, label int, f binary").toArrow()
    found = sorted(zip(got["doc_id"].to_pylist(), got["f"].to_pylist(), got["label"].to_pylist()))
    return [np.frombuffer(f, np.int32) for _, f, _ in found], np.array([q == 1 for *_, q in found], bool), [d for d, *_ in found]


def scorer(model: tuple[np.ndarray, np.ndarray, float] | None):
    """(texts) -> their margins, for indicators scaled to a vector of length 1; 0 for texts without features."""

    def score(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if model is None:
            return out
        for lo, hi, raw, at in chunks(texts):
            row, key = features(raw, at)
            total, length = (np.bincount(row, weights=v[key], minlength=hi - lo) for v in model[:2])
            some = np.bincount(row, minlength=hi - lo) > 0
            out[lo:hi] = np.where(some, total / np.sqrt(np.maximum(length, 1e-12)) + model[2], 0.0)
        return out

    return score


def model_for(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float] | None:
    rows, good, _ = training(docs, labels, sample)
    return fit(rows, good) if rows else None


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[str, str]]:
    """docs with positional columns and score (null for a null text)."""
    modest_batches(docs.sparkSession)
    out, where, _ = flat(docs)
    model = docs.sparkSession.sparkContext.broadcast(model_for(docs, labels, sample))
    place = int(where["text"][1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in batches:
            texts = b.column(place)
            values = pa.array(score(texts), mask=texts.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, values], [*b.schema.names, "score"])

    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType())])
    return out.mapInArrow(run, schema), where


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, score, keep) for each row.

    Defined cases: a null text has no score and is kept, like a text without words, whose score is
    0; a null doc_id is scored, but not trained on; labels that are null or not 0 or 1 don't count,
    of several labels of a document the best does; without labels of both classes nothing is
    rejected; repeated rows are scored alike; an empty table gives no rows; extra columns are ignored.
    """
    out, where = scored(pick(docs, "doc_id", "text"), labels, sample)
    return out.select(F.col(where["doc_id"]).alias("doc_id"), "score", F.coalesce(F.col("score") >= margin, F.lit(True)).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """The documents that are not rejected, with the columns of docs."""
    out, _ = scored(docs, labels, sample)
    return out.where(F.coalesce(F.col("score") >= margin, F.lit(True))).drop("score").toDF(*docs.columns)
