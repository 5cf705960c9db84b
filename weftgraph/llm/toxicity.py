"""Toxic spans by a linear-chain conditional random field over tokens.

The field has two states, clean and toxic, weights of hashed features of a token (the word, its
beginnings of four to six characters, its ending, the words beside it) and of the transitions. Forward and
backward passes give every token's marginal probability of being toxic; a document's score is the
greatest marginal, and its offending offsets are the runs of tokens whose marginal reaches the
threshold.

It is trained, with exact gradients of the likelihood, on labelled tokens of a bounded sample of
labelled documents. The labels of tokens follow from those of the documents: in a toxic document a
token is toxic if its word or its beginning is so much commoner in toxic than in clean documents
that the log likelihood ratio passes EVIDENCE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesets import GRAM_CODES, WORD_BYTE, chunks, mix, span_hashes, spans
from .common import bounded, kind_of, pick

#: Hashed features (a power of two), labelled documents of each class to train on, and settings.
FEATURES, SAMPLE = 1 << 20, 1_200
EVIDENCE, THRESHOLD = 12.0, 0.7
EPOCHS, RATE, DECAY, WINDOW = 6, 0.3, 1e-4, 64

Model = dict[str, np.ndarray]


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first token of each text, keys (token, kind)): word, beginnings of 4, 5, 6 bytes, ending of 4, next to, before."""
    starts, ends, first = spans(raw, at, WORD_BYTE)
    if not len(starts):
        return starts, ends, first, np.empty((0, 7), np.uint64)
    low = raw.copy()
    capital = (raw >= 65) & (raw <= 90)
    low[capital] += 32
    # The second byte of Latin-1's capital letters in UTF-8, after 0xC3.
    second = np.concatenate(([False], (raw[:-1] == 0xC3))) & (raw >= 0x80) & (raw <= 0x9E)
    low[second] += 32
    keys = np.empty((len(starts), 7), np.uint64)
    keys[:, 0] = span_hashes(low, starts, ends)
    for k, n in enumerate((4, 5, 6), 1):
        keys[:, k] = mix(span_hashes(low, starts, np.minimum(ends, starts + n)) ^ GRAM_CODES[k])
    keys[:, 4] = mix(span_hashes(low, np.maximum(starts, ends - 4), ends) ^ GRAM_CODES[4])
    head = np.zeros(len(starts) + 1, bool)
    head[first] = True
    before = np.concatenate(([np.uint64(0)], keys[:-1, 0]))
    before[head[:-1]] = 0
    after = np.concatenate((keys[1:, 0], [np.uint64(0)]))
    after[head[1:]] = 0
    keys[:, 5], keys[:, 6] = mix(before ^ GRAM_CODES[5]), mix(after ^ GRAM_CODES[6])
    return starts, ends, first, keys


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(FEATURES - 1)).astype(np.int64)


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each token is toxic, expected transitions (2, 2)) of all sequences at once.

    emission: score of the toxic state, the clean one's is 0. Step t treats the t-th token of
    every sequence that has one, so work is in proportion to the tokens.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    head, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    m = np.exp(trans - trans.max())
    # Scores are the log odds of toxic against clean, so each pass keeps one number a token.
    forward, backward = np.empty(len(emission)), np.zeros(len(emission))
    odds = emission[head[: live[0]]] + (begin[1] - begin[0]) if longest else None
    for t in range(longest):
        n = live[t]
        own = head[:n] + t
        if t:
            p = 1 / (1 + np.exp(-odds[:n]))
            odds = np.log(((1 - p) * m[0, 1] + p * m[1, 1]) / ((1 - p) * m[0, 0] + p * m[1, 0])) + emission[own]
        forward[own] = odds
    odds = np.zeros(0)
    for t in range(longest - 2, -1, -1):
        n, later = live[t], live[t + 1]
        nxt = head[:later] + t + 1
        q = 1 / (1 + np.exp(-(backward[nxt] + emission[nxt])))
        backward[head[:later] + t] = np.log(((1 - q) * m[1, 0] + q * m[1, 1]) / ((1 - q) * m[0, 0] + q * m[0, 1]))
    prob = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
    inner = np.ones(len(emission), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    b = np.flatnonzero(inner)
    p = 1 / (1 + np.exp(-np.clip(forward[b - 1], -60, 60)))
    q = 1 / (1 + np.exp(-np.clip(emission[b] + backward[b], -60, 60)))
    joint = np.empty((2, 2, len(b)))
    for i, pi in enumerate((1 - p, p)):
        for j, qj in enumerate((1 - q, q)):
            joint[i, j] = pi * m[i, j] * qj
    return prob, (joint / joint.sum((0, 1))).sum(2) if len(b) else np.zeros((2, 2))


def tally(key: np.ndarray, other: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, how many different others each has where bad, and elsewhere)."""
    order = np.lexsort((bad, other, key))
    key, other, bad = key[order], other[order], bad[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1]) | (bad[1:] != bad[:-1])))
    key, bad = key[new], bad[new]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.add.reduceat(bad, at, dtype=np.int64), np.add.reduceat(~bad, at, dtype=np.int64)


def lexicon(keys: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sorted keys of words and beginnings that mark toxic documents.

    A key counts as often as there are documents, or if fewer, different words before it: near
    copies of one toxic document agree in these, so that their other words gather no evidence.
    """
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    found, bad, good = [], [], []
    for k in range(4):
        own = keys[:, k]
        f, b1, g1 = tally(own, row, toxic[row])
        _, b2, g2 = tally(own, keys[:, 5], toxic[row])
        found.append(f)
        bad.append(np.minimum(b1, b2))
        good.append(g1)
    found, bad, good = (np.concatenate(x) for x in (found, bad, good))
    share = toxic.mean()
    every = bad + good
    rate = bad / np.maximum(1, every)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(bad > 0, bad * np.log(rate / share), 0) + np.where(good > 0, good * np.log((1 - rate) / (1 - share)), 0)
    return np.sort(found[(rate > 0.9) & (ratio > EVIDENCE)])


def fit(texts: pa.Array, toxic: np.ndarray, seed: int = 3) -> Model | None:
    """The field, or None if no token can be labelled toxic."""
    if not toxic.any() or toxic.all():
        return None
    parts = []
    for lo, hi, raw, at in chunks(texts):
        _, _, first, keys = tokens(raw, at)
        parts.append((first, keys))
    keys = np.concatenate([k for _, k in parts])
    size = np.concatenate([np.diff(f) for f, _ in parts])
    first = np.concatenate(([0], np.cumsum(size)))
    if not len(keys):
        return None
    marks = lexicon(keys, first, toxic)
    if not len(marks):
        return None
    label = np.isin(keys[:, :4], marks).any(1) & np.repeat(toxic, size)
    # Windows of the sequences: all that have a toxic token, and all of clean documents.
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - first[row]
    window = np.unique(row * (1 << 32) + place // WINDOW, return_inverse=True)[1]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(window)) + 1, [len(window)]))
    has = np.add.reduceat(label, edges[:-1]) > 0
    clean = np.flatnonzero(~has & ~toxic[row[edges[:-1]]])
    rng = np.random.default_rng(seed)
    chosen = np.concatenate((np.flatnonzero(has), clean))
    feats = slots(keys).astype(np.int32)
    del keys, place, window, row
    w, trans, begin = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)
    g2, t2, b2 = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(EPOCHS):
        rng.shuffle(chosen)
        for i in range(0, len(chosen), 256):
            own = chosen[i : i + 256]
            at = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in own])
            begins = np.concatenate(([0], np.cumsum(edges[own + 1] - edges[own])))
            f, y = feats[at], label[at]
            prob, pairs = marginals(w[f].sum(1), begins, trans, begin)
            n = len(own)
            used, back = np.unique(f, return_inverse=True)
            g = np.bincount(back.reshape(-1), weights=np.repeat(y - prob, f.shape[1]), minlength=len(used)) / n - DECAY * w[used]
            g2[used] += g * g
            w[used] += RATE * g / np.sqrt(g2[used])
            inner = np.ones(len(at), bool)
            inner[begins[:-1]] = False
            b = np.flatnonzero(inner)
            seen = np.bincount(2 * y[b - 1] + y[b], minlength=4).reshape(2, 2)
            g = (seen - pairs) / n - DECAY * trans
            t2 += g * g
            trans = trans + RATE * g / np.sqrt(t2)
            rate = y[begins[:-1]].mean() - prob[begins[:-1]].mean()
            g = np.array([-rate, rate]) - DECAY * begin
            b2 += g * g
            begin = begin + RATE * g / np.sqrt(b2)
    return {"w": w.astype(np.float32), "trans": trans, "begin": begin}


def tag(model: Model | None, texts: pa.Array, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, list[list[tuple[int, int]]]]]:
    """(scores, spans in characters) of the rows, some megabytes of text at a time."""
    for lo, hi, raw, at in chunks(texts, 8_000_000):
        score: np.ndarray = np.zeros(hi - lo)
        found: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        if model is not None:
            starts, ends, first, keys = tokens(raw, at)
            emission = model["w"][slots(keys[:, 0])].astype(np.float64)
            for k in range(1, keys.shape[1]):
                emission += model["w"][slots(keys[:, k])]
            del keys
            prob, _ = marginals(emission, first, model["trans"], model["begin"])
            some = np.diff(first) > 0
            if some.any():
                score[some] = np.maximum.reduceat(prob, first[:-1][some])
            hits = np.flatnonzero(prob >= threshold)
            rows = np.searchsorted(first, hits, "right") - 1
            for r in np.unique(rows):
                # Characters before a byte: the bytes that don't continue a character.
                chars = np.concatenate(([0], np.cumsum((raw[at[r] : at[r + 1]] & 0xC0) != 0x80)))
                last = -2
                for h in hits[rows == r].tolist() if len(rows) < 1000 else hits[np.searchsorted(rows, r) : np.searchsorted(rows, r, "right")].tolist():
                    a, b = int(chars[starts[h] - at[r]]), int(chars[ends[h] - at[r]])
                    if h == last + 1:
                        found[r][-1] = (found[r][-1][0], b)
                    else:
                        found[r].append((a, b))
                    last = h
        yield score, found


def model_for(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The field, from up to `sample` toxic and as many clean labelled documents (the least hashes of their ids), see bounded()."""
    by = bounded(docs, labels, "toxic", sample, True).orderBy("doc_id", "text").toArrow()
    seen: dict[str, int] = {}
    for text, toxic in zip(by["text"].to_pylist(), by["label"].to_pylist()):
        seen[text] = max(toxic, seen.get(text, 0))
    return fit(pa.array(list(seen), pa.large_string()), np.array(list(seen.values()), bool)) if seen else None


def tagged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, is_toxic, spans: start and end of each toxic run of tokens, in characters) for each row.

    Defined cases: a null or empty text, or one without words, has score 0 and no spans; a null
    doc_id is tagged, but not trained on; labels that are null or not 0 or 1 don't count, and a
    document with several is toxic if one says so; texts that repeat are trained on once; without
    labels of both classes, or without tokens that mark toxic ones, every score is 0; repeated
    rows are tagged alike; an empty table gives no rows; extra columns are ignored; doc_id keeps
    its type.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_for(docs, labels, sample))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for score, found in tag(model.value, b.column(1), threshold):
                spans_ = pa.array([[{"start": x, "end": y} for x, y in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + len(score)], pa.array(score), pa.array(score >= threshold), spans_], ["doc_id", "score", "is_toxic", "spans"])
                lo += len(score)

    own = pick(docs, "doc_id", "text")
    return own.mapInArrow(run, f"doc_id {kind_of(own, 'doc_id')}, score double, is_toxic boolean, spans array<struct<start: long, end: long>>")
