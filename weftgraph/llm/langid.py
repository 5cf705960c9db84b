"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions and labels every byte; the bytes'
log probabilities are averaged over the document and normalised to its probabilities. It is
trained here, in numpy, by backpropagation through time, on a bounded sample of each language's
documents, the languages being all that the table names; a document's windows together cover all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .common import kind_of, pick

WINDOW, HIDDEN = 96, 12
#: Documents of each language to train on (those of least hashes), windows of each, and the training's settings.
SAMPLE, PER_DOC, BATCH, STEPS, RATE = 1_500, 4, 128, 260, 0.02
#: Documents to train on in all; they give more windows than the training draws, whatever the number of languages.
MOST = 12_000

Params = dict[str, np.ndarray]


def start(languages: int, hidden: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {}
    for way in "fb":
        p[f"{way}x"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        p[f"{way}u"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
    p["o"] = rng.normal(0, 0.3, (2 * hidden, languages)).astype(np.float32)
    p["c"] = np.zeros(languages, np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def states(p: Params, way: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (length, windows, hidden) of bytes x (length, windows) in one direction; 256 is padding, which holds the state."""
    length, windows = x.shape
    hidden = p[f"{way}u"].shape[0]
    table, u = p[f"{way}x"], p[f"{way}u"]
    gates_u, new_u = np.ascontiguousarray(u[:, : 2 * hidden]), np.ascontiguousarray(u[:, 2 * hidden :])
    out = np.empty((length, windows, hidden), np.float32)
    h = np.zeros((windows, hidden), np.float32)
    for t in range(length) if way == "f" else range(length - 1, -1, -1):
        g = table[x[t]]
        zr = sigmoid(h @ gates_u + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = (r * h) @ new_u
        n += g[:, 2 * hidden :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, n))
        step = h - n
        step *= z
        step += n
        h = out[t] = np.where((x[t] < 256)[:, None], step, h) if x[t].max() == 256 else step
    return out


def logits(p: Params, x: np.ndarray) -> np.ndarray:
    hidden = p["fu"].shape[0]
    return states(p, "f", x) @ p["o"][:hidden] + states(p, "b", x) @ p["o"][hidden:] + p["c"]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean loss over the bytes of x (length, windows) with a language y for each window, and its gradients."""
    hidden, windows = p["fu"].shape[0], x.shape[1]
    kept: dict[str, list] = {"f": [], "b": []}
    hs = {way: states(p, way, x, kept[way]) for way in "fb"}
    probs = softmax(hs["f"] @ p["o"][:hidden] + hs["b"] @ p["o"][hidden:] + p["c"])
    real = x < 256
    total = max(1, real.sum())
    loss = -np.log(np.maximum(probs[:, np.arange(windows), y], 1e-12))[real].sum() / total
    probs[:, np.arange(windows), y] -= 1
    d_out = (probs * (real[..., None] / total)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"] = d_out.sum((0, 1))
    for i, way in enumerate("fb"):
        own = slice(i * hidden, (i + 1) * hidden)
        g["o"][own] = np.einsum("twh,twl->hl", hs[way], d_out)
        d_hs = d_out @ p["o"][own].T
        d_h = np.zeros((windows, hidden), np.float32)
        u = p[f"{way}u"]
        for t, h, z, r, n in reversed(kept[way]):
            d_h = d_h + d_hs[t]
            live = (x[t] < 256)[:, None]
            d_n = d_h * (1 - z) * (1 - n * n) * live
            d_rh = d_n @ u[:, 2 * hidden :].T
            d_z = d_h * (h - n) * z * (1 - z) * live
            d_r = d_rh * h * r * (1 - r)
            d_g = np.concatenate((d_z, d_r, d_n), 1)
            np.add.at(g[f"{way}x"], x[t], d_g)
            g[f"{way}u"][:, : 2 * hidden] += h.T @ d_g[:, : 2 * hidden]
            g[f"{way}u"][:, 2 * hidden :] += (r * h).T @ d_n
            d_h = np.where(live, d_h * z + d_rh * r + d_g[:, : 2 * hidden] @ u[:, : 2 * hidden].T, d_h)
    return float(loss), g


def cut_windows(raw: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, bytes (windows, window) padded by 256)."""
    size = np.diff(at)
    many = -(-size // window)
    text = np.repeat(np.arange(len(size)), many)
    no = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(many)))[:-1], many)
    begin = at[text] + no * window
    left = np.minimum(at[text + 1] - begin, window)
    place = begin[:, None] + np.arange(window)
    inside = np.arange(window) < left[:, None]
    return text, np.where(inside, raw[np.minimum(place, max(0, len(raw) - 1))].astype(np.int16), 256) if len(text) else np.empty((0, window), np.int16)


def train(texts: list[bytes], labels: list[int], languages: int, hidden: int = HIDDEN, window: int = WINDOW, steps: int = STEPS, seed: int = 7) -> Params:
    """Adam over random windows, every language equally often."""
    rng = np.random.default_rng(seed)
    pool: list[list[np.ndarray]] = [[] for _ in range(languages)]
    for text, label in zip(texts, labels):
        raw = np.frombuffer(text, np.uint8)
        if len(raw):
            for _ in range(PER_DOC):
                i = int(rng.integers(0, max(1, len(raw) - window + 1)))
                piece = np.full(window, 256, np.int16)
                piece[: len(raw) - i] = raw[i : i + window]
                pool[label].append(piece)
    pools = [np.array(w) for w in pool]
    p = start(languages, hidden, seed)
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    there = [i for i, w in enumerate(pools) if len(w)]
    for step in range(1, steps + 1):
        y = np.array(there)[rng.integers(0, len(there), BATCH)]
        x = np.array([pools[k][rng.integers(len(pools[k]))] for k in y]).T
        _, g = gradients(p, x, y)
        norm = np.sqrt(sum(float(np.square(v).sum()) for v in g.values()))
        for k, v in g.items():
            v *= min(1.0, 1.0 / (norm + 1e-9))
            one[k] += 0.1 * (v - one[k])
            two[k] += 0.01 * (v * v - two[k])
            rate = RATE * (1 - step / (steps + 1))
            p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)
    return p


def label_bytes(p: Params, texts: pa.Array, window: int = WINDOW, most: int = 2048) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, mean log probability of each language, number of bytes given to each language) for each row."""
    for lo, hi, raw, at in chunks(texts, 400_000):
        text, x = cut_windows(raw, at, window)
        k = len(p["c"])
        total, votes = np.zeros((hi - lo, k)), np.zeros((hi - lo, k), np.int64)
        full = np.argsort((x == 256).any(1), kind="stable")
        for i in range(0, len(full), most):
            own = full[i : i + most]
            piece = np.ascontiguousarray(x[own].T)
            scores = logits(p, piece)
            top = scores.max(-1, keepdims=True)
            scores -= top
            scores -= np.log(np.exp(scores).sum(-1, keepdims=True))
            real = piece < 256
            best = scores.argmax(-1)
            for j in range(k):
                total[:, j] += np.bincount(text[own], weights=(scores[..., j] * real).sum(0), minlength=hi - lo)
                votes[:, j] += np.bincount(text[own], weights=((best == j) & real).sum(0), minlength=hi - lo).astype(np.int64)
        yield lo, total / np.maximum(1, np.diff(at))[:, None], votes


def model_for(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> tuple[list[str], Params] | None:
    """(languages, network) from the documents whose lang is known; None if there are none.

    The languages are those of the whole table, however rare. Of each, up to `sample` documents
    are trained on, those of least hashes of id, lang and text, or fewer where that makes more than
    MOST in all. Repeated rows count once, however many there are.
    """
    known = pick(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    many = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not many:
        return None
    languages = sorted(many)
    sample = min(sample, -(-MOST // len(languages)))

    def under(bounds: dict[str, int]) -> DataFrame:
        table = docs.sparkSession.createDataFrame(sorted(bounds.items()), "l string, bound long")
        return known.join(F.broadcast(table), F.col("lang") == F.col("l")).where("key <= bound")

    # First the keys under a bound that about twice as many pass, then the texts under the sample's exact one.
    keys: dict[str, set[int]] = {}
    for lang, key in under({k: min((2 * sample + 200 << 64) // n, (1 << 64) - 1) - (1 << 63) for k, n in many.items()}).select("lang", "key").distinct().collect():
        keys.setdefault(lang, set()).add(key)
    rows = under({k: sorted(v)[:sample][-1] for k, v in keys.items()})
    # A window is drawn from these bytes; the text itself is not cut anywhere else.
    got = rows.groupBy("lang", "key").agg(F.first("text").alias("text")).orderBy("lang", "key").toArrow()
    return languages, train([t.encode() for t in got["text"].to_pylist()], [languages.index(k) for k in got["lang"].to_pylist()], len(languages), steps=steps)


def identified(docs: DataFrame, model: tuple[list[str], Params] | None = None, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """(doc_id, language, probability, bytes: how many bytes are labelled with each language) for each row.

    Defined cases: a null or empty text has no bytes, so its language and probability are null and
    its counts 0; documents with a null lang or doc_id are labelled like others (a null lang is
    not trained on); repeated rows are labelled alike; if all langs are null every result is null;
    ties go to the language first by name; an empty table gives no rows; extra columns are ignored;
    doc_id keeps its type.
    """
    found = model or model_for(docs, sample, steps)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if shared.value is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, kind)], names)
                continue
            languages, p = shared.value
            for lo, mean, votes in label_bytes(p, b.column(1)):
                some = votes.sum(1) > 0
                e = np.exp(mean - mean.max(1, keepdims=True))
                probs = e / e.sum(1, keepdims=True)
                best = probs.argmax(1)
                names_ = [languages[k] if s else None for k, s in zip(best, some)]
                counts = pa.MapArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * len(languages), pa.array(languages * len(some)), pa.array(votes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + len(some)], pa.array(names_, pa.string()), pa.array(probs.max(1), mask=~some), counts], names)

    names, kind = ["doc_id", "language", "probability", "bytes"], pa.map_(pa.string(), pa.int64())
    own = pick(docs, "doc_id", "text")
    return own.mapInArrow(run, f"doc_id {kind_of(own, 'doc_id')}, language string, probability double, bytes map<string, long>")
