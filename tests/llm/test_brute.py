"""Operators that SQL can't express, against plain versions that share no code with them."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, langid, packing, quality_classifier, toxicity

from .conftest import words
from .test_models import labels, sentences


def shape(word):
    kinds = ["a" if c.islower() or ord(c) > 127 else "A" if c.isupper() else "0" if c.isdigit() else c for c in word]
    return "".join(c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1])


def grams(text):
    ws = text.split()
    shapes = [(shape(w), i > 0 and ws[i - 1] == w) for i, w in enumerate(ws)]
    found = {("w", w) for w in ws} | {("ww", *p) for p in zip(ws, ws[1:])}
    return found | {("s", *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def test_classifier_against_plain_version(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_classifier, "EPOCHS", 3000)
    monkeypatch.setattr(quality_classifier, "FEATURES", 1 << 22)
    rows = [(i, sentences(i, 6 + i % 5, junk=i % 4 == 0) + f" tail{i % 9}") for i in range(60)]
    known = [(i, int(i % 4 != 0), 0) for i in range(40)]
    got = {r.doc_id: r.score for r in quality_classifier.classified(docs(rows), labels(spark, known)).collect()}
    sets = {i: grams(t) for i, t in rows}
    count = {q: collections.Counter(g for i, k, _ in known if k == q for g in sets[i]) for q in (0, 1)}
    total = {q: sum(count[q].values()) + quality_classifier.FEATURES for q in (0, 1)}
    ratio = lambda g: math.log((count[1][g] + 1) / total[1]) - math.log((count[0][g] + 1) / total[0])
    vocabulary = sorted(set().union(*(sets[i] for i, *_ in known)))
    place = {g: k for k, g in enumerate(vocabulary)}

    def vector(i):
        # What no labelled document has counts for the length alone.
        v, rest = np.zeros(len(vocabulary)), 0.0
        for g in sets[i]:
            if g in place:
                v[place[g]] = ratio(g)
            else:
                rest += ratio(g) ** 2
        return v / math.sqrt((v**2).sum() + rest)

    x = np.array([np.append(vector(i), 1.0) for i, *_ in known])
    y = np.array([2.0 * k - 1 for _, k, _ in known])
    n_good = (y > 0).sum()
    cost = quality_classifier.COST * len(y) / (2 * np.where(y > 0, n_good, len(y) - n_good))
    # The dual by projected gradient ascent.
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(len(y))
    for _ in range(40_000):
        alpha = np.clip(alpha + (1 - q @ alpha) / np.linalg.norm(q, 2), 0, cost)
    w = (alpha * y) @ x
    for i, _ in rows:
        assert got[i] == pytest.approx(float(vector(i) @ w[:-1] + w[-1]), abs=2e-3)


def test_features_against_dictionary():
    texts = ["Ab ab ab!! 12x\n zz", "", "Über straße straße A-1", " one\ttwo "]
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, key = quality_classifier.features(np.frombuffer(raw, np.uint8), at)
    assert [int((row == i).sum()) for i in range(4)] == [len(grams(t)) for t in texts]


def test_network_against_loops():
    rng = np.random.default_rng(3)
    p = langid.start(3, 4, 1)
    p["c"] = rng.normal(size=3).astype(np.float32)
    texts = ["", "abc dé", "x" * 23, "hello there " * 3]
    squash = lambda v: 1 / (1 + np.exp(-v))

    def run(way, window):
        h, out = np.zeros(4), {}
        x, u = p[f"{way}x"].astype(float), p[f"{way}u"].astype(float)
        for t in range(len(window)) if way == "f" else range(len(window) - 1, -1, -1):
            g = x[window[t]]
            z, r = squash(h @ u[:, :4] + g[:4]), squash(h @ u[:, 4:8] + g[4:8])
            n = np.tanh((r * h) @ u[:, 8:] + g[8:])
            h = out[t] = (1 - z) * n + z * h
        return out

    (lo, mean, votes), = langid.label_bytes(p, pa.array(texts), 7)
    for i, text in enumerate(texts):
        raw, total, best = text.encode(), np.zeros(3), np.zeros(3, int)
        for k in range(0, len(raw), 7):
            window = raw[k : k + 7]
            f, b = run("f", window), run("b", window)
            for t in range(len(window)):
                score = np.concatenate((f[t], b[t])) @ p["o"].astype(float) + p["c"]
                score -= np.log(np.exp(score).sum())
                total += score
                best[score.argmax()] += 1
        assert np.allclose(mean[i], total / max(1, len(raw)), atol=1e-5) and votes[i].tolist() == best.tolist()


WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def test_lexicon_and_spans_against_plain_version():
    rng = random.Random(1)
    texts, toxic = [], []
    for i in range(160):
        ws = rng.choices(["river", "stones", "quiet", "birds", "singen", "Straße"], k=12)
        bad = i % 4 == 0
        if bad:
            ws.insert(rng.randrange(12), rng.choice(["blorghed", "blorghing", "zúmpa"]))
        texts.append(" ".join(ws))
        toxic.append(bad)
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, _, first, keys = toxicity.tokens(np.frombuffer(raw, np.uint8), at)
    marks = toxicity.lexicon(keys, first, np.array(toxic))
    # Plain: (kind, word or beginning in bytes) to documents and to the words before it.
    where, before, seen = collections.defaultdict(set), collections.defaultdict(set), {}
    for d, t in enumerate(texts):
        last, row = None, int(first[d])
        for w in (m.group().lower() for m in WORD.finditer(t)):
            for k, g in enumerate([w.encode(), *(w.encode()[:n] for n in (4, 5, 6))]):
                where[k, g].add(d)
                if toxic[d]:
                    before[k, g].add(last)
                seen[k, g] = int(keys[row, k])
            last, row = w, row + 1
    want, share = set(), sum(toxic) / len(toxic)
    for key, ds in where.items():
        b = min(sum(toxic[d] for d in ds), len(before[key]))
        g = sum(not toxic[d] for d in ds)
        rate = b / max(1, b + g)
        score = (b * math.log(rate / share) if b else 0) + (g * math.log((1 - rate) / (1 - share)) if g else 0)
        if rate > 0.9 and score > toxicity.EVIDENCE:
            want.add(seen[key])
    assert set(marks.tolist()) == want
    model = {"w": np.zeros(toxicity.FEATURES, np.float32), "trans": np.zeros((2, 2)), "begin": np.zeros(2)}
    model["w"][toxicity.slots(np.array([seen[0, "zúmpa".encode()], seen[0, b"river"]], np.uint64))] = 9.0
    for (score, found), in [list(toxicity.tag(model, pa.array(texts)))]:
        for d, t in enumerate(texts):
            runs, open_ = [], False
            for m in WORD.finditer(t):
                # With these weights a token is toxic if it or a feature of it has the slot.
                hit = m.group().lower() in ("zúmpa", "river")
                if hit and open_:
                    runs[-1] = (runs[-1][0], m.end())
                elif hit:
                    runs.append((m.start(), m.end()))
                open_ = hit
            assert found[d] == runs


def test_packing_against_plain_ranks_in_any_session(spark, docs):
    rows = [(i if i % 17 else None, words(i, 1 + (i * 37) % 90)) for i in range(300)]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, packing.pack(docs(rows), 40).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    items = [(i, p, p * 40, min(40, len(t.split()) - p * 40)) for i, t in rows for p in range(-(-len(t.split()) // 40))]
    part = spark.createDataFrame([(i, p) for i, p, *_ in items], "doc_id long, piece int").select("doc_id", "piece", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packing.PARTS)).alias("k"))
    of = {(r.doc_id, r.piece): r.k for r in part.collect()}
    runs, _ = packing.plan(dict(collections.Counter(x[3] for x in items)), 40)
    want = []
    for length in {x[3] for x in items}:
        own = sorted((x for x in items if x[3] == length), key=lambda x: (of[x[0], x[1]], x[0] is None, x[0] or 0, x[1]))
        for rank, (i, p, start, n) in enumerate(own):
            want.append(next((first + (rank - lo) // each, i, p, start, n) for s, lo, hi, first, each in runs if s == length and lo <= rank < hi))
    assert sorted(want, key=str) == found[0]


def test_samples_stay_bounded(spark, docs):
    rows = [(1, words(i, 3)) for i in range(3000)] + [(None, words(i, 3)) for i in range(3000)] + [(i, words(i, 3)) for i in range(2, 40)] + [(50, "same text here")] * 3000
    known = labels(spark, [(1, 1, 1), (None, 1, 1), (50, 0, 0)] + [(i, i % 2, i % 2) for i in range(2, 40)])
    assert common.bounded(docs(rows), known, "toxic", 20, True).count() <= 40
    got = common.bounded(docs(rows), known, "quality", 20, False).collect()
    assert len(got) <= 20 and all(r.doc_id is not None for r in got) and len({(r.doc_id, r.text) for r in got}) == len(got)
    assert langid.model_for(docs(rows), sample=20, steps=1)[0] == ["en"]


def test_ids_of_any_type(spark):
    rows = [(f"id{i}", sentences(i, 12, junk=i % 3 == 0), "en", "s") for i in range(40)] + [(None, None, "en", None), ("AKIA", "AKIA" + "A1B2" * 4, "en", "s")]
    named = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    known = spark.createDataFrame([(f"id{i}", int(i % 3 != 0), int(i % 3 == 0)) for i in range(20)], "doc_id string, quality int, toxic int")
    from weftgraph.llm import exact_dedup, mixing, secrets

    for out in (mixing.emitted(named), toxicity.tagged(named, known), packing.pack(named), langid.identified(named, steps=2), secrets.scan(named), exact_dedup.survivors(named), quality_classifier.classified(named, known)):
        assert "AKIA" in {r.doc_id for r in out.collect()}
