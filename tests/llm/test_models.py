import itertools
import random

import numpy as np
import pyarrow as pa

from weftgraph.llm import langid, quality_classifier, toxicity

from .conftest import CLASHING, ODD

CLEAN = "the river runs over quiet stones while birds sing near old trees and people walk home".split()


def sentences(seed, n, junk=False, bad=()):
    rng = random.Random(seed)
    ws = rng.choices(CLEAN, k=n)
    if junk:
        ws = [w.upper() + "!!" if rng.random() < 0.5 else w + "$$$" for w in ws]
    for w in bad:
        ws.insert(rng.randrange(len(ws)), w)
    return " ".join(ws)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifier_separates_held_out(spark, docs):
    rows = [(i, sentences(i, 30, junk=i % 3 == 0)) for i in range(300)]
    known = labels(spark, [(i, int(i % 3 != 0), 0) for i in range(150)])
    out = {r.doc_id: r.keep for r in quality_classifier.classified(docs(rows), known).collect()}
    assert all(out[i] == (i % 3 != 0) for i in range(300))
    assert {r.doc_id for r in quality_classifier.kept(docs(rows), known).collect()} == {i for i in range(300) if i % 3}


def test_features_and_descent_against_brute_force():
    raw = np.frombuffer(b"Ab ab ab!! \nzz", np.uint8)
    row, key = quality_classifier.features(raw, np.array([0, 11, 14]))
    # Words: Ab, ab, ab!!; pairs of words 2; shapes Aa, a, a!; pairs of shapes 2, triples 1. Then zz: word and shape.
    assert (row == 0).sum() == 3 + 2 + 3 + 2 + 1 and (row == 1).sum() == 2 and len(set(key.tolist())) >= 8
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 6), [100 + (i % 2)]))).astype(np.int32) for i in range(80)]
    good = np.arange(80) % 2 == 0
    w, squares, bias = quality_classifier.fit(rows, good)
    margin = np.array([w[r].sum() / np.sqrt(squares[r].sum()) + bias for r in rows])
    assert ((margin > 0) == good).all()


def test_classifier_odd_rows(spark, docs):
    odd = docs(ODD, CLASHING)
    for known in ([], [(1, 1, 0)], [(None, None, None), (1, 1, 0), (8, 0, 0), (8, 0, 0), (4, 0, 0)]):
        out = quality_classifier.classified(odd, labels(spark, known))
        assert out.count() == len(ODD) and out.where("score IS NULL").count() == 2
        assert out.where("score IS NULL AND NOT keep").count() == 0
        assert quality_classifier.kept(odd, labels(spark, known)).columns == odd.columns
    assert quality_classifier.classified(docs([]), labels(spark, [])).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    emission, first = rng.normal(size=10), np.array([0, 4, 4, 9, 10])
    trans, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    prob, pairs = toxicity.marginals(emission, first, trans, begin)
    expected = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total, own, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=b - a) if b > a else ():
            v = np.exp(begin[s[0]] + sum(emission[a + i] * x for i, x in enumerate(s)) + sum(trans[x, y] for x, y in itertools.pairwise(s)))
            total += v
            own += v * np.array(s)
            for x, y in itertools.pairwise(s):
                both[x, y] += v
        if b > a:
            assert np.allclose(own / total, prob[a:b])
            expected += both / total
    assert np.allclose(expected, pairs)


def test_toxic_spans(spark, docs):
    bad = {i for i in range(240) if i % 3 == 0}
    rows = [(i, sentences(i, 25, bad=("blorgh", "Zúmpa") if i in bad else ())) for i in range(240)]
    known = labels(spark, [(i, 1, int(i in bad)) for i in range(120)])
    out = toxicity.tagged(docs(rows), known).collect()
    assert {r.doc_id for r in out if r.is_toxic} == bad and len(out) == 240
    text = dict(rows)
    assert {w for r in out for s in r.spans for w in text[r.doc_id][s.start : s.end].split()} == {"blorgh", "Zúmpa"}


def test_toxicity_odd_rows(spark, docs):
    odd = docs(ODD, CLASHING)
    for known in ([], [(1, 1, 1)], [(None, 1, 1), (1, 1, 1), (1, 1, None), (8, 1, 0)]):
        out = toxicity.tagged(odd, labels(spark, known))
        assert out.count() == len(ODD) and out.where("score > 0.7").count() == 0
    assert toxicity.tagged(docs([]), labels(spark, [])).count() == 0
    model = {"w": np.ones(toxicity.FEATURES, np.float32), "trans": np.zeros((2, 2)), "begin": np.zeros(2)}
    (score, spans), = toxicity.tag(model, pa.array(["héé wörld", None, "", "..."]))
    assert spans == [[(0, 9)], [], [], []] and (score[1:] == 0).all()


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.start(3, 4, 1).items()}
    x = rng.integers(97, 105, (7, 5)).astype(np.int16)
    x[5:, 2] = 256
    y = np.array([0, 1, 2, 1, 0])
    _, g = langid.gradients(p, x, y)
    for k in p:
        for _ in range(4):
            i = (int(x[0, 0]), rng.integers(0, 12)) if k in ("fx", "bx") else tuple(rng.integers(0, s) for s in p[k].shape)
            old, found = p[k][i], []
            for e in (0.01, -0.01):
                p[k][i] = old + e
                found.append(langid.gradients(p, x, y)[0])
            p[k][i] = old
            assert abs((found[0] - found[1]) / 0.02 - g[k][i]) < 2e-4


def test_languages_held_out_and_odd_rows(spark, docs):
    alphabets = {"xx": "abcdeé", "yy": "mnopqr"}
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lang = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(20)), "s", lang))
    train, test = rows[:80], rows[80:]
    model = langid.model_for(docs(train), steps=40)
    out = {r.doc_id: r for r in langid.identified(docs(test), model).collect()}
    assert all(out[r[0]].language == r[3] for r in test)
    assert all(sum(out[r[0]].bytes.values()) == len(r[1].encode()) for r in test)
    odd = langid.identified(docs(ODD, CLASHING), model)
    assert odd.count() == len(ODD) and odd.where("language IS NULL").count() == 4
    assert odd.where("doc_id = 7").first().bytes and sum(odd.where("doc_id = 7").first().bytes.values()) == len(ODD[10][1])
    assert langid.identified(docs([])).count() == 0
    assert langid.identified(docs([(1, "abc", "s", None)])).first().language is None
