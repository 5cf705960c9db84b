"""Classes of many near copies, whose pairs are far more than their documents."""

import random

import numpy as np

from weftgraph.llm import ngram_join

from .conftest import words
from .test_dedup import brute, corpus


def near_copies(seed, n, length=60, changes=2):
    """n different texts that mostly reach the threshold with each other."""
    rng, base = random.Random(seed), words(seed, length).split()
    rows = []
    for i in range(n):
        ws = list(base)
        for at in rng.sample(range(length), rng.randint(0, changes)):
            ws[at] = f"w{rng.randrange(10**9)}"
        rows.append((i, " ".join(ws)))
    return rows


def test_rows_of_verification_follow_the_sets(docs):
    rows = near_copies(1, 150)
    _, sets, found = ngram_join.verified(docs(rows))
    links = sum(n for *_, n in brute(rows)) // 2
    assert links > 20 * len(rows)
    assert found.count() < 5 * sets.count()


def test_near_copies_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", 16)
    monkeypatch.setattr(ngram_join, "WIDE", 50)
    rows = near_copies(2, 120) + [(1000 + i, t) for i, t in near_copies(3, 60, 80, 8)] + [(2000 + i, t) for i, t in near_copies(2, 20)]
    assert sorted(map(tuple, ngram_join.linked(docs(rows)).collect()), key=str) == brute(rows)


def test_overlaps_and_spanning():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 30)).astype(np.uint64)) for _ in range(rng.integers(1, 9))] for _ in range(2))
        assert ngram_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
        hits = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2
        if hits.any():
            i, j = ngram_join.spanning(hits)
            reach = lambda m: np.linalg.matrix_power(np.block([[np.eye(len(m)), m], [m.T, np.eye(m.shape[1])]]), 24) > 0
            some = np.zeros(hits.shape)
            some[i, j] = 1
            assert hits[i, j].all() and len(i) < sum(hits.shape) and (reach(some) == reach(hits.astype(float))).all()


def test_near_copies_meet_as_units(docs, monkeypatch):
    rows = near_copies(5, 200)
    counted = []
    candidates = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *args: counted.append(candidates(*args)) or counted[-1])
    monkeypatch.setattr(ngram_join, "discard", lambda *tables: None)
    assert sorted(map(tuple, ngram_join.linked(docs(rows)).collect()), key=str) == brute(rows)
    assert counted[0].count() < 5 * len(rows)


def test_units_of_any_shape(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "DENSE", 2)
    monkeypatch.setattr(ngram_join, "UNIT_GRAMS", 300)
    for seed, threshold in ((6, 0.6), (7, 0.35), (8, 0.85)):
        rows = corpus(seed) + [(1000 + i, t) for i, t in near_copies(seed, 60, 50, 12)]
        assert sorted(map(tuple, ngram_join.linked(docs(rows), threshold=threshold).collect()), key=str) == brute(rows, threshold)
