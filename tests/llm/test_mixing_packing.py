import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import mixing, packing

from .conftest import CLASHING, ODD, words


def test_rates_reach_the_weights(spark, docs):
    rows = [(i, words(i, 20), "a") for i in range(400)] + [(1000 + i, words(i, 20), "b") for i in range(100)]
    out = mixing.emitted(docs(rows), {"a": 1, "b": 3}).collect()
    tokens = collections.Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
    assert {r.source: round(r.rate, 6) for r in out} == {"a": 0.3125, "b": 3.75}
    assert abs(tokens["b"] / sum(tokens.values()) - 0.75) < 0.03
    by = collections.Counter(r.doc_id for r in out if r.source == "b")
    assert set(by.values()) == {3, 4}


def test_mixing_odd_rows(docs):
    out = mixing.emitted(docs(ODD)).collect()
    again = mixing.emitted(docs(ODD[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.emitted(docs([])).count() == 0
    assert mixing.mixed(docs([(1, ""), (2, None)])).count() == 2
    assert mixing.emitted(docs([(1, "a b"), (2, "c", "t")]), {"t": 1.0}, 0.0).where("source = 's'").count() == 0
    wide = mixing.mixed(docs(ODD, CLASHING))
    assert wide.columns == docs(ODD, CLASHING).columns and wide.count() == len(out)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_places_every_piece_once(histogram):
    runs, bins = packing.plan(histogram, 64)
    load, ranks = collections.Counter(), collections.defaultdict(list)
    for length, lo, hi, first, each in runs:
        for k in range(lo, hi):
            load[first + (k - lo) // each] += length
            ranks[length].append(k)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    assert max(load.values(), default=0) <= 64 and set(load) <= set(range(bins))
    total = sum(s * n for s, n in histogram.items())
    assert bins <= 1.25 * total / 64 + sum(n for s, n in histogram.items() if s > 32) + packing.GROUPS


def test_plan_is_near_the_bound():
    histogram = {s: 1000 + 37 * s for s in range(1, 65)}
    _, bins = packing.plan(histogram, 64, 64)
    bound = max(sum(s * n for s, n in histogram.items()) / 64, sum(n for s, n in histogram.items() if s > 32))
    assert bins <= 1.05 * bound


def test_pack_against_brute_force(docs):
    rows = [(i, words(i, 1 + (i * 37) % 90)) for i in range(300)]
    out = packing.pack(docs(rows), 40).collect()
    want = set()
    for i, text in rows:
        n = len(text.split())
        want |= {(i, p, p * 40, min(40, n - p * 40)) for p in range(-(-n // 40))}
    assert {(r.doc_id, r.piece, r.start, r.n_tokens) for r in out} == want and len(out) == len(want)
    load = collections.Counter()
    for r in out:
        load[r.bin_id] += r.n_tokens
    assert max(load.values()) <= 40
    assert len(load) <= 1.15 * sum(load.values()) / 40 + packing.GROUPS


def test_pack_odd_rows(docs):
    out = packing.pack(docs(ODD, CLASHING), 1000).collect()
    n = sum(len(r[1].split()) for r in ODD if r[1])
    assert sum(r.n_tokens for r in out) == n and {r.doc_id for r in out} == {1, 2, None, 7, 8, 9, 10, 11}
    assert packing.pack(docs([])).count() == 0
    assert packing.pack(docs([(1, None), (2, "")])).count() == 0


def test_missing_column(docs):
    with pytest.raises(ValueError):
        packing.pack(docs([]).drop("text"))
