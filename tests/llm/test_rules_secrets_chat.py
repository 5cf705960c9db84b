import re

import pytest

from weftgraph.llm import chat, quality_rules, secrets

from .conftest import CLASHING, ODD


def test_rules_judge(docs):
    rows = [
        (1, "The cat sat on the mat and it was warm in the sun for a while."), (2, "AND!! THE!! BIG!! CAT!! IS!! HERE!!"), (3, "word$$$ other### the%%% of&&& and***"),
        (4, "one | two | three | the | four | and"), (5, "the the the the the the of of of of"),
    ]
    out = {r.doc_id: r.failed.split(",") for r in quality_rules.check(docs(rows)).collect()}
    assert out[1] == [""] and "capitals" in out[2] and "symbols" in out[3] and "bars" in out[4] and "repeated_words" in out[5]


def test_rules_use_no_user_functions(docs):
    plan = quality_rules.check(docs(ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_odd_rows(docs):
    out = quality_rules.check(docs(ODD, CLASHING)).collect()
    assert len(out) == len(ODD) and all(r.failed is not None and r.n_words is not None for r in out)
    assert not any(r.keep for r in out if r.doc_id in (3, 4, 5, 6))
    assert quality_rules.check(docs([])).count() == 0


@pytest.mark.parametrize(
    "pattern, text, hit",
    [("abc(?:de|fg)hi", "xx abcfghi", True), ("abc(?:de|fg)hi", "xx abcxxhi", False), ("[ab]cde", "acdx bcde", True), ("(?:foo)+bar", "foobar", True), ("x{3,5}yz", "xxxyz", True), ("ab?cde", "acde", True)],
)
def test_trigram_queries_miss_nothing(pattern, text, hit):
    query = secrets.trigram_query(pattern)
    assert query is not True and bool(re.search(pattern, text)) == hit
    holds = lambda q: q is True or (q[1].decode() in text if q[0] == "tri" else (all if q[0] == "and" else any)(map(holds, q[1])))
    assert holds(query) or not hit


def test_rules_without_trigrams_scan_everything(docs):
    assert secrets.trigram_query("[0-9]{3}-[0-9]{2}") is True and secrets.trigram_query("(?i)abcdef") is True
    assert secrets.trigram_query("a.*") is True
    rows = [(1, "call 123-45 or 987-65"), (2, "nothing")]
    out = secrets.scan(docs(rows), {"n": "[0-9]{3}-[0-9]{2}"}).collect()
    assert [(r.doc_id, r.match_no, r.start, r.length) for r in sorted(out, key=lambda r: r.start)] == [(1, 1, 5, 6), (1, 2, 15, 6)]


def test_scan_against_brute_force(docs):
    key = "AKIA" + "A1B2" * 4
    rows = [(1, f"é {key} and {key} é"), (2, f'token = "abcdefgh12345678" {"0af3" * 10}'), (3, "AKIA short"), (4, "é" * 500 + " ghp_" + "a1" * 18)] + [(100 + i, f"filler {i} AKI KIA") for i in range(50)]
    want = {(i, name, m.start(), m.end() - m.start()) for i, t in rows for name, p in secrets.RULES.items() for m in re.finditer(p, t)}
    assert {(r.doc_id, r.rule, r.start, r.length) for r in secrets.scan(docs(rows)).collect()} == want and len(want) == 5
    assert secrets.scan(docs(ODD, CLASHING)).count() == 0 and secrets.scan(docs([])).count() == 0
    assert secrets.scan(docs([(None, key), (7, key), (7, key)])).count() == 3


def test_chat(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d"), (2, None, None, None), (2, 0, "user", ""), (None, 0, "user", "x"), (None, 1, "user", "w"), (3, 1, "user", "z"), (3, 1, "user", "z"), (3, 1, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "extra", "more") for r in rows], "conv_id long, turn long, role string, text string, n string, ts string")
    out = {r.conv_id: (r.n_turns, r.n_messages, r.text) for r in chat.formatted(turns).collect()}
    assert out[1] == (4, 3, "<|system|>\na<|end|>\n<|user|>\nb\nc<|end|>\n<|assistant|>\nd<|end|>\n")
    assert out[2] == (2, 1, "<|user|>\n\n<|end|>\n")
    alone = sorted((r.n_turns, r.n_messages, r.text) for r in chat.formatted(turns).collect() if r.conv_id is None)
    assert alone == [(1, 1, "<|user|>\nw<|end|>\n"), (1, 1, "<|user|>\nx<|end|>\n")]
    assert out[3] == (3, 2, "<|assistant|>\ny<|end|>\n<|user|>\nz\nz<|end|>\n")
    assert chat.formatted(turns.limit(0)).count() == 0
    long = spark.createDataFrame([(9, i, "user" if i % 3 else "assistant", "t" * 10) for i in range(5000)], "conv_id long, turn long, role string, text string")
    assert chat.formatted(long).first().n_messages == 3334 or chat.formatted(long).first().n_turns == 5000
