import random
import re

import pytest

from weftgraph.llm import secrets

HEX = "9233A8EC" * 5


def test_capitals_are_found(docs):
    rows = [(1, f'TOKEN = "{HEX}"!!'), (2, 'API_KEY="abcdefgh1234"'), (3, "Password: 'hunter2hunter2'"), (4, 'toKen="abcdefgh1234" Key'), (5, HEX.lower())]
    found = {(r.doc_id, r.rule, r.start) for r in secrets.scan(docs(rows)).collect()}
    assert found == {(1, "assigned", 0), (1, "hex_key", 9), (2, "assigned", 0), (3, "assigned", 0), (4, "assigned", 0), (5, "hex_key", 0)}


@pytest.mark.parametrize("pattern", ["(?i)password", "(?i)a(?:bcd|xyz)e", "[Tt][Oo][Kk][Ee][Nn]", "x(?i:Token)y", "(?i)éabcd", "(?i)[st]ure"])
def test_folded_queries_miss_nothing(pattern):
    fold, query = secrets.ask(pattern)
    rng, words = random.Random(3), ["password", "abcde", "axyze", "token", "xtokeny", "xToKeNy", "éabcd", "sure", "ture", "passw0rd"]
    odd = {"s": "ſ", "k": "K", "i": "İ"}
    hits = 0
    for _ in range(2000):
        text = "".join(rng.choice([c, c.upper(), odd.get(c, c)]) for c in rng.choice(words))
        low = text.encode().lower()
        holds = lambda q: q is True or (q[1] in low if q[0] == "tri" else (all if q[0] == "and" else any)(map(holds, q[1])))
        if re.search(pattern, text):
            hits += 1
            assert holds(query), text
    assert fold and query is not True and hits


def test_caseless_rules_against_brute_force(docs):
    rules = {"folded": "(?i)needle[0-9]+", "plain": "needle[0-9]+"}
    rows = [(1, "NEEDLE7 needle8"), (2, "Needle"), (3, "é nEEdle9 Needle10")] + [(10 + i, "hay") for i in range(30)]
    want = {(i, k, m.start()) for i, t in rows for k, p in rules.items() for m in re.finditer(p, t)}
    assert {(r.doc_id, r.rule, r.start) for r in secrets.scan(docs(rows), rules).collect()} == want and len(want) == 5


def test_assigned_is_indexed():
    fold, query = secrets.ask(secrets.RULES["assigned"])
    assert fold and query is not True and b"tok" in secrets.vocabulary(query)
