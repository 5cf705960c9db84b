from weftgraph.llm import secrets


def test_long_secrets_are_covered_whole(docs):
    part = "aB3_" * 75
    rows = {
        1: f'token = "{"x1" * 60}"',
        2: "password: 'c2VjcmV0c2VjcmV0cw=='",
        3: f"ftp://{'u' * 50}:{'p4' * 40}@",
        4: f"eyJ{part}.eyJ{part}.{part}",
        5: "eyJhbGciOiJub25l.eyJzdWIiOiIxMjM0",
        6: "xoxb-" + "g1" * 40,
        7: "sk_live_" + "g1" * 50,
    }
    found = {(r.doc_id, r.rule, r.start, r.length) for r in secrets.scan(docs(list(rows.items()))).collect()}
    names = {1: "assigned", 2: "assigned", 3: "basic_auth", 4: "jwt", 5: "jwt", 6: "slack_token", 7: "stripe_key"}
    assert found == {(i, names[i], 0, len(t)) for i, t in rows.items()}


def test_signature_ends_with_the_token(docs):
    token = "eyJhbGciOiJub25l.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl"
    out = secrets.scan(docs([(1, f"It is {token}. And more"), (2, "It is eyJhbGciOiJub25l.eyJzdWIiOiIxMjM0. And more")])).collect()
    assert {(r.doc_id, r.start, r.length) for r in out} == {(1, 6, len(token)), (2, 6, len(token) - 13)}
