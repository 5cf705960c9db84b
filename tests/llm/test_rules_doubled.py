from weftgraph.llm import quality_rules


def test_doubled_words_are_rejected(docs):
    doubled = " ".join(w for word in "Of erinly this that river house under seven".split() for w in (word, word.lower()))
    rows = [(1, doubled), (2, doubled + " End"), (3, "Of erinly this this that river house under seven very very long long roads")]
    out = {r.doc_id: r.failed for r in quality_rules.check(docs(rows)).collect()}
    assert out == {1: "repeated_words", 2: "repeated_words", 3: ""}
