import random

from weftgraph.llm import langid


def text(rng, alphabet, n=12):
    return " ".join("".join(rng.choices(alphabet, k=5)) for _ in range(n))


def test_rare_languages_are_labelled(docs):
    rng = random.Random(4)
    rows = [(i, text(rng, "abcde"), "s", "aa") for i in range(600)] + [(600 + i, text(rng, "vwxyz"), "s", "zz") for i in range(6)]
    # More rows without an id, and repeated ones, than the sample takes.
    rows += [(None, text(rng, "klmno"), "s", "nn") for _ in range(40)] + [(700, text(rng, "pqrst"), "s", "rr")] * 200
    model = langid.model_for(docs(rows), sample=20, steps=60)
    assert model[0] == ["aa", "nn", "rr", "zz"]
    fresh = [(i, text(rng, a), "s", None) for i, a in enumerate(["abcde", "klmno", "pqrst", "vwxyz"] * 5)]
    out = {r.doc_id: r.language for r in langid.identified(docs(fresh), model).collect()}
    assert all(out[i] == ["aa", "nn", "rr", "zz"][i % 4] for i in out) and len(out) == 20


def test_sample_is_drawn_per_language(docs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, text(rng, "abcde", 3), "s", "aa") for i in range(3000)] + [(3000 + i, text(rng, "vwxyz", 3), "s", "zz") for i in range(30)] + [(4000, "vwx yz", "s", "yy")]
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels, languages, **_: seen.append([labels.count(k) for k in range(languages)]))
    langid.model_for(docs(rows), sample=50)
    monkeypatch.setattr(langid, "MOST", 60)
    langid.model_for(docs(rows), sample=50)
    assert seen == [[50, 1, 30], [20, 1, 20]]
