import itertools
import random

import pyarrow as pa

from weftgraph.llm import exact_dedup, ngram_join

from .conftest import CLASHING, ODD, words


def test_exact_dedup_odd_rows(docs):
    out = exact_dedup.survivors(docs(ODD)).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_copies) for r in out)
    assert got == sorted([((False, 1), 4), ((True, 0), 1), ((False, 3), 1), ((False, 4), 2), ((False, 6), 1), ((True, 0), 1), ((False, 7), 1), ((False, 8), 3), ((False, 11), 1)])
    assert exact_dedup.survivors(docs([])).count() == 0
    wide = docs(ODD, CLASHING)
    kept = exact_dedup.deduplicated(wide)
    assert kept.columns == wide.columns and kept.count() == len(out)


def test_grace_spills_and_recurses(tmp_path):
    rng = random.Random(5)
    rows = [(rng.getrandbits(64) - 2**63, b"x" * 50 + str(i).encode(), i) for i in range(3000)]
    rows += [(h, t, i + 10_000) for h, t, i in rows] + [(rows[0][0], b"same hash, other content", 1)]
    rng.shuffle(rows)
    kind = pa.struct([("a", pa.int32()), ("b", pa.int64()), ("c", pa.int64())])

    def batches():
        for i in range(0, len(rows), 100):
            own = rows[i : i + 100]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own]), pa.array([{"a": 0, "b": r[2], "c": 0} for r in own], kind), pa.array([1] * len(own), pa.int64())], ["h", "t", "r", "n"])

    out = [r for b in exact_dedup.grace(batches(), tmp_path.as_uri(), 2_000) for r in b.to_pylist()]
    assert sorted((r["t"], r["r"]["b"], r["n"]) for r in out) == sorted([(t, i, 2) for _, t, i in rows if i < 3000 and t[0:1] == b"x"] + [(b"same hash, other content", 1, 1)])
    assert not list(tmp_path.iterdir())


def test_table_compares_content():
    table = exact_dedup.Table()
    for i in range(5000):
        assert table.find(7, str(i).encode()) == (i, True) if i < 200 else table.find(i, str(i).encode())[1]
    assert table.find(7, b"3") == (3, False)


def sets(rows, n=ngram_join.N):
    out = {}
    for i, text in rows:
        ws = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower()).split()
        out[i] = {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = words(seed, 300).split()
    rows, shared = [], " ".join(rng.choices(vocab, k=40))
    for i in range(n):
        if rows and rng.random() < 0.5:
            ws = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, len(ws) // 8)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        else:
            ws = rng.choices(vocab, k=rng.randint(1, 60)) + (shared.split() if rng.random() < 0.3 else [])
        rows.append((i, " ".join(ws)))
    return rows


def brute(rows, threshold=ngram_join.THRESHOLD):
    """(doc_id, class_id, n_links) of each row."""
    s = [x for _, x in sorted(sets([(k, t) for k, (_, t) in enumerate(rows)]).items())]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k)), n) for k, ((i, _), n) in enumerate(zip(rows, links))), key=str)


def test_join_against_brute_force(docs):
    for seed, threshold in ((1, 0.6), (2, 0.3), (3, 0.9)):
        rows = corpus(seed)
        got = ngram_join.linked(docs(rows), threshold=threshold).collect()
        want = brute(rows, threshold)
        assert sorted(map(tuple, got), key=str) == want and sum(n for *_, n in want) > 60


def test_join_with_hot_ngrams(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_RANK", 16)
    rows = corpus(6)
    assert sorted(map(tuple, ngram_join.linked(docs(rows)).collect()), key=str) == brute(rows)


def test_join_without_broadcasts(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "small", lambda df: df)
    rows = corpus(7) + ODD
    assert sorted(map(tuple, ngram_join.linked(docs([r[:2] for r in rows])).collect()), key=str) == brute([r[:2] for r in rows])


def test_join_odd_rows(spark, docs):
    want = brute([r[:2] for r in ODD])
    assert sorted(map(tuple, ngram_join.linked(docs(ODD, CLASHING)).collect()), key=str) == want
    assert (None, 1, 3) in want and (None, None, 0) in want and (4, 4, 0) in want
    assert ngram_join.linked(docs([])).count() == 0
    assert [tuple(r) for r in ngram_join.linked(docs([(1, None), (2, ""), (3, "")])).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    twice = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i k"), (2, "a b c d e f g h i j")]
    assert sorted(map(tuple, ngram_join.linked(docs(twice)).collect()), key=str) == brute(twice)
    named = spark.createDataFrame([("x", "one two three four"), ("w", "one two three four"), ("v", None)], "doc_id string, text string")
    assert sorted(map(tuple, ngram_join.linked(named).collect())) == [("v", "v", 0), ("w", "w", 1), ("x", "w", 1)]
    assert sorted(r.doc_id for r in ngram_join.deduplicated(named).collect()) == ["v", "w"]


def test_one_of_each_group_stays(docs):
    rows = corpus(4)
    s = sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = ngram_join.deduplicated(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(x) for x in root})
    wide = docs(ODD, CLASHING)
    out = ngram_join.deduplicated(wide)
    assert out.columns == wide.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, None, 3, 4, 5, 6, None, 7, 8, 11]))
    assert ngram_join.deduplicated(docs([])).count() == 0
