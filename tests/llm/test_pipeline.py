import collections
import itertools
import random

import corpus_pipeline
from weftgraph.llm import mixing, quality_classifier

from .conftest import ODD, words
from .test_dedup import sets
from .test_models import labels, sentences


def write(spark, docs, rows, known, folder):
    docs(rows).write.parquet(str(folder / "documents.parquet"))
    labels(spark, known).write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(9)
    rows = [(i, words(i, rng.randint(20, 60)), rng.choice("ab")) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], "a") for i in range(20)]
    for i in range(20):
        ws = rows[20 + i % 5][1].split()
        ws[rng.randrange(len(ws))] = "changed"
        rows.append((200 + i, " ".join(ws), "b"))
    rows += [(300 + i, sentences(i, 30, junk=True), "b") for i in range(30)]
    known = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(30)]
    folder = write(spark, docs, rows, known, tmp_path)
    got = corpus_pipeline.run(spark, folder).collect()

    judged = {r.doc_id: r.keep for r in quality_classifier.classified(docs(rows), labels(spark, known)).collect()}
    assert all(judged[i] == (i < 300) for i in judged)
    first = {}
    for i, text, source in sorted(rows):
        if judged[i]:
            first.setdefault(text, (i, text, source))
    left = list(first.values())
    s = sets([(i, t) for i, t, _ in left])
    root = {i: i for i, *_ in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    left = [r for r in left if find(r[0]) == r[0]]
    assert {r[0] for r in left} == {i for i in range(60)}
    copies = collections.Counter(r.doc_id for r in mixing.emitted(docs(left)).collect())
    pieces = collections.Counter(r.doc_id for r in got)
    assert pieces == copies
    load = collections.Counter()
    for r in got:
        load[r.bin_id] += r.n_tokens
    assert max(load.values()) <= 2048


def test_stages_with_odd_rows(spark, docs, tmp_path):
    folder = write(spark, docs, ODD, [(1, 1, 0), (None, None, None)], tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs(ODD, ["n", "score"]), folder)
        assert out.columns == docs(ODD, ["n", "score"]).columns and out.count() > 0
        assert stage(spark, docs([]), folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0
