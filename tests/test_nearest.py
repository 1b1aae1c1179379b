"""Block-wise cosine search: odd rows, ties, and columns that stay."""

import re
from collections import Counter

import numpy as np

from skein.operators import retrieval
from skein.operators.retrieval import nearest


def test_odd_rows_and_ties(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [1.0, None], "c"), (4, [0.0, 0.0], "d"), (5, [3.0], "e"), (6, [2.0, 4.0], "f"), (7, [-1.0, 0.5], "g"), (8, [], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, similar string").repartition(3)
    got = nearest(df, [1.0, 2.0], 3).collect()
    assert [(r.vec_id, r.similar) for r in got] == [(1, "a"), (6, "f"), (7, "g")]
    assert [r.vec_id for r in nearest(df, [1.0, 2.0], 8).collect()] == [1, 6, 7, 2, 3, 4, 5, 8]
    assert [r.vec_id for r in nearest(df, [1.0, 2.0], 9, least=0.5).collect()] == [1, 6]
    assert np.isnan(nearest(spark.createDataFrame([(1, [nan, 1.0])], "vec_id long, embedding array<double>"), [1.0, 1.0], 1).first().similarity)
    assert nearest(df.limit(0), [1.0, 2.0], 3).collect() == []


def test_against_numpy(spark):
    x = np.random.default_rng(1).standard_normal((500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for q in x[:3]:
        sim = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
        got = nearest(df, q, 20).collect()
        assert [r.vec_id for r in got] == np.lexsort((np.arange(500), -sim))[:20].tolist() and np.allclose([r.similarity for r in got], np.sort(sim)[::-1][:20])


def test_similar_texts_adds_pairs_where_docs_are(spark, monkeypatch):
    """No pair of a query and a doc is shuffled before the first k of each task; the same pairs as by brute force."""
    words = [["alpha", "beta"], ["beta", "gamma", "gamma"], ["delta"], [], ["alpha", "delta", "beta"], ["gamma"]]
    docs = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "id string, tokens array<string>")
    queries = spark.createDataFrame([("q1", ["alpha", "beta"]), ("q2", ["gamma", "delta"]), ("q3", [])], "id string, tokens array<string>")
    monkeypatch.setattr(retrieval, "PAIRS", 4)
    found = retrieval.similar_texts(queries, docs, 2)
    assert not re.search(r"hashpartitioning\(query#\d+, id", found._jdf.queryExecution().toString())

    def vector(tokens):
        v = Counter()
        for t in tokens:
            h = 0
            for c in t:
                h = (h * 31 + ord(c)) % 256
            v[h] += 1
        norm = sum(n * n for n in v.values()) ** 0.5
        return {b: n / norm for b, n in v.items()}

    want = []
    for name, tokens in (("q1", ["alpha", "beta"]), ("q2", ["gamma", "delta"]), ("q3", [])):
        q = vector(tokens)
        scores = [(-round(sum(w * q.get(b, 0) for b, w in vector(d).items()), 9), str(i)) for i, d in enumerate(words)]
        want += [(name, i, -s) for s, i in sorted(x for x in scores if x[0] < 0)[:2]]
    assert sorted((r["query"], r["id"], round(r["similarity"], 9)) for r in found.collect()) == sorted(want)
