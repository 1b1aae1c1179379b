"""The trigram index against a scan: same rows for any term, and few texts looked at."""

import re

import numpy as np
from pyspark.sql import functions as F

from skein.operators import trigrams as G


def table(spark, texts):
    return spark.createDataFrame([(t, i, "g") for i, t in enumerate(texts)], "text string, doc_id long, gram string").repartition(5)


def test_same_rows_as_a_scan(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abAB éÉßİςΣ日"), int(rng.integers(0, 60)))) for _ in range(400)] + [None, "", "ab", "x" * 60_000 + "needle" + "y" * 60_000, "needle", "needle"]
    docs = table(spark, texts).union(table(spark, [None] * 3 + ["a repeated id with a needle"]))
    index = G.build_trigrams(docs, 8)
    held = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for terms in (["needle"], ["aBa"], ["éÉß"], ["Σς", "日a"], ["abab", "BABA", "nothing like it"], ["ab"], ["zzz"], [texts[3]], []):
        got = sorted((r.doc_id, r.text) for r in G.containing(docs, index, terms).collect())
        assert got == sorted((i, t) for i, t in held if t is not None and any(x in t for x in terms)), terms


def test_few_texts_are_looked_at(spark):
    """A rare term among texts that share most grams: candidates are those that hold it, and two buckets of 16 are read."""
    docs = table(spark, [f"the common words of all texts, number {i}" + (" Widerruf" if i % 100 == 7 else "") for i in range(2000)])
    index = G.build_trigrams(docs, 16)
    assert G.candidates(spark, index, "Widerruf").count() == 20
    assert G.candidates(spark, index, "number 1234").count() <= 30
    one = G.postings_of(spark, index, "rru")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", plan) and "EqualTo(gram,rru)" in plan
    assert one.count() == 20 and {f.split("bucket=")[1].split("/")[0] for (f,) in one.select(F.input_file_name()).distinct().collect()} == {re.search(r"bucket#\d+ = (\d+)", plan)[1]}


def test_empty_table(spark):
    docs = table(spark, []).limit(0)
    index = G.build_trigrams(docs, 4)
    assert G.containing(docs, index, ["abc"]).collect() == []
