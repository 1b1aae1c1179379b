"""Targets that a corpus cannot meet must not cost it its documents."""

import numpy as np

import corpus_pipeline
from skein.llm.mixing import _reachable, domain_posteriors, mix


def _docs(spark, langs):
    rng = np.random.default_rng(4)
    words = {d: [f"{d}{i}" for i in range(300)] for d in "abcd"} | {"x": [f"x{i}" for i in range(900)]}
    rows = [(i, " ".join([*rng.choice(words["x"], 60), *rng.choice(words[d], 4)]), d) for i, d in enumerate(langs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_absent_targets(spark):
    docs = _docs(spark, ["a" if i % 3 else "b" for i in range(400)])
    labelled = docs.where("doc_id < 300").select("doc_id", "lang").withColumnRenamed("lang", "domain")
    out = mix(docs, labelled, {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}).collect()
    assert len(out) == 400 and all(0.2 < r.rate < 5 for r in out)
    total = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in out)
    assert abs(total[0] / (total[0] + total[1]) - 2 / 3) < 1e-3


def test_minor_targets(spark):
    docs = _docs(spark, ["c" if i % 100 == 0 else "a" if i % 3 else "b" for i in range(600)])
    labelled = docs.where("doc_id < 300").select("doc_id", "lang").withColumnRenamed("lang", "domain")
    out = mix(docs, labelled, {"a": 0.4, "b": 0.3, "c": 0.3}).collect()
    assert sum(r.rate == 0 for r in out) <= 6
    share, mass = np.array([0.4, 0.3, 0.3]), np.array([60.0, 38, 2])
    every = np.ones(3, bool)
    assert _reachable(every, share, mass, mass * 0.2).tolist() == [True, True, False]
    assert _reachable(every, share, mass, mass * 0.9).tolist() == [True, True, True]  # clear enough to be weighted up
    assert _reachable(np.array([True, False, True]), share, mass, mass * 0.9).tolist() == [True, False, True]


def test_stage_keeps_rate_0(spark, monkeypatch, tmp_path):
    docs = _docs(spark, ["a", "b"])
    docs.selectExpr("doc_id", "1 quality", "0 toxic").write.parquet(f"file://{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "mix", lambda d, labelled, targets: d.selectExpr("*", "64L n_tokens", "cast(doc_id as double) rate"))
    assert corpus_pipeline.mixing(spark, docs, f"file://{tmp_path}").count() == 2


def test_tokens_without_a_split(spark):
    """Words are counted where they are scored: no regular expression goes over the texts a second time."""
    docs = spark.createDataFrame([(1, "One  two\tthree\x0bfour"), (2, None), (3, " \n"), (4, "x y z")], "doc_id long, text string")
    out = domain_posteriors(docs, docs.where("doc_id < 0").selectExpr("doc_id", "text as domain"), ["de", "en"])
    assert out.columns == ["doc_id", "text", "n_tokens", "posterior"]
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {1: 4, 2: 0, 3: 0, 4: 2}
    assert "split(" not in out._jdf.queryExecution().toString()
