"""The pipeline's stages on a small corpus with planted cases."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    vocab = [f"term{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    docs = [[i, text(120)] for i in range(300)]
    item, passage = text(40), text(70)
    docs[10][1] += " " + item
    docs[20][1] += " " + passage
    docs[30][1] += " " + passage
    docs[41][1] = docs[40][1]
    near = docs[50][1].split()
    near[60] = "changed"
    docs[51][1] = " ".join(near)
    labels = []
    for i in range(100, 300):
        toxic = i % 5 == 0
        if toxic:
            docs[i][1] += " vileword stinker"
        labels.append((i, 1, int(toxic)))
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t)) for i, t in docs]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_run(spark, sf_dir):
    path, passage = sf_dir
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    toxic = {i for i in range(100, 300) if i % 5 == 0}
    gone = {10, 41, 51} | toxic
    assert not gone & set(out)
    assert len(set(range(300)) - gone - set(out)) <= 3
    assert passage in out[20].text and passage not in out[30].text
    assert all(r.rate > 0 for r in out.values())
    assert len(corpus_pipeline.STAGES) == 5
