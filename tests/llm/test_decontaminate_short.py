"""Texts of fewer words than the item they are."""

import numpy as np

from skein.llm.decontaminate import _shingles, contaminated, decontaminate, similarity


def test_truncated_items(spark):
    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(3000)]
    items = [list(rng.choice(vocab, 40)) for _ in range(60)]
    items[7] = items[7][:20] * 2  # repeated shingles weigh more
    texts = [(100 * k + 2 * cut + front, w[cut:] if front else w[: len(w) - cut]) for k, w in enumerate(items) for cut in range(1, 12) for front in (0, 1)]
    docs = spark.createDataFrame([*((i, " ".join(w)) for i, w in texts), (9000, "v1 v2"), (9001, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    made = [_shingles([x.encode() for x in w]) for w in items]
    want = {}
    for i, w in texts:
        sim = similarity(_shingles([x.encode() for x in w]), made[i // 100])
        if sim >= 0.8:
            want[i, i // 100, 0, len(w)] = sim
    assert all((100 * k + 2 * cut, k, 0, 40 - cut) in want for k in (0, 1, 2) for cut in range(1, 6))
    got = {(r.doc_id, r.item_id, r.first_word, r.n_words): r.similarity for r in contaminated(docs, bench).collect()}
    assert got == want
    left = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert left == {i for i, _ in texts} - {i for i, *_ in want} | {9000, 9001}
