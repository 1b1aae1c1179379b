"""Near-duplicates by exact shingle similarity against brute force: appended, cut and edited copies."""

import numpy as np

from skein.llm.simhash import near_duplicate_components


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(4000)]

    def shingles(text):
        words = text.lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    def similarity(a, b):
        x, y = shingles(a), shingles(b)
        return len(x & y) / len(x | y)

    def copy(words, kind):
        words, more = list(words), int(len(words) * rng.uniform(0.02, 0.35))
        if kind == 0:
            return words + list(rng.choice(vocab, more))
        if kind == 1:
            return words[: len(words) - more]
        for at in rng.choice(len(words), max(1, more // 8), replace=False):
            words[at] = "edited"
        return words

    pairs = []
    for k in range(900):
        words = list(rng.choice(vocab, int(rng.integers(120, 400))))
        pairs.append((" ".join(words), " ".join(copy(words, k % 3))))
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    # repeats count once: similarity 1 although most words of one text are repeats
    line = " ".join(rng.choice(vocab, 30))
    rows += [(5000, line + " " + line), (5001, " ".join([line] * 40)), (6000, None), (6001, " "), (None, line), (7000, "Two words"), (7001, "two  WORDS"), (7002, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [(r.doc_id, r.component_id) for r in near_duplicate_components(docs).collect()]
    assert len(out) == len(rows) and (None, None) in out
    got = dict(out)
    want = [similarity(*p) >= 0.8 for p in pairs]
    have = [got[2 * k + 1] == 2 * k for k in range(len(pairs))]
    assert all(got[2 * k] == 2 * k for k in range(len(pairs)))
    assert not [k for k in range(len(pairs)) if have[k] and not want[k]]
    for kind in range(3):
        of = [k for k in range(kind, len(pairs), 3) if want[k]]
        assert len(of) > 80 and sum(have[k] for k in of) >= 0.99 * len(of)
    assert [got[i] for i in (5000, 5001, 6000, 6001, 7000, 7001, 7002)] == [5000, 5000, 6000, 6000, 7000, 7000, 7002]


def test_clusters_of_many_versions(spark):
    """Dense groups of candidates: a chain of drifting versions, versions of one text, and two clusters that are only half alike."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(5000)]
    texts, now = [], list(rng.choice(vocab, 200))
    for _ in range(60):  # each differs from the last by a few words, the ends from each other by most
        texts.append(" ".join(now))
        now[int(rng.integers(0, 200))] = str(rng.choice(vocab))
    base = list(rng.choice(vocab, 200))
    other = base[:110] + list(rng.choice(vocab, 90))
    for of in (base, other):
        for _ in range(120):
            words = list(of)
            words[int(rng.integers(0, 200))] = str(rng.choice(vocab))
            texts.append(" ".join(words))

    def shingles(text):
        words = text.split()
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicate_components(docs).collect()}
    assert got == dict(enumerate(root))
    assert len(set(root)) == 3
