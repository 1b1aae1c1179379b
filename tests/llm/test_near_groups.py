"""Groups of texts that are nearly similar, all with all: what is compared, and by which steps."""

import numpy as np

from skein.llm import simhash


def test_groups_that_stay_apart(spark, monkeypatch):
    """Versions that share each of their edits with others, at similarities of 0.6 to 0.8: few pairs are left for the sets to decide."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(240):
        words = list(base)
        for at in rng.choice(300, 4, replace=False):  # each edit stands in three versions or so
            words[int(at) % 150] = f"edit{at}"
        texts.append(" ".join(words))
    sets = [{t[i : i + 5] for t in [tuple(x.split())] for i in range(146)} for x in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    written, pivoted = [], []
    materialize, links = simhash.materialize, simhash.links

    def counted(df, name="t"):
        out = materialize(df, name)
        written.append((name, out[0].count()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "links", lambda classes, radius: pivoted.append(radius) or links(classes, radius))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 100
    assert sum(n for name, n in written if name == "pairs") < len(texts) ** 2 / 8
    assert pivoted == [simhash.RADIUS]


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(6)
    for n in (3, 40, 700, 30000):
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = np.append(common, rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)), np.append(common, rng.integers(0, 1 << 63, n // 7, dtype=np.uint64))
        x, y = simhash._sketches(np.append(a, b), np.array([0, len(a), len(a) + len(b)])).astype(int)
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_groups_are_compared_some_at_a_time(spark, monkeypatch):
    """Rows that one task holds are not all compared at once: pairs held are bounded, whatever the groups."""
    monkeypatch.setattr(simhash, "HELD", 100)
    rows = spark.range(60).selectExpr("id", "0 as cut", "id div 6 as key", "id as x").coalesce(1)

    def solve(table, group, side):
        assert len(set(zip(table.column("key").to_pylist(), group.tolist(), strict=True))) == len(set(group.tolist()))
        return table.select(["id"]).append_column("n", [[table.num_rows] * table.num_rows]).combine_chunks().to_batches()[0]

    seen = simhash._dealt(rows, "x", ["x"], solve, "id long, n long").collect()
    assert sorted(r.id for r in seen) == list(range(60))
    assert all(r.n <= 12 for r in seen)
