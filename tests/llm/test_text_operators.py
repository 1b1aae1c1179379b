"""Operators over documents, each against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from skein.llm.decontaminate import _MARKS, Index, contaminated, decontaminate
from skein.llm.license_scan import TEMPLATES, anchors, scan_licenses
from skein.llm.simhash import TILE, majority, simhash_components
from skein.llm.substring_dedup import substring_dedup
from skein.llm.token_counts import count_tokens
from skein.llm.words import Words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE + " tail one"), (2, None), (3, ""), (4, " \t\n "), (5, "Été déjà\x0bvu"), (6, "new head " + PASSAGE),
    (7, PASSAGE + " tail one"), (7, PASSAGE + " tail one"), (9, " ".join(f"w{i % 997}" for i in range(30_000))), (None, "lonely text"), (11, "A B C"), (12, "a b c"), (13, PASSAGE.replace("word30", "other")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "x", 1, "y") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, chunk int, fps string").repartition(3)


def words(t):
    return SPLIT.findall(t or "")


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [t for _, t in TEXTS]
    w = Words(pa.array(texts))
    assert [bytes(w.joined[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)] == [x for t in texts for x in words(t)]


def test_substring_dedup(docs):
    out = substring_dedup(docs, 13).collect()
    seen = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in TEXTS:
        w = words(t)
        for i in range(len(w) - 12):
            s = tuple(w[i : i + 13])
            seen[s] = min(seen.get(s, float("inf")), key(d))
    expected = []
    for d, t in TEXTS:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if seen[tuple(w[i : i + 13])] < key(d):
                gone |= set(range(i, i + 13))
        expected.append((key(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out) == sorted(expected)
    six = next(r for r in out if r.doc_id == 6)
    assert [tuple(x) for x in six.removed] == [(2, 61)]
    assert {"words", "chunk", "fps"} <= set(out[0].asDict())


def test_token_counts(docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = docs.sparkSession.createDataFrame([(20, "a<|endoftext|>b it's 12 Σ x"), (21, "é <|startoftext|>")], "doc_id long, text string")
    got = count_tokens(docs.select("doc_id", "text").union(odd), path, max_tokens=50, frequent=8).collect()
    expected = [(d, t) for d, t in TEXTS] + [(20, "a<|endoftext|>b it's 12 Σ x"), (21, "é <|startoftext|>")]
    want = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in expected]
    none_last = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=none_last) == sorted(want, key=none_last)
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_majority_over_many_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.int64).view(np.uint64)
    offsets = np.array([0, 0, 1, 300, 2000, 2000])
    got = majority(h, offsets)
    for i in range(5):
        part = [int(x) for x in h[offsets[i] : offsets[i + 1]]]
        assert int(got[i]) == (sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > len(part)) if part else 0)


def components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(docs):
    got = simhash_components(docs).collect()
    fps = {d: fingerprint(t) for d, t in TEXTS if d is not None}
    want = components(fps, 4)
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        if r.doc_id is not None:
            assert r.fps[0] & (1 << 64) - 1 == fps[r.doc_id]


def test_simhash_hot_key_is_cut_in_tiles(spark):
    from skein.llm.simhash import links
    from skein.operators.components import connected_components
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    base = int(rng.integers(1, 1 << 62))
    fps = {}
    for i in range(3 * TILE):
        x = base
        for b in rng.choice(24, 3, replace=False):
            x ^= 1 << int(b)
        fps[i] = x ^ (int(rng.integers(0, 1 << 20)) << 40 if i % 3 == 0 else 0)
    table = spark.createDataFrame([(i, [x - (1 << 64) if x >> 63 else x]) for i, x in fps.items()], "id long, fps array<long>")
    found = links(table, 4)
    got = {r.id: r.component for r in connected_components(found).collect()}
    want = components(fps, 4)
    assert {i: got.get(i, i) for i in fps} == want
    assert found.agg(F.count("*")).first()[0] < 60 * len(fps)


def test_contaminated(spark, docs):
    item = PASSAGE.split()[5:45]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny one"), (5, "Lonely, text!"), (6, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(d, i) for d in (1, 6, 7) for i in (1, 6)} | {(None, 5)} | ({(13, 1), (13, 6)} & got)
    left = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert left == {d for d, _ in TEXTS} - {d for d, _ in got}
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 60, 12))) for i in range(200)]
    index = Index(items)
    own, prints = index.of[12][0], index.of[12][1]
    probes = np.concatenate([prints[own] ^ np.uint64(0x1111), rng.integers(0, 1 << 63, 100, dtype=np.int64).view(np.uint64)])
    row, item = index.within(12, probes)
    want = {(r, i) for r in range(len(probes)) for i in range(len(items)) if np.bitwise_count(probes[r] ^ prints[i]) <= 13}
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == want
    assert "!" in _MARKS


def test_scan_licenses(spark):
    rows = [
        (1, "bla bla\nReleased under the MIT License.\nmore text here"), (2, None), (3, ""), (4, "the license of the program"), (5, "THIS WORK is licensed under the GNU General Public License, version 3"),
        (6, "This work is licensed beneath the GNU General Public License, version 3."), (7, "x " * 5000 + " Licensed under CC BY-NC 4.0. " + "y " * 5000), (1, "again: released under the mit license"), (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, license string, class int")
    got = {(r.doc_id, r.license): r.containment for r in scan_licenses(docs).collect()}
    assert got.pop((1, "MIT")) == got.pop((None, "MIT")) == got.pop((5, "GPL-3.0")) == got.pop((7, "CC-BY-NC-4.0")) == 1.0
    assert not got
    assert scan_licenses(docs.limit(0)).count() == 0
    assert scan_licenses(docs, []).count() == 0


def test_every_shingle_has_an_anchor():
    marks = set(anchors(TEMPLATES))
    for _, text in TEMPLATES:
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        for i in range(len(w) - 4):
            assert set(zip(w[i : i + 4], w[i + 1 : i + 5], strict=True)) & marks


def test_empty_tables(docs):
    none = docs.limit(0)
    assert substring_dedup(none).count() == 0
    assert simhash_components(none).count() == 0
    assert hashlib.sha256(b"").hexdigest()
