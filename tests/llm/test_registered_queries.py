"""The registered queries themselves: against their SQL on the supplied tables, or against brute force on a small folder of tables."""

import os
import re
import string
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

from skein.llm import queries as llm
from skein.llm.license_scan import TEMPLATES

SUPPLIED = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not Path(SUPPLIED).exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SUPPLIED}/{t}.parquet')")
    ran = con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in ran.description]
    want = ran.fetchall()
    got = llm.queries()[name](spark, SUPPLIED)
    assert set(names) <= set(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables with copies, altered benchmark items and altered notices; texts that are null, blank and long."""
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list(string.ascii_lowercase), int(rng.integers(2, 9)))) for _ in range(2500)]
    text = lambda n: " ".join(rng.choice(vocab, n))

    def altered(words, n):
        words = list(words)
        for at in rng.choice(len(words), n, replace=False):
            words[int(at)] = str(rng.choice(vocab))
        return " ".join(words)

    items = [text(int(rng.integers(25, 60))) for _ in range(12)]
    docs = [text(int(rng.integers(30, 200))) for _ in range(240)]
    for i in range(0, 60):
        docs[i] += " " + altered(items[i % 12].split(), i // 24) + " " + text(15)
    for i in range(60, 120):
        notice = TEMPLATES[i % len(TEMPLATES)][1]
        docs[i] = docs[i] + "\n" + (notice if i % 2 else notice.upper()) + "\n" + text(20)
    for i in range(120, 140):
        docs[i] = docs[i - 20]
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t)) for i, t in enumerate(docs)]
    rows += [(900, None, "en", "s", 0), (901, " \n", "de", "s", 2), (902, " ".join(f"x{i % 4999}" for i in range(40_000)), "en", "s", 9), (903, "A b", "en", None, 3), (904, "a B", "en", "s", 3)]
    labels = [(i, int(i % 7 > 0), int(i % 11 == 0)) for i in range(0, 240, 2)]
    path = str(tmp_path_factory.mktemp("made"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r[1] for r in rows}, dict(enumerate(items))


def test_op3(spark, made):
    path, docs, _ = made
    got = llm.op3_quality(spark, path)
    rows = got.collect()
    assert {"doc_id", "expected_grade", "tail_probability"} <= set(got.columns)
    assert {r.doc_id for r in rows} <= set(docs) and len({r.doc_id for r in rows}) == len(rows)
    assert all(0.5 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_op6(spark, made):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in llm.op6_token_counts(spark, made[0]).collect()}
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in made[1].items()}
    assert got == {i: (b, n, n > 2048) for i, (b, n) in want.items()}


def test_op7(spark, made):
    def fingerprint(t):
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = {i: fingerprint(t) for i, t in made[1].items()}
    root = {i: i for i in fps}
    for i in sorted(fps):
        for j in sorted(fps):
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in llm.op7_simhash(spark, made[0]).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_pivots_discard_most_pairs():
    """Share of random pairs that the table of reference distances discards; what is linked is never discarded."""
    from skein.llm.simhash import REFERENCES, kept_by_pivots

    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    table = np.bitwise_count(np.concatenate([fp, near])[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    a, b = rng.integers(0, 2000, 20_000), rng.integers(0, 2000, 20_000)
    a, b = a[a != b], b[a != b]
    assert len(kept_by_pivots(table, a, b, 4)[0]) < 0.01 * len(a)
    assert len(kept_by_pivots(table, np.arange(2000), np.arange(2000, 4000), 4)[0]) == 2000


def shingles(words):
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def test_op8(spark, made):
    """Every notice whose shingles stand together in a text, by trying every place; recall and precision."""
    plain = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for i, t in made[1].items():
        words = plain(t)
        for name, template in TEMPLATES:
            wanted = shingles(plain(template))
            n = len(plain(template))
            slack = -(-n // 4)
            places = [p for p in range(len(words) - 4) if " ".join(words[p : p + 5]) in wanted]
            if any(len(shingles(words[max(0, p - n) : p + n + slack]) & wanted) >= 0.8 * len(wanted) for p in places):
                want.add((i, name))
    got = {(r.doc_id, r.license) for r in llm.op8_license_scan(spark, made[0]).collect()}
    assert len(want) >= 60 and got <= want and len(got) >= 0.99 * len(want)


def test_op9(spark, made):
    """Every window of an item's length over every text, by weighted shingle similarity; recall and precision."""
    marks = "".join(c for c in string.punctuation)
    plain = lambda t: [w.strip(marks) or w for w in SPLIT.findall((t or "").lower())]

    def weighted(words):
        count = Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        return {s: c * len(s) for s, c in count.items()}

    def similarity(a, b):
        low = sum(min(w, b[s]) for s, w in a.items() if s in b)
        return low / (sum(a.values()) + sum(b.values()) - low)

    want = set()
    for j, item in made[2].items():
        own = plain(item)
        goal = weighted(own)
        for i, t in made[1].items():
            words = plain(t)
            hits = [p for p in range(len(words) - 4) if " ".join(words[p : p + 5]) in goal]
            starts = {s for p in hits for s in range(max(0, p - len(own)), min(p + 5, len(words) - len(own) + 1))}
            if any(similarity(weighted(words[s : s + len(own)]), goal) >= 0.8 for s in starts):
                want.add((i, j))
    got = {(r.doc_id, r.item_id) for r in llm.op9_decontaminate(spark, made[0]).collect()}
    assert len(want) >= 30 and got <= want and len(got) >= 0.95 * len(want)


def test_op10(spark, made):
    out = llm.op10_mixing(spark, made[0])
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(made[1]) and all(r.rate >= 0 for r in rows)
    words = {i: len(SPLIT.findall(t or "")) for i, t in made[1].items()}
    assert all(r.n_tokens == words[r.doc_id] for r in rows)
    p = np.array([r.posterior for r in rows])
    assert np.allclose(p.sum(axis=1), 1)


def test_long_repeated_passage_stays_bounded(spark):
    """op9 on one text of 400 000 words that repeats a shared shingle: all matches, in blocks of windows."""
    from skein.llm.decontaminate import contaminated

    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(["q0 q1 q2 q3 q4 other"] * 60_000 + [item] + ["q0 q1 q2 q3 q4 other"] * 5_000)
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.similarity) for r in got] == [(1, 7, 360_000, 1.0)]


def test_bytes_a_window_do_not_grow_with_buckets():
    """op5: what a chunk sends for each window as buckets grow in number."""
    from skein.llm.substring_dedup import _encode

    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 64, 200_000, dtype=np.uint64))
    least = rng.integers(0, 400, len(values))
    sent = {}
    for bits in (7, 13):
        bounds = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        sent[bits] = sum(len(x) for lo, hi in zip(bounds, bounds[1:], strict=False) if lo < hi for x in _encode(values[lo:hi], least[lo:hi], bits)) / len(values)
    assert sent[7] < 12 and sent[13] < 20


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """Every stage of the pipeline on empty tables, nulls, repeated rows and extra columns with names the stages use."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, component_id string, kept_text string, posterior string"
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long + " end", None, None, None), (2, "Other text\n\nof two lines", "de", "s", 1), (None, long, "en", "s", 1), (3, None, "en", "s", 0), (4, " ", "fr", "s", 1), (5, "head line\n\n" + long + "\n\ntail  line", "en", "s", 7)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)
    path = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, long), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
    kept = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, path).collect()]
    assert kept.count((1, long)) == 1 and (2, "Other text\n\nof two lines") in kept and (2, long + " end") not in kept
    assert (None, long) in kept and [k for k in kept if k[0] in (3, 4)] == [(3, None)]
    cut = {r.doc_id: r.text for r in pipeline.passages(spark, docs.where("doc_id in (1, 5)").dropDuplicates(["doc_id"]), path).collect()}
    assert cut[1] == long and cut[5] == "head line\n\ntail  line"
    assert pipeline.mixing(spark, docs, path).where("posterior is null or rate is null").count() == 0
