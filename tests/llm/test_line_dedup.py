"""Line dedup against brute force: hot keys over many ranges, nulls, repeats, clashing columns, empty tables, long texts."""

import hashlib
import re
import string
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import queries as llm
from skein.llm.line_dedup import bitmap, dedup_lines, kept_lines, line_bitmaps

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would else be sorted in one task, where no key crosses ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(rows, least=10):
    """(doc_id, lines, dropped, kept text) of every row; a null id comes after all others."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least and (k not in first or order(i) < order(first[k])):
                first[k] = i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def test_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = ["".join(rng.choice(list("abÄß 日x"), int(rng.integers(0, 22)))) for _ in range(60)]
    rows = []
    for i in range(300):
        some = [lines[j] for j in rng.integers(0, 60, int(rng.integers(0, 9)))]
        some = [x.upper() if rng.random() < 0.2 else f"\t{x} \r" if rng.random() < 0.2 else x for x in some]
        if rng.random() < 0.7:
            some.insert(int(rng.integers(0, len(some) + 1)), "The very common line")
        rows.append((int(rng.integers(-5, 400)), "\n".join(some)))
    rows += [(7, None), (8, ""), (9, "\n\n"), (None, "The very common line\nonly in the null row"), (None, "only in the null row"), rows[0], rows[1], rows[1]]
    rows += [(500, "\n".join(f"line number {n % 3000} of a long text" for n in range(9000))), (501, "x" * 300_000 + "\nline number 7 of a long text"), (502, "x" * 300_000)]
    docs = spark.createDataFrame([(t, 1, i, "k") for i, t in rows], "text string, n_lines long, doc_id long, keep string").repartition(7)
    got = dedup_lines(docs).collect()
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept_text)) for r in got) == brute(rows)
    bits = line_bitmaps(docs).collect()
    assert len(bits) == len({(i, t or "") for i, t in rows})
    assert all(len(kept_lines(r.keep, r.n_lines)) - kept_lines(r.keep, r.n_lines).sum() == r.n_dropped for r in bits)
    assert max(len(r.keep) for r in bits) < 9000 / 8


def test_hot_key_is_dealt_over_tasks(spark):
    """A line that is in every document: no range holds it whole, and only the smallest id keeps it."""
    docs = spark.range(4000).selectExpr("3999 - id as doc_id", "concat('a line that all share\\nown line number ', id) as text").repartition(8)
    got = dedup_lines(docs)
    assert got.where("n_dropped = 0").select("doc_id").collect() == [(0,)]
    assert got.where("n_dropped = 1").count() == 3999


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert line_bitmaps(spark.createDataFrame([(3, None)], "doc_id long, text string")).drop("text_hash", "keep").collect() == [(3, 1, 0)]


def test_bitmap_round_trip():
    assert kept_lines(bitmap(11, [0, 10]), 11).tolist() == [False] + [True] * 9 + [False]


def test_registered(spark, tmp_path):
    rows = [(2, "shared line one\nA"), (1, "b\nSHARED line one"), (3, None), (4, " shared line one\nshared line one\nc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in llm.op13_line_dedup(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 0, digest("b\nSHARED line one")), 2: (2, 1, digest("A")), 3: (1, 0, digest("")), 4: (3, 2, digest("c"))}
