"""Partitioning and chunking on small texts."""

import numpy as np
from pyspark.sql import functions as F

from skein.operators import documents as D

MARKDOWN = "intro\n# A\nfirst line\nsecond\n\nnext\n## B\n| x | y |\n| 1 | 2 |\n```py\ncode #1\n\n# no title\n```\ntail\n# C\n### D\nlast"


def test_elements(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, "```\nopen"), (4, None)], "doc_id long, text string")
    got = [(r.type, r.text, r.path) for r in D.elements(docs).where("doc_id = 1").orderBy("element").collect()]
    assert got == [
        ("NARRATIVE_TEXT", "intro", ""), ("TITLE", "A", "A"), ("NARRATIVE_TEXT", "first line\nsecond", "A"), ("NARRATIVE_TEXT", "next", "A"), ("TITLE", "B", "A > B"), ("TABLE", "| x | y |\n| 1 | 2 |", "A > B"),
        ("CODE_BLOCK", "code #1\n\n# no title", "A > B"), ("NARRATIVE_TEXT", "tail", "A > B"), ("TITLE", "C", "C"), ("TITLE", "D", "C > D"), ("NARRATIVE_TEXT", "last", "C > D"),
    ]
    assert [(r.type, r.text) for r in D.elements(docs).where("doc_id = 3").collect()] == [("CODE_BLOCK", "open")]


def test_structured_chunks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    got = [r.text for r in D.structured_chunks(D.elements(docs), 20).orderBy("section", "chunk").collect()]
    assert got == ["intro", "[A]\nfirst line\n\nsecond\n", "[A]\nnext", "[A > B]\nB", "[A > B]\n| x | y |\n| 1 | 2 |", "[A > B]\ncode #1\n\n# no title", "[A > B]\ntail", "[C > D]\nD\nlast"]


def test_fixed_chunks(spark):
    text = "a" * 30 + "\n" + "b" * 15 + "\n" + "c" * 60
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r.chunk, r.start, r.text) for r in D.fixed_chunks(docs, 40, 5).collect())
    assert got[0] == (0, 0, "a" * 30 + "\n")
    assert "".join([got[0][2], *[t[5:] for _, _, t in got[1:]]]) == text
    assert all(len(t) <= 41 for _, _, t in got)


def test_sentences(spark):
    rows = spark.createDataFrame([("One two. Three four! Five six? " + "x" * 25,), ("short",), ("",)], "t string")
    got = [r.c for r in rows.select(D.by_sentences(F.col("t"), 20).alias("c")).collect()]
    assert got[1:] == [["short"], []]
    assert got[0] == ["One two.", " Three four!", " Five six?", " " + "x" * 19, "x" * 6]


def test_lineage(spark):
    rows = spark.createDataFrame([("select * from a.b x left join c on x.i = c.i",), ("with q as (select 1 from t) select * from q",), ("",)], "s string")
    got = [r.l for r in rows.select(D.statement_lineage(F.col("s")).alias("l")).collect()]
    assert (got[0].type, got[0].reads, got[0].joins) == ("SELECT", ["a.b", "c"], ["c"])
    assert got[1].reads == ["q", "t"] and got[2].type == ""


def test_heading_chunks_against_a_loop(spark):
    """Sections from heading to heading, packed while the estimate (half a token a CJK character, one a word) fits."""
    import re

    rng = np.random.default_rng(3)
    lines = ["# Title one", "## 2 parts", "1.2 numbered", "plain words here", "日本語の文", "#no heading", "a # b", "", "1.x not", "longer line of several words in a row"]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(0, 14)))) for _ in range(80)] + ["", "# only", "\n\n# late"]

    pieces = {}
    for i, t in enumerate(texts):
        starts = sorted({m.start() for m in re.finditer(r"(?m)^#{1,6}\s+\S|^\d+(?:\.\d+)*\s+\S", t)} | {0})
        pieces[i] = [x for x in (t[a:b] for a, b in zip(starts, [*starts[1:], len(t)], strict=True)) if x]
    known = sorted({x for p in pieces.values() for x in p})
    spark_tokens = {r.t: r.n for r in spark.createDataFrame([(x,) for x in known], "t string").select("t", D.estimated_tokens(F.col("t")).alias("n")).collect()}
    want = set()
    for i, parts in pieces.items():
        held, size, out = "", 0, []
        for x in parts:
            if held and size + spark_tokens[x] > 12:
                out.append(held)
                held, size = "", 0
            held, size = held + x, size + spark_tokens[x]
        out += [held] if held else []
        want |= {(i, n, x) for n, x in enumerate(out)}
    got = D.heading_chunks(spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string"), 12).collect()
    assert {(r.doc_id, r.chunk, r.text) for r in got if r.text} == want
    assert all("".join(r.text for r in sorted(got, key=lambda r: r.chunk) if r.doc_id == i) == t for i, t in enumerate(texts))


def test_references_against_a_loop(spark):
    import re

    from skein.functions.text import references

    rng = np.random.default_rng(9)
    parts = ["orders.customer_id", "schema.t.c", "a..b", "3.14", "end.", "/api/v1/orders", "x/y", "src/main/App.java", "`any thing`", "``", "GET", "//twice", "com.example.Order", "file.txt", "(a.b)", "日.本", "/a-b/c_d."]
    texts = [" ".join(rng.choice(parts, int(rng.integers(0, 9)))) for _ in range(150)] + ["", None]

    def plain(t):
        rules = [r"(?<![\w.])[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*){1,}(?![\w.])", r"(?<!\w)/[a-zA-Z][\w\-/]*", r"(?:[\w\-/]+/)+[\w\-]+\.[a-zA-Z]{1,8}", "`([^`]+)`"]
        return list(dict.fromkeys(m.group(m.re.groups) for r in rules for m in re.finditer(r, t, re.ASCII)))

    got = spark.createDataFrame([*enumerate(texts)], "i long, t string").select("i", references(F.col("t")).alias("r")).collect()
    assert {r.i: r.r for r in got if texts[r.i] is not None} == {i: plain(t) for i, t in enumerate(texts) if t is not None}
