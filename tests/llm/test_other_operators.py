"""Search, archives, chats, classifiers and mixing, against brute force, round trips and held-out labels."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.chat_format import fold_events, format_chats, read_chats
from skein.llm.mixing import mix
from skein.llm.quality import cumulative_link, fit_ordinal, grade, graded_labels, select_quality
from skein.llm.topk_search import topk_search
from skein.llm.warc import read_warc, record_chains, write_warc


@pytest.mark.parametrize("scale", [9, 1 << 40])
def test_topk(spark, scale):
    rng = np.random.default_rng(5)
    v = rng.integers(-scale, scale, (300, 8))
    v[40:90] = v[3]
    rows = [(i, [int(x) for x in v[i]], "z") for i in range(300)]
    table = spark.createDataFrame([*rows, (900, None, "z"), (901, [1, None], "z"), (902, [], "z"), (903, [1, 2], "z")], "id long, v array<long>, block string").repartition(5)
    q = table.where("id % 20 = 0")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search(q, table, 20).collect())
    want = []
    for i in range(0, 300, 20):
        score = [sum(int(a) * int(b) for a, b in zip(v[i], v[j], strict=True)) for j in range(300)]
        score = [(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in score]
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], j))[:20]
        want += [(i, r, j, score[j]) for r, j in enumerate(order, 1)]
    assert got == sorted(want)
    assert topk_search(q.limit(0), table).count() == 0


PAYLOADS = [
    (1, "http://a/", "x" * 120), (2, "http://b/\r\nEvil: 1", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), (3, None, None), (4, "u", ""),
    (5, "u", "x" * 120), (6, "u", "short"), (7, "u", "short"), (8, "u", "é\r\n\r\n" * 3000), (None, "u", "x" * 120), (9, "u", "WARC/1.0\r\n" * 50), (1, "http://a/", "x" * 120),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "d") for p in PAYLOADS], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    write_warc(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # ranges that cut records
    try:
        got = [(r.record_id, r.record_type, r.refers_to, bytes(r.payload), r.http_length) for r in read_warc(spark, path).collect()]
        chains = record_chains(spark, path).where("start >= 0")
        assert chains.where("not reached").count() >= 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for i, _, h in PAYLOADS:
        again = len((h or "").encode()) >= 100 and h.startswith("x") and i != 1
        want.append((f"<urn:page:{'null' if i is None else i}>", "revisit" if again else "response", "<urn:page:1>" if again else None, b"" if again else (h or "").encode(), len((h or "").encode())))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fold_events(spark):
    log = [
        ("c", 1, "create", "m1", "user", "hi"), ("c", 2, "create", "m2", "assistant", "a"), ("c", 3, "delta", "m2", None, "b"), ("c", 4, "regenerate", "m2", None, None), ("c", 6, "delta", "m2", None, "y"), ("c", 5, "delta", "m2", None, "x"),
        ("c", 7, "edit", "m1", None, "hello"), ("c", 8, "create", "m3", "user", "gone"), ("c", 9, "delete", "m3", None, None), (None, 1, "delta", "m9", None, "z"),
    ]
    events = spark.createDataFrame(log, "conv_id string, seq int, event string, message_id string, role string, text string")
    got = sorted(((r.conv_id or "~", r.place.seq, r.role, r.text) for r in fold_events(events).collect()))
    assert got == [("c", 1, "user", "hello"), ("c", 2, "assistant", "xy"), ("~", 1, "", "z")]
    assert format_chats(events.limit(0)).count() == 0


HARD = ["", None, "<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<", "|<|", "a\\n\nb", "<\\|im_end|>", "😀 é" * 2000]


def test_chat_round_trip(spark):
    rows = [(1, i, "create", i, ("assistant" if i % 2 else "us\ner<|"), t, "x") for i, t in enumerate(HARD)]
    events = spark.createDataFrame(rows, "conv_id long, seq int, event string, message_id int, role string, text string, turn string")
    out = format_chats(events)
    r = read_chats(out).first()
    assert r.texts == [t or "" for t in HARD]
    assert r.roles == ["assistant" if i % 2 else "us\ner<|" for i in range(len(HARD))]
    assert r.masked == "".join(t or "" for i, t in enumerate(HARD) if i % 2)
    assert r.formatted.count("<|im_start|>") == len(HARD)


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    rest, y, s = np.array([-0.7, 0.3]), rng.integers(0, 3, 20), rng.normal(size=(20, 1))
    _, by_score, by_rest = cumulative_link(rest, y, s)
    for k in range(2):
        d = np.eye(2)[k] * 1e-6
        assert math.isclose((cumulative_link(rest + d, y, s)[0] - cumulative_link(rest - d, y, s)[0]) / 2e-6, by_rest[k], rel_tol=1e-4, abs_tol=1e-6)
    d = np.zeros((20, 1))
    d[3] = 1e-6
    assert math.isclose((cumulative_link(rest, y, s + d)[0] - cumulative_link(rest, y, s - d)[0]) / 2e-6, by_score[3, 0], rel_tol=1e-4, abs_tol=1e-6)


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(2)
    clean = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        kind = i % 4
        if kind == 0:
            w[5] = ["vilea", "vileb", "vilec"][i % 3]
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(4).cache()


def test_ordinal_held_out(rated):
    y = rated.join(graded_labels(rated.select("doc_id", "quality", "toxic")), "doc_id")
    theta = fit_ordinal(y.where("doc_id % 5 <> 0").select("text", "y"), 3)
    out = grade(y.where("doc_id % 5 = 0").select("doc_id", "text", "y"), theta, 3)
    wrong = out.where((F.col("y") == 2) != (F.col("tail_probability") >= 0.5)).count()
    assert wrong <= 4
    assert out.where("expected_grade < 0 or expected_grade > 2").count() == 0


def test_select_quality_edges(rated, spark):
    docs = rated.select("doc_id", "text").withColumn("y", F.lit("clash")).withColumn("tail_probability", F.lit("clash"))
    odd = spark.createDataFrame([(None, "word1 word2", "c", "c"), (1000, None, "c", "c"), (1001, "", "c", "c"), (2, "word3 " * 20000, "c", "c")], docs.schema)
    labels = rated.select("doc_id", "quality", "toxic").union(spark.createDataFrame([(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int"))
    out = select_quality(docs.union(odd), labels).collect()
    assert all(r.y in ("clash", "c") for r in out)
    kept = {r.doc_id for r in out}
    assert sum(i % 4 >= 2 for i in kept if i is not None and i < 400) >= 190
    assert select_quality(docs.limit(0), labels).count() == 0
    assert select_quality(docs, labels.limit(0)).count() == 400


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 4 == 0]}{k}" for k in range(50)], 10 + i % 30)), "ab"[i % 4 == 0]) for i in range(400)]
    docs = spark.createDataFrame([*[(*r, "clash") for r in rows], (None, "a1 a2", None, "c"), (500, None, "a", "c"), (3, "", "b", "c")], "doc_id long, text string, lang string, rate string").repartition(4)
    out = mix(docs, docs.where("doc_id < 200").select("doc_id", F.col("lang").alias("domain")), {"a": 1.0, "b": 1.0}).collect()
    assert len(out) == 403
    total = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in out)
    n = sum(r.n_tokens for r in out)
    assert np.allclose(total / n, 0.5, atol=1e-4)
    assert min(r.rate for r in out) >= 0
    assert mix(docs.limit(0), docs.select("doc_id", F.col("lang").alias("domain")), {"a": 1.0, "b": 1.0}).count() == 0


def test_digest_is_plain_sha256():
    assert hashlib.sha256(b"abc").hexdigest().startswith("ba7816bf")
