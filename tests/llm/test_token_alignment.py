"""Alignment against the libraries on whole texts and set arithmetic over their tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import queries as llm

public = pytest.importorskip("public_tokenizers")
FILES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")

WORDS = ["The", "don't", "we'll", "naïve", "über", "日本語", "x1y2", "!!!", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "▁", "é", "é", "🙂", "a b", "١٢", "foo_bar", "HTTP/1.1", "\x00", "ﬁne", "½", "　", "​", "Ω", " "]
GAPS = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n ", "   ", "\r\n", "\v", "\f"]


def brute(rows):
    """Every column from whole texts: links by comparing all ends of a text, groups by cutting at common ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = dict(zip(map(chr, plain), plain, strict=True)) | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def ends(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts, strict=True):
            at += len(p)
            out.append((i, at))
        return out

    made = []
    for i, t in rows:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        pa = [bytes(table[c] for c in a.id_to_token(x)) for x in ia]
        pb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not t or b"".join(pa) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            ia, ib, pa, pb = [], [], [], []
        ea, eb = ends(ia, pa), ends(ib, pb)
        both = sorted({e for _, e in ea} & {e for _, e in eb})
        groups, low = [], 0
        for e in both:
            groups.append("|".join(",".join(str(x) for x, at in side if low < at <= e) for side in (ea, eb)))
            low = e
        made.append((i, len(ia), len(ib), groups, [(x, y) for x, p in ea for y, q in eb if p == q]))
    count = Counter(p for *_, links in made for p in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return sorted(
        repr((i, na, nb, len(g), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""))
        for i, na, nb, g, ls in made
    )


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    texts = ["".join(str(rng.choice(WORDS)) + str(rng.choice(GAPS)) for _ in range(int(rng.integers(1, 25)))) for _ in range(250)]
    texts += [g + w + h for g in ["", *GAPS] for w in ("word", "b'c") for h in ["", *GAPS]] + [" ", "\n", "   ", "x" * 5000, "no space", "a  b ", "tail\n", "  lead"]
    texts += ["ab " * 3000 + "\n" + "cd, ef. " * 2000]
    return [*((i % 200, t) for i, t in enumerate(texts)), (900, None), (901, ""), (None, "a null id"), (5, texts[5]), (5, texts[5])]


def docs(spark, rows):
    return spark.createDataFrame([(t, 1, i, "g") for i, t in rows], "text string, n_a int, doc_id long, groups string").repartition(6)


def test_brute_force(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_many_pairs_are_joined_by_a_shuffle(spark):
    from skein.llm.token_alignment import chunk_scores

    rng = np.random.default_rng(2)
    links = [(i, int(rng.integers(1, 9)), [int(a) << 32 | int(b) for a, b in rng.integers(0, 6, (int(rng.integers(0, 5)), 2))]) for i in range(300)]
    table = spark.createDataFrame(links, "id long, times long, links array<long>")
    got = sorted(chunk_scores(table).collect())
    assert got == sorted(chunk_scores(table, broadcast_pairs=0).collect())
    count, most = Counter(), Counter()
    for _, n, ls in links:
        count.update({x: n * ls.count(x) for x in set(ls)})
    for x, n in count.items():
        most[x % (1 << 32)] = max(most[x % (1 << 32)], n)
    assert got == [(i, sum(count[x] == most[x % (1 << 32)] for x in ls), sum(count[x] for x in ls)) for i, _, ls in links if ls]


def test_empty_table(spark):
    from skein.llm.token_alignment import align_tokenizers

    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []


def test_texts_that_are_not_cut(spark, rows, monkeypatch):
    """Tokenizers whose files do not allow cutting see whole texts, with the same result."""
    from skein.llm import token_alignment as T

    some = rows[::3]
    monkeypatch.setattr(T, "cuttable", lambda data: np.ones(len(data), bool))  # no vocabulary passes that
    assert not T.Pieces(open(FILES[1], "rb").read()).cuts
    assert sorted(repr(tuple(r)) for r in T.align_tokenizers(docs(spark, some), *FILES).collect()) == brute(some)


def test_chunks_are_few(spark):
    """Both supplied files allow cutting, and a slice holds a common chunk once."""
    from skein.llm.token_alignment import ByteLevel, Pieces, sliced

    assert ByteLevel(open(FILES[0], "rb").read()).cuts and Pieces(open(FILES[1], "rb").read()).cuts
    texts = spark.createDataFrame([(i, "the same words " * 500) for i in range(40)], "doc_id long, text string").coalesce(1)
    (row,) = sliced(texts).collect()
    assert len(row.chunks) == 4 and sum(row.times) == sum(len(d.codes) for d in row.docs) == 40 * 1501
