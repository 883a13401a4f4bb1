"""Spelling variants against a word-by-word definition."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirefold.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Whether two different words differ by one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def counts(rows, every=199, letters=6, least=5):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= least}


def brute(words, factor=5):
    out = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= factor * n else None
        out[w] = [w, n, len(others), form, words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][3]:
            root = out[root][3]
        row.append(root)
    return sorted(map(tuple, out.values()), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def text_rows(seed, n=120):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdéÀz") for _ in range(r.randrange(5, 11))) for _ in range(12)]
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = list(stems[min(r.randrange(12), r.randrange(12))])
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w[k:k + 1] = r.choice([[], [r.choice("abcd")], [w[k], r.choice("ab")], [w[k], w[k]]])
            words.append("".join(w).title() if r.random() < 0.2 else "".join(w))
        out.append((i, r.choice([" ", "-", "1", "\n", "日"]).join(words), "en", "s", 1))
    return out


@pytest.mark.parametrize("block", [1 << 15, 3])
def test_variants_equal_brute_force(spark, docs, block):
    rows = text_rows(1)
    df = spark.createDataFrame(rows, docs.schema).repartition(4)
    got = spelling.variants(df, every=7, block=block)
    want = brute(counts(rows, every=7))
    assert answer(got) == want
    assert any(r[3] for r in want) and any(r[2] > 3 for r in want)


def test_chains_reach_their_root(spark):
    chain = [("aaaaaa" + "b" * k, 5 ** (9 - k)) for k in range(9)] + [("zzzzzz", 7), ("zzzzzy", 7)]
    words = spark.createDataFrame(chain, "word string, n long")
    led = words.join(spelling.near_words(words), "word", "left").select(
        "word", "n", F.when(F.col("near_n") >= 5 * F.col("n"), F.col("near")).alias("form"))
    got = {r["word"]: r["root"] for r in spelling.with_roots(led, 5, 1).collect()}
    assert got == {w: "aaaaaa" if w[0] == "a" else w for w, _ in chain}


def test_tricky_rows(spark, docs, rows, clashing, none):
    want = brute(counts(rows))
    assert want and answer(spelling.variants(docs)) == want
    assert answer(spelling.variants(clashing)) == want
    assert answer(spelling.variants(none)) == []


def test_every_word_of_one_class(spark):
    """All words share their first and last letters: one hot class, cut in blocks."""
    words = {f"abcdefgh{x}{y}hgfedcba": 5 + 40 * (x == y) for x in "abcdefgh" for y in "abcdefgh"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {r[0]: (r[2],) for r in brute(words) if r[2]}
    got = {r["word"]: (r["n_near"],) for r in spelling.near_words(df, block=7).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12, unique=True))
def test_bitsets_find_every_near_word(words):
    index = spelling.BitIndex(words)
    for w in words:
        assert {words[j] for j in spelling.members(index.near(w))} == {v for v in words if near(w, v)}


def test_pieces_cut_no_word():
    text = ("wörter " * 50 + "x" * 400 + "日本" * 30 + "-ende " * 9).encode()
    for size in (1, 7, 64, 10_000):
        parts = list(spelling.pieces(text, size))
        assert b"".join(parts) == text
        assert [w for p in parts for w in RUN.findall(p.decode())] == RUN.findall(text.decode())
