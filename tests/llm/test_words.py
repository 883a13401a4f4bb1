"""Word hashes and word tables with words made to mislead."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold.llm import bpe, set_join, words
from wirefold.llm.common import load_tokenizer, vocabulary_path


def mirror_pair(n=1024):
    """A word of two letters by the parity of ones in its positions, and the word with both letters swapped: these
    collide under every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_mirror_words_have_their_own_hashes():
    for n in (8, 64, 1024, 4096):
        h, _ = words.word_hashes(pa.array([" ".join(mirror_pair(n))]))
        assert h[0] != h[1]


def test_mirror_words_are_encoded_apart(spark):
    a, b = mirror_pair()
    texts = [f"x {a} {b}", f"{b} {a}", a, b, f"{a}{b} {b}{a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    tok = load_tokenizer(vocabulary_path(None))
    assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()} == dict(enumerate(texts))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "ba", "A", "aa " * 30, *mirror_pair(256)]), min_size=1, max_size=40))
def test_distinct_words_under_a_hash_that_always_collides(parts):
    """Even one hash for all words gives the right table: bytes decide."""
    data, offs = words.utf8(pa.array([" ".join(parts)]))
    starts = bpe.word_starts(data, offs, np.zeros(1, bool))
    ends = np.append(starts[1:], len(data))
    true, words.place_hashes = words.place_hashes, lambda part, lead, table: np.zeros(len(lead), np.uint64)
    try:
        first, _, at, count = bpe.distinct_words(data, starts, ends)
    finally:
        words.place_hashes = true
    spelled = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert [spelled[first[i]] for i in at] == spelled and len(first) == len(set(spelled)) and count.sum() == len(spelled)


def test_mirror_words_do_not_link(spark):
    a, b = mirror_pair()
    rows = [(1, f"p q r s {a}"), (2, f"p q r s {b}"), (3, a), (4, b), (5, a)]
    got = {r["doc_id"]: r["component_id"] for r in set_join.similar_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_repeated_ids_keep_their_links(spark):
    """One doc_id on two texts: each text's near copies stay linked to the id, and so to each other."""
    r = random.Random(4)
    one, two = ([f"w{r.randrange(500)}" for _ in range(80)] for _ in range(2))
    near = lambda t: " ".join(t[:40] + ["other"] + t[41:])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, "alone in the world of words")]
    got = {(r["doc_id"], r["component_id"]) for r in set_join.similar_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_text_of_each_component_stays(spark):
    """Rows of one doc_id with different texts, equal rows, near copies, rows without words or without an id."""
    r = random.Random(8)
    t = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(4)]
    near = lambda s: s + " more"
    rows = [(1, t[0], "a"), (1, t[1], "b"), (1, t[1], "c"), (2, near(t[0]), "d"), (3, t[2], "e"), (4, near(t[1]), "f"),
            (5, t[2], "g"), (6, "", "h"), (6, "", "i"), (7, None, "j"), (None, t[0], "k"), (8, t[3], "l"), (3, "", "m")]
    docs = spark.createDataFrame(rows, "Doc_Id long, TEXT string, s string")
    got = set_join.one_of_each(docs, set_join.similar_components(docs))
    assert got.columns == docs.columns
    kept = sorted(x["s"] for x in got.collect())
    assert [x for x in kept if x not in "bchi"] == list("aejklm")
    assert sum(x in "bc" for x in kept) == 1 and sum(x in "hi" for x in kept) == 1


def test_ids_on_several_texts_join_components(spark):
    r = random.Random(9)
    t = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(3)]
    rows = [(2, t[0] + " x"), (5, t[0]), (5, t[1]), (3, t[1] + " x"), (9, t[2]), (7, t[1] + " y"), (9, t[1] + " z")]
    got = {(x["doc_id"], x["component_id"]) for x in set_join.similar_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 2), (5, 2), (3, 2), (7, 2), (9, 2)}
