import hashlib
import random
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wirefold.llm import bpe, lengths, packing
from wirefold.llm.common import vocabulary_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encode_is_the_tokenizers(docs, rows, tok):
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, chunk_bytes=3000).collect())
    assert got == Counter((r[0], tuple(ids_of(tok, r[1]))) for r in rows)


def test_words_of_more_than_65535_ids(spark, tok):
    r = random.Random(5)
    blob = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(110_000))
    prose = " ".join(f"w{r.randrange(10**6)}" for _ in range(30_000))
    texts = [blob, "\u00a0" + prose, prose, "short"]
    assert min(len(ids_of(tok, t)) for t in texts[:3]) > 65_535
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: ids_of(tok, t) for i, t in enumerate(texts)}


def test_decode_round_trip(docs, rows, tok):
    got = Counter(map(tuple, bpe.decode(bpe.encode(docs)).collect()))
    assert got == Counter((r[0], r[1] or "") for r in rows)


def test_decode_of_odd_ids(spark):
    vocab = np.diff(bpe.piece_table(vocabulary_path(None))[1])
    lone = [i for i in range(256) if vocab[i] == 1][150:153]
    frame = spark.createDataFrame([(1, lone), (2, []), (3, None), (4, [50256, 11])], "doc_id long, ids array<int>")
    got = dict(map(tuple, bpe.decode(frame).collect()))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {1: tok.decode(lone, skip_special_tokens=False), 2: "", 3: "", 4: "<|endoftext|>,"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_empty_and_clashing(none, clashing, rows):
    assert bpe.encode(none).count() == 0 and lengths.token_lengths(none).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0
    assert bpe.encode(clashing).count() == len(rows)
    assert packing.pack(packing.pieces(clashing)).count() >= len(rows)


def test_context_report(docs, rows, tok):
    n = np.array([len(ids_of(tok, r[1])) for r in rows])
    report = lengths.context_report(lengths.histogram(lengths.token_lengths(docs)), block=16).cache()
    got = report.collect()
    assert sorted(r["context_limit"] for r in got) == sorted(set(n.tolist()))
    for r in got:
        at = r["context_limit"]
        assert (r["n_docs"], r["docs_fitting"], r["tokens_fitting"], r["tokens_kept"], r["tokens_lost"]) == (
            (n == at).sum(), (n <= at).sum(), n[n <= at].sum(), np.minimum(n, at).sum(), np.maximum(n - at, 0).sum())
    for limit in (0, 7, 333, 10**6):
        r = lengths.at_limit(report, limit).first()
        assert (r["docs_fitting"], r["tokens_kept"]) == ((n <= limit).sum(), np.minimum(n, limit).sum())
    for q in (0.0, 0.5, 0.9, 1.0):
        want = sorted(n)[max(0, int(np.ceil(q * len(n))) - 1)]
        assert lengths.quantile(report, q).first()[0] == want


def test_packed_sequences_hold_their_ids(docs, rows, tok):
    got = packing.pack(packing.pieces(docs, sequence=64, with_ids=True), 64).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert sum(len(r["ids"]) for r in got) == sum(len(ids_of(tok, r[1])) + 1 for r in rows)


@pytest.mark.parametrize("sequence", [64, 1024])
def test_packing(docs, rows, tok, sequence):
    got = packing.pack(packing.pieces(docs, sequence=sequence), sequence).collect()
    want = Counter()
    for r in rows:
        ids = ids_of(tok, r[1]) + [2]
        at = [0, *range(len(ids) % sequence or sequence, len(ids), sequence), len(ids)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= sequence
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / sequence + 1


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(30):
        size = int(rng.integers(5, 60))
        items = rng.integers(1, size + 1, int(rng.integers(1, 300))).tolist()
        room = []
        for x in sorted(items, reverse=True):
            fit = [(r, i) for i, r in enumerate(room) if r >= x]
            if fit:
                room[min(fit)[1]] -= x
            else:
                room.append(size - x)
        used = {}
        counts = Counter(items)
        runs = packing.plan(dict(counts), size)
        for length, rank, n, first, offset in runs:
            counts[length] -= n
            for s in range(first, first + n):
                used.setdefault(s, []).append((offset, length))
        assert not any(counts.values()) and len(used) == len(room)
        for v in used.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= size


def test_word_cuts_never_change_ids(tok):
    import pyarrow as pa

    from hypothesis import given, settings
    from hypothesis import strategies as st

    piece = st.sampled_from([" ", "  ", "\n", "\t", " ", "a", "B9", "'s", "!", "é", "<|endoftext|>", "\x1c", "\x85"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(piece, max_size=14).map("".join))
    def check(text):
        from wirefold.llm import words

        path = vocabulary_path(None)
        data, offs = words.utf8(pa.array([text]))
        at = bpe.word_starts(data, offs, bpe.uncut(data, offs, bpe.special_strings(path))).tolist()
        raw = data.tobytes()
        cut = [raw[a:b].decode() for a, b in zip(at, [*at[1:], len(raw)])]
        assert "".join(cut) == text
        assert [i for e in bpe.encode_texts(cut, path) for i in e.tolist()] == tok.encode(text, add_special_tokens=False).ids

    check()


def test_digest_of_query(spark, tok):
    from wirefold.llm.queries import op1_bpe

    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = ids_of(tok, text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
