import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from wirefold.llm import fingerprints as fp


def lanes(text, banks=2):
    """The fingerprint by its definition, one paragraph at a time."""
    parts = [p for p in re.split(fp.PARAGRAPH, text or "") if p]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = lambda *xs: b"".join(x.to_bytes(8, "little", signed=True) for x in xs)
    first = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]

    def again(h, salt):
        one = xxhash.xxh64_intdigest(words(signed(h)), 42)
        return xxhash.xxh64_intdigest(int(salt).to_bytes(4, "little"), one)

    lock = [sum(again(h, i) >> s & fp._LOW for h in first) % 2**32 for i in range(4) for s in (0, 32)]
    out = lock + [len(first)]
    for b in range(banks):
        hashes = first if not b else [again(h, 1000 + b) for h in first]
        out += [sum(h >> j & 1 for h in hashes) % 2**16 for j in range(64)]
    return out


def test_lanes_by_definition(docs, rows):
    got = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in fp.fingerprints(docs).collect()}
    for r in rows:
        assert got[r[0], len(r[1] or "")] == lanes(r[1]), r[0]


def test_order_and_increment(spark):
    frame = spark.createDataFrame([("One two.\nThree.\nThree.", "Three.\nOne two.\nThree.", "Three.", "One two.\nThree.")],
                                  "a string, b string, c string, d string")
    v = {c: fp.vector(F.col(c)) for c in "abcd"}
    r = frame.select((v["a"] == v["b"]).alias("order"), (fp.combine(v["c"], v["d"]) == v["a"]).alias("add"),
                     (fp.combine(v["a"], v["c"], -1) == v["d"]).alias("drop"), (v["a"] == v["d"]).alias("count")).first()
    assert tuple(r) == (True, True, True, False)


def test_likeness_follows_common_paragraphs(spark):
    base = [f"paragraph number {i}." for i in range(200)]
    texts = ["\n".join(base), "\n".join(base[:100] + [f"other {i}." for i in range(100)]), "\n".join(f"new {i}." for i in range(200))]
    frame = spark.createDataFrame([tuple(texts)], "a string, b string, c string")
    v = {c: fp.vector(F.col(c)) for c in "abc"}
    half, nothing, same = frame.select(fp.likeness(v["a"], v["b"]), fp.likeness(v["a"], v["c"]), fp.likeness(
        v["a"], v["a"])).first()
    assert 0.3 < half < 0.7 and nothing < 0.3 and same == 1.0


def test_likeness_of_very_long_texts(spark):
    texts = [" ".join(f"{w} {i}." for i in range(n)) for w, n in (("one", 70_000), ("two", 70_050))]
    got = fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    a, b = (list(r["fingerprint"]) for r in sorted(got))
    assert max(b[9:]) > 32_767
    v = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    r = v.select(fp.likeness(F.col("a"), F.col("b")).alias("like"), fp.combine(fp.combine(
        F.col("a"), F.col("b")), F.col("b"), -1).alias("back"), fp.text_form(F.col("a")).alias("digits")).first()
    assert r["like"] < 0.3 and r["back"] == a and len(r["digits"]) == 8 * (9 + 128)


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    for r, n in zip(order, order[1:] + order[:1]):
        t, h = r[1] or "", len(r[1] or "") // 2
        e = t[:len(t) - h] + (n[1] or "")[:h]
        yield r[0], len(t), hashlib.sha256(e.encode()).hexdigest()


def test_edited_texts(docs, unique, rows):
    for frame in (docs, unique):
        mine = [tuple(r) for r in frame.collect()]
        for splits in (1, 2, 7, 1000):
            got = fp.edited_fingerprints(frame, 1, splits).collect()
            assert sorted([(r[0], r[1], r[2]) for r in got], key=str) == sorted(edited(mine), key=str), splits


def test_edges(none, clashing, rows, unique):
    assert fp.edited_fingerprints(none).count() == 0
    assert fp.edited_fingerprints(clashing, 1, 4).count() == len(rows)
    one = fp.edited_fingerprints(unique.filter("doc_id = 25")).first()
    assert one["near_next"] == 1.0
