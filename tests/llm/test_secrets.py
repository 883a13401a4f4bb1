import random
import re
import string
from collections import Counter

from wirefold.llm import secret_scan as ss
from wirefold.llm.common import vocabulary_path

CASES = [
    'password=hunter2x', "Password : 'abcdef'", 'token=abc', 'api_key="Zz9/+=._-"', "APIKEY=abcdef", "token=token:abcdefgh",
    "ſecret=abcdefgh", "secret=password=abcdef", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "xAKIAAKIA" + "C2" * 7,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "é" * 5 + " token=" + "q" * 9,
    "f" * 23 + "G" + "e" * 30, "passwd  =  abcdef secret:\t123456", "tokentoken==abcdef"]


def plain(text):
    """The base spans by the definition: all matches, then the short ones dropped."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans():
    for c in [*CASES, " ".join(CASES), ""]:
        assert ss.base_spans(c) == plain(c), c


def test_random_strings_only():
    path = vocabulary_path(None)
    hits = ["x7Kq2ZpLr9TgVb3NwY8mHc5J", "ghp_9aXz81LqPw0VbTn45KsYd72RmEc", "Zm9vYmFyMTIzNDU2Nzg5MHF3ZXJ0eXVpb3A="]
    clean = ["internationalization", "get_user_account_settings", "d41d8cd98f00b204e9800998ecf8427e", "2024-05-17-12-30-59-00",
             "550e8400-e29b-41d4-a716-446655440000", "=" * 60, "-_-_-_-_-_-_-_-_-_", "AbstractSingletonFactoryBean",
             "verantwortungsbewusstsein", "12345678901234567890123456", "a" * 400]
    for h in hits:
        assert ss.random_spans(f"see {h}, ok", path) == [(4, 3, 4 + len(h))], h
    for c in clean:
        assert ss.random_spans(f"see {c} ok", path) == [], c


def test_random_strings_of_any_shape_and_place():
    path, r = vocabulary_path(None), random.Random(7)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        keys = [make(letters, 32) for _ in range(200)]
        assert sum(ss.random_spans(f"see {k} ok", path) == [(4, 3, 36)] for k in keys) > 180
    for before, after in (("static/javascript/", ""), ("configuration=", ""), ("", "-production_environment")):
        keys = [make(string.ascii_letters + string.digits, 24) for _ in range(200)]
        found = [ss.random_spans(before + k + after, path) for k in keys]
        assert all(any(a <= len(before) and b >= len(before) + 24 for a, _, b in f) for f in found)
    for clean in ("static/javascript/application-settings", "the/550e8400-e29b-41d4-a716-446655440000/documentation/index",
                  "information/2024-05-17-12-30-59-00/internationalization"):
        assert ss.random_spans(clean, path) == [], clean


def test_scan_and_redact(spark, docs, rows, none, clashing):
    frame = spark.createDataFrame([(i, c, "s", len(c)) for i, c in enumerate(CASES)] + [(99, None, "s", 5)],
                                  "doc_id long, text string, source string, n_chars int")
    got = {r["doc_id"]: r for r in ss.scan(frame).collect()}
    for i, c in enumerate(CASES):
        assert [(s["start"], ss.KINDS.index(s["kind"]), s["end"]) for s in got[i]["base"]] == plain(c)
        assert {tuple(s) for s in got[i]["base"]} <= {tuple(s) for s in got[i]["spans"]}
    red = {r["doc_id"]: r for r in ss.redact(frame).collect()}
    assert ss.redact(frame).columns == frame.columns
    assert red[13]["text"] == "é" * 5 + " [secret]" and red[13]["n_chars"] == 14
    assert red[2]["text"] == "token=abc" and red[99]["text"] is None and red[99]["n_chars"] == 5
    clean = Counter((r["doc_id"], r["text"]) for r in ss.redact(docs).collect())
    assert clean == Counter((r[0], r[1]) for r in rows)
    assert ss.redact(none).count() == ss.scan(none).count() == 0
    assert ss.redact(clashing).count() == len(rows) and ss.redact(clashing).columns == clashing.columns
