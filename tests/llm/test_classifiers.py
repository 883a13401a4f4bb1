import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirefold.llm import language, quality, words

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_words():
    import re
    import string

    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    texts = ["", None, "a B a\tb\n\nÉ é", "x" * 300_000 + " y", " \x0b ", "tail", "TAIL  "] + ["w%d w" % i for i in range(9)]
    h, at = words.word_hashes(pa.array(texts))
    name = {}
    for t, a, b in zip(texts, at, at[1:]):
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(fold))
        assert len(w) == b - a
        for x, y in zip(w, h[a:b].tolist()):
            assert name.setdefault(x, y) == y
    assert len(set(name.values())) == len(name)


def test_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    y = np.where(np.array([3 in r for r in rows]), 1.0, -1.0)
    values = rng.normal(1, 0.2, 12)
    w, b = quality.descend(rows, values, y, c=1.0, epochs=2000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - t * ((w[r] * values[r]).sum() + b)) for r, t in zip(rows, y))
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.05, 12), b + rng.normal(0, 0.05)) >= best - 1e-3


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, F.col("doc_id") % 2 == 0)
    got = quality.with_scores(docs, model).join(labels, "doc_id").filter("doc_id % 2 = 1").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_edges(spark, docs, none, clashing, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (2, None), (None, 1), (3, 9)],
                                   "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.with_scores(clashing, model)
    assert len(got.columns) == len(clashing.columns) + 1 and got.count() == len(rows)
    assert quality.with_scores(none, model).count() == 0
    blank = quality.with_scores(docs, quality.train(docs, labels.limit(0))).agg(F.min("score"), F.max("score")).first()
    assert blank[0] == blank[1] > 0.99
    single = quality.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int"))
    assert quality.with_scores(docs, single).agg(F.max("score")).first()[0] < 0.01
    undisputed = {r["doc_id"] for r in quality.labelled(labels).collect()}
    assert undisputed == set(range(40)) - {1} and quality.labelled(labels, rows=5).count() == 5


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, allowed=F.col("doc_id") % 2 == 0)
    got = language.with_languages(docs, model).filter("doc_id % 2 = 1")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_best_path_is_the_best():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(200):
        s = -np.abs(rng.normal(0, 3, (int(rng.integers(1, 7)), 3)))
        p = float(rng.uniform(0, 6))
        value = lambda path: sum(s[i, k] for i, k in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        got = value(language.best_path(s, p).tolist())
        assert got == pytest.approx(max(value(x) for x in product(range(3), repeat=len(s))))


def test_a_path_of_two_other_languages_beats_the_best_single_one():
    half = [[0.0, -6.0, -2.0]] * 5
    s = np.array(half + [[b, a, c] for a, b, c in half])
    assert language.best_path(s, 12.0).tolist() == [0] * 5 + [1] * 5
    rng = np.random.default_rng(3)
    for _ in range(2000):  # against the plain programme, with scores near the penalty
        s = -np.abs(rng.normal(0, 2, (int(rng.integers(2, 16)), 3)))
        p, value = float(rng.uniform(2, 12)), np.zeros(3)
        for row in s:
            value = np.maximum(value, value.max() - p) + row
        path = language.best_path(s, p)
        got = s[np.arange(len(s)), path].sum() - p * (path[1:] != path[:-1]).sum()
        assert got == pytest.approx(value.max())


def test_mixed_spans_and_scripts(spark):
    de, en, ru = "der schnelle fuchs springt über zäune ", "the quick brown fox jumps over fences ", "быстрая лиса прыгает "
    docs = spark.createDataFrame([(1, de * 9, "de"), (2, en * 9, "en"), (3, ru * 9, "ru"), (4, de * 6 + en * 9, None),
                                  (5, en * 5 + ru * 3, None), (6, "12 !! 34", None), (7, None, None), (8, "λόγος", None)],
                                 "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["de", "en", "ru"]
    got = {r["doc_id"]: r for r in language.with_languages(docs, model).collect()}
    assert [s["lang"] for s in got[4]["lang_spans"]] == ["de", "en"] and got[4]["lang_pred"] == "en"
    assert abs(got[4]["lang_spans"][1]["start"] - len(de * 6)) < 12
    assert [s["lang"] for s in got[5]["lang_spans"]] == ["en", "ru"]
    assert got[5]["lang_spans"][1]["start"] == len(en * 5) and got[5]["lang_spans"][1]["end"] == len(en * 5 + ru * 3)
    assert got[6]["lang_pred"] == got[7]["lang_pred"] == "und" and got[6]["lang_score"] == 0.0
    assert got[8]["lang_pred"] in model.languages


def test_language_edges(docs, none, clashing, rows):
    model = language.train(docs)
    got = language.with_languages(clashing, model)
    assert got.count() == len(rows) and len(got.columns) == len(clashing.columns) + 3
    empty = language.train(none)
    assert empty.languages == [] and {r[0] for r in language.with_languages(docs, empty).select("lang_pred").collect()} == {"und"}
    assert language.with_languages(none, model).count() == 0
