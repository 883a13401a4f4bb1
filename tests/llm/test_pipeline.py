from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wirefold.llm import language, packing, quality, secret_scan, set_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_each_stage_by_its_own_rule(spark, stages):
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = stages
    for d in (d1, d2, d3, d4):
        assert d.columns == d0.columns and d.dtypes == d0.dtypes
    good = quality.with_scores(d0, quality.train(d0, spark.read.parquet(f"{SF}/labels.parquet"))).filter("score >= 0.7")
    assert Counter(map(tuple, d1.collect())) == Counter(map(tuple, good.drop("score").collect()))
    told = language.with_languages(d1, language.train(d1)).filter("lang_pred <> 'und' and lang_score >= 0.5")
    assert {r[0] for r in d2.collect()} == {r["doc_id"] for r in told.collect()}
    kept = {r["component_id"] for r in set_join.similar_components(d2).collect()}
    assert {r["doc_id"] for r in d3.collect()} == kept
    assert {r["doc_id"] for r in d4.collect()} == kept
    for r in d4.collect():
        assert secret_scan.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in d5.collect()} == kept and set(packing.PIECES.replace(",", "").split()[::2]) <= set(d5.columns)


def test_rejects_bad_and_keeps_clean(spark, stages):
    _, d0, d1 = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share = lambda d, q: d.join(labels.filter(F.col("quality") == q), "doc_id").count()
    assert share(d1, 1) >= 0.98 * share(d0, 1) and share(d1, 0) <= 0.2 * share(d0, 0)
    assert stages[1][2].count() >= 0.97 * d1.count()


def test_stages_take_tricky_rows(spark, docs, clashing, none):
    for frame in (docs, clashing, none):
        for _, f in cp.STAGES[:4]:
            assert f(spark, frame, SF).columns == frame.columns
            f(spark, frame, SF).count()
    assert cp.keep_one_of_group(spark, docs, SF).filter("doc_id is null").count() == 2


def test_run(spark, stages):
    assert Counter(map(tuple, cp.run(spark, SF).drop("sequence_id", "offset").collect())) == Counter(
        map(tuple, stages[-1][2].drop("sequence_id", "offset").collect()))
