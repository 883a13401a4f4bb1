"""The document pipeline: quality, language, near duplicates, secrets, packing.

Each stage takes the documents that the one before kept. The first four return the columns of `documents`; the last
returns the packed pieces. Filters decide per row, so repeated rows, clashing extra columns and null ids pass through
unharmed: a null text is scored as empty and goes with the language stage, a row without doc_id is no one's copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirefold.llm import language, packing, quality, secret_scan, set_join
from wirefold.llm.common import table
from wirefold.session import scratch_path
from wirefold.ship import ship

MAJORITY = 0.5
ORACLE_SQL = None


def _kept(scored: DataFrame, docs: DataFrame, keep: str) -> DataFrame:
    """Rows of a frame with columns added after those of docs that meet a condition on these, with docs' columns."""
    n = len(docs.columns)
    flat = scored.toDF(*[f"c{i}" for i in range(n)], *scored.columns[n:])
    return flat.filter(keep).select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, gives a score of 0.7 or more."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _kept(quality.with_scores(docs, model), docs, f"score >= {quality.THRESHOLD}")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language holds at least half of the letters; texts without letters go."""
    ship(spark)
    model = language.train(docs)
    return _kept(language.with_languages(docs, model), docs, f"lang_pred <> 'und' and lang_score >= {MAJORITY}")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each component of near copies: that with the smallest doc_id. Equal rows of one doc_id stay once,
    different texts of one doc_id are judged each on its own; documents without words or without doc_id stay."""
    ship(spark)
    return set_join.one_of_each(docs, set_join.similar_components(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    ship(spark)
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", keep_one_of_group),
          ("secrets", redact_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
