"""Token counts from an exact length histogram.

Documents are counted by encoded length, and running sums over the histogram answer, for every context limit, how many
documents fit, how many tokens are kept when longer documents are truncated, and every quantile. The histogram has one
row per distinct length; its running sums go block by block, so no task holds more than a block of it.

Defined results: null and empty texts have length 0 and are counted; repeated rows count each; an empty table gives an
empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.llm.bpe import encode_texts, slices
from wirefold.llm.common import documents, vocabulary_path
from wirefold.session import cut_lineage

BLOCK = 1024
SLICE_BYTES = 1 << 20


def texts_by_slice(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """(doc_ids, texts) of a few rows of a batch at a time; null is empty."""
    offs = np.cumsum(np.append(0, pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy(
        zero_copy_only=False)))
    for a, b in slices(offs, most):
        yield batch["doc_id"][a:b], [t or "" for t in batch["text"][a:b].to_pylist()]


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    path = vocabulary_path(path)

    def count(batches):
        for batch in batches:
            for ids, texts in texts_by_slice(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(e) for e in encode_texts(texts, path)],
                                                                pa.int64())], ["doc_id", "n_tokens"])

    return documents(docs).select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_docs per n_tokens."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_report(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length that occurs, read as a context limit: documents of that length, documents that fit and that
    are longer, their share, tokens of those that fit, tokens kept and lost when all are truncated to the limit."""
    h = cut_lineage(hist.select("n_tokens", "n_docs", F.expr(f"n_tokens div {block}").alias("block")))
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"],
        *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in "dt"])
    inside = Window.partitionBy("block").orderBy("n_tokens")
    r = h.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"), "n_docs",
        (F.col("d_before") + F.sum("n_docs").over(inside)).alias("docs_fitting"),
        (F.col("t_before") + F.sum("tokens").over(inside)).alias("tokens_fitting"), "d_all", "t_all")
    longer = F.col("d_all") - F.col("docs_fitting")
    kept = F.col("tokens_fitting") + longer * F.col("context_limit")
    return r.select("context_limit", "n_docs", "docs_fitting", longer.alias("docs_longer"),
                    (F.col("docs_fitting") / F.col("d_all")).alias("share_fitting"), "tokens_fitting",
                    kept.alias("tokens_kept"), (F.col("t_all") - kept).alias("tokens_lost"),
                    F.col("d_all").alias("total_docs"), F.col("t_all").alias("total_tokens"))


def at_limit(report: DataFrame, limit: int) -> DataFrame:
    """Documents fitting and tokens kept at any limit, occurring or not: the sums up to the next lower length."""
    low = F.col("context_limit") <= limit
    got = report.agg(F.max(F.when(low, F.col("docs_fitting"))).alias("d"),
                     F.max(F.when(low, F.col("tokens_fitting"))).alias("t"), F.max("total_docs").alias("n"))
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    return got.select(F.lit(limit).alias("context_limit"), d.alias("docs_fitting"),
                      (t + (F.coalesce("n", F.lit(0)) - d) * limit).alias("tokens_kept"))


def quantile(report: DataFrame, q: float) -> DataFrame:
    """Smallest length that at least a share q of the documents does not exceed."""
    return report.filter(F.col("docs_fitting") >= F.ceil(F.col("total_docs") * q)).agg(
        F.min("context_limit").alias("n_tokens"))
