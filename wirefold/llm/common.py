"""Helpers shared by the operators: column picking, tokenizer files, exact ranks, hashes."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick_places(df: DataFrame, *columns: str) -> dict[str, int]:
    """Where the named columns stand. An exact spelling wins over one in another case, the first of several equal names
    wins."""
    names, at = df.columns, {}
    for old in columns:
        found = [i for i, n in enumerate(names) if n == old] or [
            i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not found:
            raise ValueError(f"column {old} is missing; there are {names}")
        at[old] = found[0]
    return at


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone under the given names (found as by `pick_places`); all other columns go, so names that
    clash with the operators' own cannot matter."""
    places, flat = pick_places(df, *columns.values()), df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {new: places[old] for new, old in columns.items()}
    return flat.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string (null stays null) and the columns named in `more`."""
    got = pick(df, doc_id="doc_id", text="text", **{m: m for m in more})
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def vocabulary_path(path: str | None) -> str:
    """A tokenizer file: the given path, or the public byte-level vocabulary of the tokenizer package."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """One tokenizer per worker process; truncation and padding stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def bucket_ranks(df: DataFrame, group: list[str], bucket: str, order: list, out: str,
                 totals: str | None = None) -> DataFrame:
    """Exact 0-based rank of each row in its group by (bucket, order), without a window over a whole group.

    `bucket` must follow the order. Counts per (group, bucket) give each bucket's first rank; only the rows of one
    bucket are sorted together. Group columns must not be null. `totals` also adds the group's row count.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        *([F.sum("__n").over(whole).alias(totals)] if totals else []))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.join(offsets, keys).withColumn(
        out, F.col("__before") + F.row_number().over(inside) - 1).drop("__before")
