"""Queries opN_<name>: each applies one operator to its whole table; SQL twins where DuckDB can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm import (bpe, fingerprints, language, lengths, packing, quality, secret_scan, set_join, shards, spelling,
                          topk_search, vector_join, whitening)
from wirefold.llm.common import documents, id_remainder, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded through the word table and decoded through the table of pieces."""
    coded = bpe.encode(table(spark, sf_dir, "documents"))

    # One pass over the ids: the digest of the ids travels as the key of the row that is decoded.
    keyed = coded.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(
        F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256")).alias("doc_id"), "ids")
    back = bpe.decode(keyed)
    return back.select("doc_id.*", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards under the law `rows`."""
    got = shards.assign_shards(table(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from labels whose id has another remainder than 2."""
    docs = documents(table(spark, sf_dir, "documents"))
    learn = id_remainder(F.col("doc_id"), 4) != 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn)
    got = quality.with_scores(docs, model)
    return got.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and spans of every text, learned from documents whose id has another remainder than 1."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, allowed=id_remainder(F.col("doc_id"), 3) != 1)
    got = language.with_languages(documents(docs), model)
    return got.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"), F.col("lang_spans").alias("spans"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts of the base kinds, digest of the base spans, all spans."""
    got = secret_scan.scan(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"),
                      F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a similarity of 0.75 or more of their shingle sets."""
    got = set_join.similar_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "component_id")


OP7_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
kinds as (select min(doc_id) as rep, s, len(s) as n from (select doc_id, list_sort(s) as s from sets) group by s),
members as (select rep, n, unnest(s) as g from kinds where n > 0),
shared as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from members a join members b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep),
links as (select a, b from shared where 100 * common >= 75 * (na + nb - common)),
edges as (select a, b from links union select b, a from links),
reach(node, seen) as (select rep, rep from kinds where n > 0
  union select r.node, e.b from reach r join edges e on r.seen = e.a),
comp as (select node, min(seen) as component from reach group by node)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(c.component, d.doc_id) as component_id
from sets d left join kinds k on list_sort(d.s) = k.s and k.n > 0 left join comp c on c.node = k.rep
"""


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


OP8_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select vec_id, e from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and list_dot_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, seen) as (select vec_id, vec_id from v union select r.node, l.b from reach r join links l on r.seen = l.a),
comp as (select node, min(seen) as c from reach group by node),
deg as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(d.n, 0)::bigint as n_links, c.c as component_id, v.vec_id = c.c as kept
from v join comp c on c.node = v.vec_id left join deg d on d.a = v.vec_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context-limit report over all documents, one row per length that occurs."""
    return lengths.context_report(lengths.histogram(lengths.token_lengths(table(spark, sf_dir, "documents"))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every vector whose id 50 divides."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256)


OP11_SQL = """
with v as (select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or not isfinite(e::double))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all texts with each word's near words, form and root."""
    got = spelling.variants(table(spark, sf_dir, "documents"))
    return got.select("word", "form", "root", "n", "n_near", "form_n")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector, fitted to all vectors."""
    return whitening.whitened_table(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_quality, op4_language, op5_fingerprints, op6_secrets,
                                   op7_set_join, op8_vector_join, op9_token_counts, op10_packing, op11_topk,
                                   op12_spelling, op13_whitening)}
ORACLE: dict[str, str] = {"op7_set_join": OP7_SQL, "op8_vector_join": OP8_SQL, "op11_topk": OP11_SQL}
