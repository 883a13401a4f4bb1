import zlib
from collections import Counter

from wirefold.llm.shards import assign_shards, write_shards


def test_rows_law_and_mixture(docs, rows):
    got = assign_shards(docs, 4, bits=3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == {0, 1, 2, 3}
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    for source, n in Counter(r[3] for r in rows).items():
        each = Counter(r["shard"] for r in got if r["source"] == source)
        assert all(abs(each[s] - n / 4) < 2 for s in per)


def test_buckets_do_not_matter(docs):
    a = Counter(map(tuple, assign_shards(docs, 5, bits=1).collect()))
    assert a == Counter(map(tuple, assign_shards(docs.repartition(7), 5, bits=9).collect()))
    assert a != Counter(map(tuple, assign_shards(docs, 5, seed=8).collect()))


def test_many_sources_of_one_row_spread(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "cast(id as string) as source")
    got = assign_shards(many, 16).collect()
    assert max(Counter(r["doc_id"] // 1000 for r in got if r["shard"] == 3).values()) < 120


def test_edges(none, clashing, rows, docs, unique, tmp_path):
    assert assign_shards(none).count() == 0
    assert assign_shards(clashing, 3).count() == len(rows)
    few = assign_shards(docs.limit(2), 16).collect()
    assert len(few) == 2 and all(r["slot"] == 0 for r in few)
    write_shards(unique, assign_shards(unique, 2), str(tmp_path / "s"))
    back = unique.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == unique.count() and set(unique.columns) <= set(back.columns)
