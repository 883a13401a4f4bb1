import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + str(r.randrange(50)) * (r.random() < 0.5))
        if r.random() < 0.1:
            out[-1] += r.choice([".", ".\n", "!", ", "])
    return " ".join(out)


TRICKY = [None, "", " ", "\n\n", "a", "a  b", "x   y   z", " <|endoftext|>  <|endoftext|> ", "tab\t\tnew\n \nline ",
          "café 日本語 русский \U0001f600", "12345 67", "don't we'll", "z" * 5000,
          "w " * 3000, " wide  space", "A-b_C", "!!! ???", " lead", "trail  "]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies."""
    texts = TRICKY + [prose(i, 40 + 7 * i) for i in range(25)] + [prose(3, 61), prose(3, 61), prose(99, 9000)]
    base = prose(5, 400).split(" ")
    texts += [" ".join(base), " ".join(base[:200] + ["changed"] + base[201:]), " ".join(base[10:]), " ".join(base[:300])]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s", "s", "t"][i % 4], None if t is None else len(t))
           for i, t in enumerate(texts)]
    return out + [(None, "no id here at all", "en", "s", 17), (None, None, None, None, None), out[20], out[20]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(spark, rows):
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return spark.createDataFrame(out, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(docs):
    """Extra columns with the operators' own names, and with names that differ in case only."""
    from pyspark.sql import functions as F

    more = ["size", "rank", "n", "bucket", "score", "shard", "TEXT", "Doc_Id", "ids", "set_id", "length", "key", "s", "c0"]
    names = [*docs.columns, *more]
    return docs.select("*", *[F.lit(-7).alias(f"x{i}") for i in range(len(more))]).toDF(*names)
