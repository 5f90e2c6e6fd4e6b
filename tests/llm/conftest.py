import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


def words(rng, n):
    return " ".join(rng.choice("the of and rein thond erble ingtion haß été ñan könig 中文 1234 it's we'll x-y".split()) + rng.choice(["", "", ",", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, exact and near copies, shared passages, ties and odd white space."""
    rng = random.Random(5)
    shared = words(rng, 150)
    out = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "A"), (6, "a b"), (7, " a  b "), (8, "a b"), (9, "é ü \U0001f600\U0001f600"),
        (10, "  's 't're  \n\n we've I'll 'd  "), (11, "<|endoftext|> is text <|endoftext|>"), (12, "x" * 5000), (13, "ab " * 4000), (14, "\n" * 3000 + "end"),
        (15, words(rng, 9000)), (16, shared), (17, words(rng, 60) + shared + words(rng, 70)), (18, words(rng, 40) + shared + shared),
    ]
    for k in range(20, 60):
        out.append((k, words(rng, rng.randint(1, 400))))
    for k in range(60, 80):
        out.append((k, out[k - 40][1]))
    for k in range(80, 95):
        out.append((k, out[k - 60][1].replace(" of ", " off ", 1)))
    for k in range(95, 100):
        out.append((k, out[k - 60][1].replace(" ", "\n ", 2)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The rows with repeated rows, null identifiers and extra columns whose names clash with internal ones."""
    base = [Row(doc_id=i, text=t, rank=1, key="k", part=2, bucket="b", _id=3, fp="f", edge=True, rest=None) for i, t in [*rows, *rows[:5], (None, "null id"), (None, "null id"), (None, None)]]
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("bucket", T.StringType()), T.StructField("_id", T.IntegerType()), T.StructField("fp", T.StringType()), T.StructField("edge", T.BooleanType()), T.StructField("rest", T.StringType())])
    return spark.createDataFrame(base, kinds).repartition(4)


@pytest.fixture(scope="session")
def odd_rows(rows):
    return [*rows, *rows[:5], (None, "null id"), (None, "null id"), (None, None)]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    """Sorted rows as tuples, so that results compare whatever the order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
