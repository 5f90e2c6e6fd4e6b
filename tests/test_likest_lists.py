import random

import pytest
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import likeness
from tests.test_likeness import score


@pytest.mark.parametrize("length", [512, 3, 1])
def test_lists_give_what_all_pairs_give(spark, monkeypatch, length):
    """Blocks of one name, of many names and of ties that interleave between equally like names."""
    monkeypatch.setattr(likeness, "LIST", length, raising=False)
    rng = random.Random(5)
    names = ["aaa", "aab", "aac", "aba", "baa", "caa", "xyz", "", "abcdef", "abcdeg", "order", "orders"]
    rows = [(k, rng.choice([1, 2]), rng.choice("xy"), rng.choice(names)) for k in range(80)] + [(500, 3, "x", "aaa"), (501, None, "x", "aaa")]
    df = spark.createDataFrame(rows, "id long, size int, brand string, name string")
    for k in (1, 2, 4):
        want = set()
        for i, s, b, n in rows:
            others = sorted((-score(n, m), j) for j, t, c, m in rows if s is not None and (s, b) == (t, c) and i != j)
            want |= {(i, j, -x, r) for r, (x, j) in enumerate(others[:k], 1)}
        got = likeness.likest_names(df, ["brand", "size"], "id", "name", C.name_similarity, k)
        assert {tuple(r) for r in got.select("source_id", "target_id", F.round("score", 6), "rank").collect()} == want


def test_pairs_of_names_are_not_rows(spark):
    """A block of 700 names gives 700 rows for each of its two lists, not 490,000."""
    df = spark.range(700).select("id", F.lit("b").alias("block"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    got = likeness.likest_names(df, ["block"], "id", "name", C.name_similarity, 1)
    assert tuple(got.where("source_id = 10").first()) == (10, 100, 0.75, 1)
    assert got.count() == 700
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(sort_array(transform(others" in plan  # a list's best leave the join
