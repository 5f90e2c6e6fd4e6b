import random

from pyspark.sql import functions as F

from structura.catalog import QUERIES
from structura.functions import columns as C
from structura.operators import likeness


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b):
    return round(1 - distance(a, b) / max(len(a), len(b)), 6) if a and b else float(a == b)


def test_likest_names_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    names = ["", "a", "cart", "carts", "order", "orders", "stock_order"]
    rows = [(k, rng.choice("xyz"), rng.choice(names)) for k in range(90)] + [(900, None, "cart"), (901, "x", None), (902, "alone", "cart")]
    df = spark.createDataFrame(rows, "id long, block string, name string")
    for k in (1, 3):
        want = set()
        for i, b, n in rows:
            others = sorted((-score(n, m), j) for j, c, m in rows if n is not None and m is not None and b is not None and b == c and i != j)
            want |= {(i, j, -s, r) for r, (s, j) in enumerate(others[:k], 1)}
        got = likeness.likest_names(df, ["block"], "id", "name", C.name_similarity, k)
        assert {tuple(r) for r in got.select("source_id", "target_id", F.round("score", 6), "rank").collect()} == want
    assert likeness.likest_names(df.limit(0), ["block"], "id", "name", C.name_similarity, 2).isEmpty()


def test_equal_names_are_compared_once(spark):
    """A block of 3,000 rows with two names has four pairs of names to compare, not nine million pairs of rows."""
    df = spark.range(3000).select("id", F.lit("b").alias("block"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("name"))
    got = likeness.likest_names(df, ["block"], "id", "name", C.name_similarity, 2)
    assert got.count() == 6000
    assert sorted(tuple(r) for r in got.where("source_id in (0, 5)").collect()) == [(0, 2, 1.0, 1), (0, 4, 1.0, 2), (5, 1, 1.0, 1), (5, 3, 1.0, 2)]


def test_bags_of_turns(spark, tmp_path):
    turns = [(1, 0, "a a b"), (1, 1, "A b b c"), (1, 2, None), (1, 3, " ,"), (1, 5, "a"), (2, 0, "x"), (2, 1, "x"), (None, 0, "x"), (None, 1, "x"), (3, 0, "y " * 500), (3, 1, "y")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.score for r in QUERIES["multiset_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 0.4, (1, 1): 0.0, (1, 2): 0.0, (2, 0): 1.0, (3, 0): 0.002}
