import random
from collections import Counter

from structura.catalog import QUERIES
from structura.functions import columns as C


def test_bag_likeness_counts_repeats(spark):
    rng = random.Random(2)
    rows = [([rng.choice(["a", "b", "é", "zz"]) for _ in range(rng.randrange(9))], [rng.choice(["a", "b", "é", "y"]) for _ in range(rng.randrange(9))]) for _ in range(120)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", C.bag_likeness("a", "b").alias("score")).collect()
    for r in got:
        x, y = Counter(r.a), Counter(r.b)
        assert r.score == (round(sum((x & y).values()) / sum((x | y).values()), 6) if x and y else 0.0)


def test_rows_of_a_turn_are_one_bag(spark, tmp_path):
    """Words never are rows of their own, whose counts would fill a task's memory."""
    turns = [(1, 0, "a a"), (1, 0, "B"), (1, 1, "b, a"), (1, 1, None), (1, 2, "a"), (2, 0, None), (2, 1, "a"), (3, 5, "w " * 3000), (3, 6, "w v " * 1500)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["multiset_jaccard"](spark, str(tmp_path))
    assert {(r.conv_id, r.turn): r.score for r in got.collect()} == {(1, 0): 0.666667, (1, 1): 0.5, (2, 0): 0.0, (3, 5): 0.333333}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # the two sides of a turn
