import random

import pytest

from structura.catalog import ORACLE_SQL, QUERIES
from structura.operators import likeness
from tests.test_likeness import score


def wanted(rows):
    """The three likest of all other parts; null scores last, ties by key."""
    name = {k: None if n is None or t is None else f"{n} {t}" for k, n, _, t, _ in rows if k is not None}
    like = lambda a, b: None if a is None or b is None else score(a, b)
    out = set()
    for i, n in name.items():
        others = sorted(((x := like(n, m)) is None, -(x or 0), j, x) for j, m in name.items() if i != j)
        out |= {(i, j, x, r) for r, (_, _, j, x) in enumerate(others[:3], 1)}
    return out


def got(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    listed = [(r.source_id, r.target_id, None if r.score is None else round(r.score, 6), r["rank"]) for r in QUERIES["name_similarity_topk"](spark, str(path)).collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def test_parts_of_other_brands_and_sizes_are_partners(spark, tmp_path):
    rows = [(1, "red bolt", "Brand#1", "SMALL", 1), (2, "red bolt", "Brand#2", "SMALL", 1), (3, "red bolts", "Brand#1", "SMALL", 2), (4, "cold ring", "Brand#1", "SMALL", 1), (5, "red bolt", None, "SMALL", None)]
    found = got(spark, tmp_path, rows)
    assert found == wanted(rows) and {(1, 2, 1.0, 1), (1, 5, 1.0, 2), (1, 3, 0.933333, 3)} <= found
    assert "p_size" not in ORACLE_SQL["name_similarity_topk"].split("FROM p a")[1]


def test_rare_and_frequent_names_over_a_whole_table(spark, tmp_path):
    """Names of 1, up to 3 and many parts, with ties between names, nulls in each column and a part without a key."""
    rng = random.Random(11)
    names = ["red bolt", "red bolts", "rod bolt", "cold ring", "old ring", "", "gear"]
    rows = [(k, rng.choice(names), rng.choice(["Brand#1", "Brand#2", None]), rng.choice(["SMALL", "LARGE"]), rng.choice([1, 2, None])) for k in range(60)]
    rows += [(100 + k, f"part {k}", "Brand#1", "PROMO", 1) for k in range(12)] + [(200, None, "Brand#1", "SMALL", 1), (-7, "gear", "Brand#1", None, 1), (None, "gear", "Brand#1", "SMALL", 1), (None, None, None, None, None)]
    assert got(spark, tmp_path / "many", rows) == wanted(rows)
    for n in range(6):  # so few parts that those without a name are needed, too
        few = [(k, "a" * k, "x", "t", k) for k in range(n)] + [(k, None, "x", "t", 1) for k in (-1, 10, 11)]
        assert got(spark, tmp_path / f"few{n}", few) == wanted(few)
    assert got(spark, tmp_path / "none", rows[:0]) == set()


@pytest.mark.parametrize("length", [5, 2])
def test_parts_that_ask_meet_every_list(spark, tmp_path, monkeypatch, length):
    monkeypatch.setattr(likeness, "LIST", length)
    rows = [(k, f"{'abc'[k % 3]}{'xyzuv'[k % 5]} {k * k % 17}", "x", "t", 1) for k in range(30)] + [(50 + k, "ax 0", "y", "t", 2) for k in range(4)]
    assert got(spark, tmp_path, rows) == wanted(rows)
