import random

import pytest

from structura.operators import dataflow


def expected(edges, sets, traced):
    """Each definition's way, node by node."""
    out = set()
    for *by, d, v in sets:
        if traced is not None and (*by, d, v) not in traced:
            continue
        todo, seen = [d], set()
        while todo:
            at = todo.pop()
            for *other, a, b in edges:
                if other == by and a == at and b not in seen:
                    seen.add(b)
                    if (*by, b, v) not in sets:
                        todo.append(b)
        out |= {(*by, n, v, d) for n in seen}
    return out


def programs(seed):
    rng = random.Random(seed)
    edges, sets = set(), set()
    for p in "ab":
        for f in range(6):
            n = rng.choice([1, 4, 9])
            edges |= {(p, f, rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([0, 6, 14]))}
            sets |= {(p, f, rng.randrange(n), rng.choice("xyz")) for _ in range(rng.choice([0, 3, 7]))}
    return edges, sets


@pytest.mark.parametrize("small,block", [(1000, 16384), (1000, 20), (12, 20), (0, 20)])
def test_blocks_and_joins_reach_the_same(spark, monkeypatch, small, block):
    monkeypatch.setattr(dataflow, "SMALL", small, raising=False)
    monkeypatch.setattr(dataflow, "BLOCK", block, raising=False)
    edges, sets = programs(9)
    traced = {s for s in sets if s[3] == "x"} | {("a", 0, 99, "x")}
    e = spark.createDataFrame([*edges, *list(edges)[:5], ("a", 1, None, 2), (None, 1, 1, 2)], "project string, fn int, origin long, end int")
    s = spark.createDataFrame([*sets, *list(sets)[:5], ("a", 1, None, "x"), (None, 1, 1, "x")], "project string, fn int, node int, variable string")
    t = spark.createDataFrame(list(traced), "project string, fn int, node int, variable string")
    by = ["project", "fn"]
    assert sorted(tuple(r) for r in dataflow.reaching(e, s, by).collect()) == sorted(expected(edges, sets, None))
    assert sorted(tuple(r) for r in dataflow.reaching(e, s, by, t).collect()) == sorted(expected(edges, sets, traced))
    one = [(a, b) for p, f, a, b in edges if (p, f) == ("a", 1)], [(n, v) for p, f, n, v in sets if (p, f) == ("a", 1)]
    got = dataflow.reaching(spark.createDataFrame(one[0], "origin int, end int"), spark.createDataFrame(one[1], "node int, variable string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(one[0], set(one[1]), None))
    assert dataflow.reaching(e.limit(0), s, by).isEmpty() and dataflow.reaching(e, s.limit(0), by).isEmpty()


def test_small_programs_are_written_once(spark, monkeypatch):
    """300 programs of 30 nodes in a row took 30 rounds over all of them."""
    rounds = []
    for method in ("keep", "append"):
        def counted(self, *args, own=getattr(dataflow.Rounds, method)):
            rounds.append(own)
            return own(self, *args)

        monkeypatch.setattr(dataflow.Rounds, method, counted)
    n = spark.range(300 * 30).selectExpr("id div 30 AS fn", "cast(id % 30 as int) AS node")
    got = dataflow.reaching(n.where("node < 29").selectExpr("fn", "node AS origin", "node + 1 AS end"), n.where("node = 0").selectExpr("fn", "node", "'v' AS variable"), ["fn"])
    assert got.count() == 300 * 29 and got.where("definition <> 0").isEmpty()
    assert len(rounds) <= 2


def test_only_tests_are_followed(spark, monkeypatch):
    """Of 40 definitions in a row one keeps a type test: its way alone is found, and ends where the variable is set again."""
    found = []

    def counted(*args, own=dataflow.reaching):
        found.append(own(*args))
        return found[-1]

    monkeypatch.setattr(dataflow, "reaching", counted)
    nodes = spark.range(40).selectExpr("'f' AS fn", "cast(id as int) AS node")
    sets = nodes.selectExpr("fn", "node", "if(node in (10, 20), 't', concat('v', node)) AS variable")
    tests = nodes.where("node in (10, 30)").selectExpr("fn", "node", "'t' AS variable")
    for branch, want in ((15, True), (20, True), (21, False)):
        got = dataflow.deciding(nodes.where("node < 39").selectExpr("fn", "node AS origin", "node + 1 AS end"), tests, sets, nodes.where(f"node = {branch}").selectExpr("fn", "node", "'t' AS variable"), ["fn"])
        assert {r.node: r.branches for r in got.collect()} == {10: want, 30: False}
        assert found.pop().count() == 10
