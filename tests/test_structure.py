import random
from collections import Counter

import pytest

from structura.operators import aliases, dataflow, graph, linearize, paths, selection


def hierarchy(seed, n):
    """Ordered bases of n classes in groups, diamonds and contradictions among them."""
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        names = [f"c{j}" for j in range(k)]
        out[f"c{k}"] = rng.sample(names, min(len(names), rng.choice([0, 1, 1, 2, 2, 3])))
    return out


def real_orders(classes):
    """What Python itself makes of them; None where it refuses."""
    made, out = {}, {}
    for name, bases in classes.items():
        try:
            made[name] = None if any(made[b] is None for b in bases) else type(name, tuple(made[b] for b in bases), {})
        except TypeError:
            made[name] = None
        out[name] = None if made[name] is None else [c.__name__ for c in made[name].__mro__ if c is not object]
    return out


def bases_of(spark, worlds):
    rows = [(p, c, k, b) for p, classes in worlds.items() for c, bases in classes.items() for k, b in enumerate(bases)]
    return spark.createDataFrame(rows, "project string, class string, place int, base string")


def test_orders_are_those_of_python(spark):
    worlds = {f"p{k}": hierarchy(k, 16) for k in range(8)}
    got = {(r.project, r["class"]): (r.status, r.mro) for r in linearize.linearize(bases_of(spark, worlds), ["project"]).collect()}
    for p, classes in worlds.items():
        want = real_orders(classes)
        named = {c for c, b in classes.items() if b} | {b for bs in classes.values() for b in bs}
        assert {c: got[(p, c)][1] for c in named} == {c: want[c] for c in named}
        assert all((got[(p, c)][0] == "ok") == (want[c] is not None) for c in named)
    assert {s for s, _ in got.values()} == {"ok", "inconsistent"}


def test_cycles_repeats_and_nothing(spark):
    rows = bases_of(spark, {"p": {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a", "e"], "f": ["e", "e"], "g": ["f"], "h": ["e"]}}).unionByName(spark.createDataFrame([("p", None, 0, "e"), ("p", "x", 0, None)], "project string, class string, place int, base string"))
    got = {r["class"]: r.status for r in linearize.linearize(rows, ["project"]).collect()}
    assert got == {"a": "cycle", "b": "cycle", "c": "cycle", "d": "cycle", "e": "ok", "f": "inconsistent", "g": "inconsistent", "h": "ok"}
    assert linearize.linearize(rows.where("false"), ["project"]).collect() == []


def test_members_come_from_the_first_that_has_them(spark):
    classes = hierarchy(3, 20)
    orders = linearize.linearize(bases_of(spark, {"p": classes}), ["project"])
    rng = random.Random(1)
    members = [("p", c, f"m{k}") for c in classes for k in range(5) if rng.random() < 0.4]
    got = {(r["class"], r.name): r.holder for r in linearize.found_first(orders, spark.createDataFrame(members, "project string, holder string, name string"), ["project"]).collect()}
    own = {(c, m) for _, c, m in members}
    want = {(c, f"m{k}"): next(h for h in mro if (h, f"m{k}") in own) for c, mro in real_orders(classes).items() if mro for k in range(5) if any((h, f"m{k}") in own for h in mro)}
    named = {c for c, b in classes.items() if b} | {b for bs in classes.values() for b in bs}
    assert got == {k: v for k, v in want.items() if k[0] in named}


def test_chains_of_names(spark):
    rows = [("long", f"n{k}", f"n{k + 1}") for k in range(1000)] + [("loop", f"n{k}", f"n{(k + 1) % 7}") for k in range(7)] + [("loop", "into", "n3"), ("loop", "own", "own"), ("loop", "out", "other"), ("tie", "a", "z"), ("tie", "a", "b"), (None, "q", "r")]
    got = {(r.project, r.name): (r.final, r.hops, r.cyclic) for r in aliases.follow(spark.createDataFrame(rows, "project string, name string, target string"), ["project"]).collect()}
    assert all(got[("long", f"n{k}")] == ("n1000", 1000 - k, False) for k in range(1000))
    assert all(got[("loop", n)] == (None, None, True) for n in [*(f"n{k}" for k in range(7)), "into", "own"])
    assert got[("loop", "out")] == ("other", 1, False) and got[("tie", "a")] == ("b", 1, False)


def test_names_are_rewritten_by_their_longest_alias(spark):
    pointers = spark.createDataFrame([("p", "pkg.Shape", "pkg.shapes.Shape"), ("p", "pkg.shapes", "core.geometry"), ("p", "short", "pkg"), ("p", "a", "a.b"), ("p", "x", "y"), ("p", "y", "x")], "project string, name string, target string")
    names = spark.createDataFrame([("p", n, 1) for n in ("pkg.Shape.area", "short.Shape", "pkg.other", "Shape", "x.f", "pkgs.Shape", "pkg.shapes.Line")] + [("q", "pkg.Shape", 1)], "project string, name string, extra int")
    got = {(r.project, r.name): r.resolved for r in aliases.rewritten(names, pointers, ["project"]).collect()}
    assert got == {
        ("p", "pkg.Shape.area"): "core.geometry.Shape.area", ("p", "short.Shape"): "core.geometry.Shape", ("p", "pkg.other"): "pkg.other", ("p", "Shape"): "Shape",
        ("p", "x.f"): None, ("p", "pkgs.Shape"): "pkgs.Shape", ("p", "pkg.shapes.Line"): "core.geometry.Line", ("q", "pkg.Shape"): "pkg.Shape",
    }


def random_graph(seed, n, m, back=True):
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b and (back or a < b):
            edges.add((f"n{a:02}", f"n{b:02}"))
    return sorted(edges)


def test_reaching_definitions(spark):
    edges = random_graph(5, 14, 24)
    rng = random.Random(6)
    defs = sorted({(f"n{rng.randrange(14):02}", rng.choice("xyz")) for _ in range(16)})
    want = set()
    for d, v in defs:
        todo, seen = [b for a, b in edges if a == d], set()
        while todo:
            node = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            want.add((node, v, d))
            if (node, v) not in defs:
                todo += [b for a, b in edges if a == node]
    rows = spark.createDataFrame([("f", a, b) for a, b in edges], "fn string, origin string, end string")
    sets = spark.createDataFrame([("f", n, v) for n, v in defs], "fn string, node string, variable string")
    assert {(r.node, r.variable, r.definition) for r in dataflow.reaching(rows, sets, ["fn"]).collect()} == want


def test_type_tests_that_decide(spark):
    """t = type(x) at 1; 2 prints t; 3 sets t again; 4 branches on t; 5 asks isinstance at once; 6 shows isinstance."""
    edges = spark.createDataFrame([("f", a, b) for a, b in [(1, 2), (2, 4), (4, 5), (5, 6)]] + [("g", a, b) for a, b in [(1, 3), (3, 4)]], "fn string, origin int, end int")
    defs = spark.createDataFrame([("f", 1, "t"), ("g", 1, "t"), ("g", 3, "t")], "fn string, node int, variable string")
    tests = spark.createDataFrame([("f", 1, "t", "type"), ("g", 1, "t", "type"), ("g", 3, "t", "type"), ("f", 5, None, "isinstance"), ("f", 6, None, "isinstance")], "fn string, node int, variable string, callee string")
    branches = spark.createDataFrame([("f", 4, "t"), ("g", 4, "t"), ("f", 5, None)], "fn string, node int, variable string")
    got = {(r.fn, r.node): r.branches for r in dataflow.deciding(edges, tests, defs, branches, ["fn"]).collect()}
    assert got == {("f", 1): True, ("g", 1): False, ("g", 3): True, ("f", 5): True, ("f", 6): False}


@pytest.mark.parametrize("seed", [1])
def test_path_counts_are_the_lists_lengths(spark, seed):
    edges = random_graph(seed, 13, 26) + [("n01", "out.a"), ("n05", "out.b"), ("n09", "out.a"), ("n02", "ok.x"), ("out.a", "n03"), ("n03", "n03")]
    rows = spark.createDataFrame([(y, a, b) for y in (1, 2) for k, (a, b) in enumerate(edges) if y == 1 or k % 3], "year int, origin string, end string")
    roots = spark.createDataFrame([(y, f"n{k:02}") for y in (1, 2) for k in (0, 4, 7)] + [(1, "nowhere")], "year int, start string")
    inside = spark.createDataFrame([(y, f"n{k:02}") for y in (1, 2) for k in range(12)], "year int, module string")
    for internal in (None, inside):
        listed = graph.simple_paths(rows, roots, ["out"], ["ok"], internal, ["year"]).collect()
        want = Counter((r.year, r.start, r.target, r.prefix) for r in listed)
        got = {(r.year, r.start, r.target, r.prefix): int(r.paths) for r in paths.path_counts(rows, roots, ["out"], ["ok"], internal, ["year"]).collect()}
        assert got == dict(want) and want
        least = {}
        for r in listed:
            least[(r.year, r.start, r.target)] = min(len(r.path), least.get((r.year, r.start, r.target), 99))
        short = {(r.year, r.start, r.target): r.path for r in paths.shortest_paths(rows, roots, ["out"], ["ok"], internal, ["year"]).collect()}
        assert {k: len(p) for k, p in short.items()} == least
        assert all(tuple(p) in {tuple(r.path) for r in listed if (r.year, r.start, r.target) == k} for k, p in short.items())


def test_counts_beyond_any_list(spark):
    """Six stages of eighty nodes, each with edges to all of the next: 80 ** 6 paths."""
    edges = [("start", f"n0_{b}") for b in range(80)] + [(f"n{k}_{a}", f"n{k + 1}_{b}") for k in range(5) for a in range(80) for b in range(80)] + [(f"n5_{a}", "out") for a in range(80)]
    rows = spark.createDataFrame(edges, "origin string, end string")
    got = paths.path_counts(rows, spark.createDataFrame([("start",)], "start string"), ["out"]).collect()
    assert [(r.start, r.target, int(r.paths)) for r in got] == [("start", "out", 80**6)]
    assert paths.path_counts(rows, spark.createDataFrame([("start",)], "start string"), ["none"]).collect() == []


def taken_in_turn(rows, limit):
    groups = sorted({g for g, _ in rows})
    queues = {g: sorted(i for h, i in rows if h == g) for g in groups}
    out = []
    while len(out) < limit and any(queues.values()):
        for g in groups:
            queues[g] = [i for i in queues[g] if i not in {j for _, j in out}]
            if queues[g] and len(out) < limit:
                out.append((g, queues[g].pop(0)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_turns_without_repeats(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"g{rng.randrange(5)}", rng.randrange(60)) for _ in range(150)})
    limit = rng.choice([1, 7, 40, 100])
    df = spark.createDataFrame([(g, i, "x") for g, i in rows] + [(rows[0][0], rows[0][1], "x"), (None, 1, "y")], "kind string, id int, more string")
    got = [(r.kind, r.id) for r in selection.in_turn_once(df, "kind", ["id"], "id", limit).orderBy("turn").collect()]
    assert got == taken_in_turn(rows, limit)
