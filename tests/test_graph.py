import random
from collections import deque

import pytest

from structura.operators import edges as E
from structura.operators import graph as G


def reach(own, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in own:
            if a == todo[-1] and b not in seen:
                break
        else:
            todo.pop()
            continue
        seen.add(b)
        todo.append(b)
    return seen


@pytest.fixture(scope="module", params=[1, 2])
def sample(request, spark):
    rng = random.Random(request.param)
    own = {(f"m{rng.randrange(9)}", f"m{rng.randrange(9)}") for _ in range(14)}
    return own, spark.createDataFrame([("p", a, b) for a, b in own], "project string, origin string, end string")


def test_reachable(sample):
    own, df = sample
    want = {(a, b) for a in {x for x, _ in own} for b in reach(own, a)}
    assert {(r.start, r.node) for r in G.reachable(df, by=["project"]).collect()} == want


def test_components_and_cycles(sample):
    own, df = sample
    nodes = {x for e in own for x in e}
    groups = {frozenset(b for b in nodes if b == a or (b in reach(own, a) and a in reach(own, b))) for a in nodes}
    want = {(min(g), n) for g in groups if len(g) > 1 for n in g}
    found = G.strongly_connected(df, ["project"])
    assert {(r.component, r.node) for r in found.collect()} == want
    if want:
        for r in G.cycle_paths(df, found, ["project"]).collect():
            group = next(g for g in groups if r.component in g)
            prev, queue = {}, deque([r.component])
            path = None
            while queue and path is None:
                n = queue.popleft()
                for b in sorted(b for a, b in own if a == n and b in group and a != b):
                    if b == r.component:
                        path = [n]
                        while path[-1] != r.component:
                            path.append(prev[path[-1]])
                        path = path[::-1] + [r.component]
                        break
                    if b not in prev and b != r.component:
                        prev[b] = n
                        queue.append(b)
            assert r.path == path


def test_layers(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "a"), ("a", "c"), ("c.inner", "c"), ("d1", "d2"), ("c", "d1")]
    df = spark.createDataFrame(rows, "origin string, end string")
    got = {(r.kind, tuple(r.path), r.closed_layer) for r in G.layer_violations(df, ["a", "b", "c", "d1 | d2"], closed=["b"]).collect()}
    assert got == {("upward", ("b", "a"), ""), ("skip", ("a", "c"), "b"), ("sibling", ("d1", "d2"), "")}
    assert G.layer_violations(df, ["a", "b"], chains=True).count() == 1
    for bad in (["a | b : c"], ["a", "a"], ["a | "]):
        with pytest.raises(ValueError):
            G.parse_layers(bad)
    with pytest.raises(ValueError):
        G.parse_layers(["a", "b"], ["b"])
    with pytest.raises(ValueError):
        G.parse_layers(["a", "b"], ["z"])


def test_simple_paths(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "os.path"), ("a", "os"), ("b", "sys")], "origin string, end string")
    roots = spark.createDataFrame([("a",), ("c",)], "start string")
    got = {tuple(r.path) for r in G.simple_paths(df, roots, ["os"], ["sys"]).collect()}
    assert got == {("a", "os"), ("a", "b", "c", "os.path"), ("c", "os.path"), ("c", "a", "os")}
    inside = spark.createDataFrame([("a",), ("b",)], "module string")
    assert {tuple(r.path) for r in G.simple_paths(df, roots, ["os"], [], inside).collect()} == {("a", "os"), ("c", "os.path"), ("c", "a", "os")}


def test_fold_and_compare(spark):
    df = spark.createDataFrame([("a", "new1", "1"), ("new1", "new2", "2"), ("new2", "b", "3"), ("lost", "b", "4"), ("b", "a", "5"), ("new1", "a", "6")], "origin string, end string, cause string")
    known = spark.createDataFrame([("a",), ("b",)], "module string")
    folded, dropped = E.fold_new_modules(df, known)
    assert {(r.origin, r.end, r.cause) for r in folded.collect()} == {("a", "b", "3"), ("b", "a", "5")}
    assert {(r.origin, r.end) for r in dropped.collect()} == {("lost", "b")}
    model = spark.createDataFrame([("a", "b"), ("b", "c")], "origin string, end string")
    kinds = lambda policy, **k: {(r.origin, r.end): r.kind for r in E.compare_edges(model, df, policy, known, **k).collect()}
    assert kinds("allow_new_modules") == {("a", "b"): "convergent", ("b", "a"): "divergent", ("b", "c"): "absent", ("lost", "b"): "undecided"}
    assert kinds("layered")[("b", "a")] == "divergent"
    assert kinds("strict", allow=[("new1", "new2")], forbid=[("lost", "b")])[("lost", "b")] == "divergent"
    with pytest.raises(ValueError):
        kinds("other")


def test_packages_and_instances(spark):
    used = spark.createDataFrame([("json",)], "package string")
    target = spark.createDataFrame([("a", "json"), ("a", "re"), ("b", "flask"), ("b", "os")], "origin string, end string")
    got = {(r.origin, r.end): r.kind for r in E.compare_packages(used, target, ignore=["re", "os"], forbid=[("b", "os")]).collect()}
    assert got == {("a", "json"): "convergent", ("b", "flask"): "divergent", ("b", "os"): "divergent"}
    modules = spark.createDataFrame([("m",), ("m.sub",)], "module string")
    ref = spark.createDataFrame([("a", "m.K")], "origin string, end string")
    made = spark.createDataFrame([("a", "m.K"), ("b", "m.sub.L.Inner"), ("m", "b.Q")], "origin string, end string")
    calls = spark.createDataFrame([("b", "m")], "origin string, end string")
    got = {(r.origin, r.end): r.kind for r in E.compare_instances(ref, made, calls, modules, "layered", allow=[("b", "m.sub")]).collect()}
    assert got == {("a", "m.K"): "convergent", ("b", "m.sub.L.Inner"): "allowed", ("m", "b.Q"): "divergent"}
