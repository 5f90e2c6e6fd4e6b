import random

from pyspark.sql import functions as F

from structura.operators import module_graph

SCHEMA = "project string, importer string, imported string, path string, lineno int, in_type_checking boolean"


def expected(rows, modules, ignore):
    """All pairs of a statement's names, one by one."""
    placed = []
    for p, importer, name, path, line, tc in rows:
        found = max((m for q, m in modules if q == p and (name == m or name.startswith(m + "."))), key=len, default=None)
        if found is not None:
            placed.append((p, importer, name, path, line, tc, found))
    out = {}
    for p, importer, name, path, line, tc, module in placed:
        deeper = any(o[:2] == (p, importer) and o[3:5] == (path, line) and o[6].startswith(module + ".") for o in placed)
        if module != importer and not (ignore and tc) and not (name == module and deeper):
            out.setdefault((p, importer, module), []).append((path, line))
    return {(*key, f"{min(at)[0]}:{min(at)[1]}") for key, at in out.items()}


def test_edges_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    names = ["a", "a.b", "a.b.c", "a.b.x", "ab", "ab.c", "d.e", "d.e.f.g", "other"]
    modules = [(p, m) for p in "pq" for m in ("a", "a.b", "a.b.c", "ab", "d.e", "d.e.f")]
    rows = [(rng.choice("pq"), rng.choice(["a", "ab", "m"]), rng.choice(names), rng.choice(["f.py", "g.py"]), rng.randrange(10), rng.random() < 0.3) for _ in range(250)]
    imports, own = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(modules, "project string, module string")
    for ignore in (True, False):
        assert {tuple(r) for r in module_graph.module_edges(imports, own, ignore).collect()} == expected(rows, modules, ignore)
    # A statement whose place isn't known hides nothing.
    unknown = spark.createDataFrame([("p", "m", "a", None, None, False), ("p", "m", "a.b", None, None, False)], SCHEMA)
    assert {(r.origin, r.end) for r in module_graph.module_edges(unknown, own).collect()} == {("m", "a"), ("m", "a.b")}
    assert module_graph.module_edges(imports.limit(0), own).isEmpty()


def test_equal_statements_do_not_meet_each_other(spark):
    """300,000 lines at one place would be 22 thousand million pairs; statements meet modules alone."""
    lines = spark.range(300_000).select(
        F.lit("p").alias("project"), F.lit("m").alias("importer"), F.when(F.col("id") % 2 == 0, "a").otherwise("a.b.thing").alias("imported"), F.lit("f.py").alias("path"), F.lit(1).alias("lineno"), F.lit(False).alias("in_type_checking")
    )
    got = module_graph.module_edges(lines, spark.createDataFrame([("p", "a"), ("p", "a.b")], "project string, module string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [tuple(r) for r in got.collect()] == [("p", "m", "a.b", "f.py:1")]
