import re

import pytest
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.functions import globs


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    return value


def test_names(one):
    lit = F.lit
    assert one(C.module_similarity(lit("a.b.c"), lit("a.b.d.e"))) == 0.5
    assert one(C.module_similarity(lit(""), lit(""))) == 1.0 and one(C.module_similarity(lit("a"), lit(""))) == 0.0
    assert one(C.module_distance(lit("a.b.c"), lit("a.d"))) == 3
    assert one(C.prefixes(lit("a.b.c"))) == ["a", "a.b", "a.b.c"] and one(C.prefixes(lit(""))) == [""]
    for name, module, want in (("a.b", "a", True), ("ab", "a", False), ("a", "a", True), ("a", "", False), ("", "", True)):
        assert one(C.in_module(lit(name), lit(module))) is want
    assert one(C.first_prefix(lit("os.path"), ["sys", "os", "os.path"])) == "os"
    assert one(C.strip_package(lit("pkg.models"), "pkg")) == "models" and one(C.strip_package(lit("pkg"), "pkg")) == ""
    assert one(C.class_of(lit("A.B.f"))) == "B" and one(C.class_of(lit("f"))) == ""


def test_likeness(one):
    lit = F.lit
    assert one(C.name_similarity(lit("žluť"), lit("zlut"))) == 0.5
    assert one(C.name_similarity(lit(""), lit(""))) == 1.0 and one(C.name_similarity(lit(""), lit("a"))) == 0.0
    a, b = F.create_map(lit("x"), lit(2), lit("y"), lit(1)), F.create_map(lit("x"), lit(1), lit("z"), lit(3))
    assert one(C.bag_jaccard(a, b)) == pytest.approx(1 / 6)
    assert one(C.bag_jaccard(a, F.create_map().cast("map<string,int>"))) == 0.0
    assert one(C.set_jaccard(C.word_set(lit("The cat, the HAT")), C.word_set(lit("the hat")))) == pytest.approx(2 / 3)


def test_signature_keys(one):
    lit = F.lit
    assert one(C.signature_key(*map(lit, (0, 2)), lit(False), lit(0), lit(True), lit(1), lit(0))) == "p0-a2-v0-k0-w1-d1-kd0"
    assert one(C.extras_only(lit("p0-a2-v0-k0-w0-d0-kd0"), lit("p0-a3-v0-k0-w0-d1-kd0"))) is True
    assert one(C.extras_only(lit("p0-a2-v0-k0-w0-d0-kd0"), lit("p0-a3-v0-k0-w0-d0-kd0"))) is False
    assert one(C.extras_only(lit("-"), lit("p0-a3-v0-k0-w0-d0-kd0"))) is False
    assert one(C.same_counts(lit("p0-a2-v0-k0-w0-d0-kd0"), lit("p0-a2-v0-k0-w0-d0-kd0"))) is True
    assert one(C.first_parameter_differs(lit("p0-a2-v0-k0-w0-d0-kd0"), lit("p0-a1-v0-k0-w0-d0-kd0"))) is True


def test_order(one):
    stages = F.array(*map(F.lit, ["a", "x", "b", "b", "c"]))
    assert one(C.in_order(stages, ["a", "b", "c"])) == 3 and one(C.in_order(stages, ["b", "a"])) == 1
    assert one(C.first_out_of_order(stages, ["a", "c", "b"])) is True and one(C.first_out_of_order(stages, ["a", "b", "c"])) is False


def test_edges(one):
    assert tuple(one(C.parse_edge(F.lit(" a.b ->  c ")))) == ("a.b", "c")
    assert one(C.parse_edge(F.lit("a -> b -> c"))) is None and one(C.parse_edge(F.lit("-> b"))) is None


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("**", ["a", "a/b", ""], []), ("*.py", ["x.py"], ["a/x.py", "x.pyc"]), ("**/x.py", ["x.py", "a/b/x.py"], ["x.py/y"]), ("a/**", ["a", "a/b/c"], ["ab"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]), ("t?st.py", ["test.py"], ["t/st.py", "tst.py"]), ("a+b/[c].py", ["a+b/[c].py"], ["aab/c.py"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    rows = spark.createDataFrame([(p,) for p in [*yes, *no]], "path string")
    assert {r.path for r in rows.where(globs.matches_any("path", [pattern])).collect()} == set(yes)
    assert all(re.search(globs.glob_regex(pattern), p) for p in yes)
