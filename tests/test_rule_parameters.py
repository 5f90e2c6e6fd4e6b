import re

import pytest
from pyspark.sql import functions as F

from structura.operators import matching
from structura.plans import member_rules, principles, rules as R  # noqa: F401  member_rules registers its kinds
from structura.sources import markers as M
from structura.sources import python_source as P

MODEL = "from typing import Annotated\nclass A:\n    pass\nclass Port:\n    def send(self, x): ...\n    @classmethod\n    def make(cls): ...\n"
TARGET = """import functools
from dataclasses import dataclass, InitVar
from typing import ClassVar

class Base:
    def old(self): ...
    def shared(self): ...

class Left(Base):
    level = 1
    def shared(self, left): ...

class Right(Base):
    @property
    def level(self): ...
    def shared(self, right): ...

class A(Left, Right):
    limit: int = 3
    def __init__(self):
        self.size = 1
        setattr(self, 'later', 2)
    @property
    def area(self): ...
    @functools.cached_property
    def cost(self): ...
    lazy = property(lambda self: 1, lambda self, v: None)
    @classmethod
    def prepare(cls):
        setattr(cls, 'ready', True)

class Port:
    def send(self, x): ...
    def make(self): ...

@dataclass
class Data:
    width: int
    kind: ClassVar[str] = ''
    seed: InitVar[int] = 0
"""


@pytest.fixture(scope="module")
def world(spark):
    rows = [("ref", "source", "m.py", MODEL + "class Data:\n    pass\n"), ("t", "target", "m.py", TARGET)]
    facts = P.extract(spark.createDataFrame(rows, "project string, role string, path string, text string")).cache()
    sources = P.entities(facts.where("role = 'source'"))
    ids = {r.qualname: r.canonical_id for r in sources.where("kind = 'class'").collect()}
    own = {r.qualname: r.canonical_id for r in P.entities(facts.where("role = 'target'")).where("kind = 'class'").collect()}
    found = spark.createDataFrame([("t", i, own[q], "MATCHED", 1.0, "explicit") for q, i in ids.items()], matching.SCHEMA)
    return facts, found.cache(), ids


def judged(world, rules):
    facts, matches, ids = world
    made = [R.Rule(f"r{k}", kind, ids[source], params=params) for k, (kind, source, params) in enumerate(rules)]
    got = {r.rule_id: (r.status, r.reason) for r in R.evaluate(facts, matches, made).collect()}
    return [got[f"r{k}"] for k in range(len(rules))]


def test_attributes(world):
    cases = [
        ({"name": "size"}, ("OK", None)), ({"name": "size", "storage": "class"}, ("FAILED", "storage_mismatch")), ({"name": "gone"}, ("FAILED", "missing_attribute")), ({"name": "gone", "allow_missing": True}, ("SKIPPED", "optional_attribute_missing")),
        ({"name": "area"}, ("FAILED", "property_not_allowed")), ({"name": "area", "allow_property": True}, ("OK", None)), ({"name": "area", "allow_property": True, "require_writable": True}, ("FAILED", "not_writable")),
        ({"name": "lazy", "allow_property": True, "require_writable": True}, ("OK", None)), ({"name": "cost"}, ("FAILED", "missing_attribute")), ({"name": "cost", "descriptor_kinds": ["cached_property"]}, ("OK", None)),
        ({"name": "later"}, ("FAILED", "missing_attribute")), ({"name": "later", "include_dynamic_attributes": True}, ("OK", None)), ({"name": "ready", "include_dynamic_attributes": True, "storage": "class"}, ("OK", None)),
        ({"name": "limit", "annotation": "int"}, ("OK", None)), ({"name": "limit", "annotation": "str"}, ("FAILED", "annotation_mismatch")), ({"name": "level"}, ("OK", None)), ({"name": "level", "declared_only": True}, ("FAILED", "missing_attribute")),
    ]
    assert judged(world, [("attribute_contract", "A", p) for p, _ in cases]) == [want for _, want in cases]
    data = [({"name": "width", "storage": "instance"}, ("FAILED", "storage_mismatch")), ({"name": "width", "storage": "instance", "interpret_dataclass_fields": True}, ("OK", None)), ({"name": "kind", "storage": "instance", "interpret_dataclass_fields": True}, ("FAILED", "storage_mismatch")), ({"name": "seed", "interpret_dataclass_fields": True}, ("FAILED", "missing_attribute"))]
    assert judged(world, [("attribute_contract", "Data", p) for p, _ in data]) == [want for _, want in data]


def test_absence(world):
    bad, good = ("FAILED", "forbidden_member"), ("OK", None)
    cases = [
        ({"names": ["old"]}, bad), ({"names": ["old"], "declared_only": True}, good), ({"names": ["old"], "member_kind": "attribute"}, good), ({"names": ["old"], "member_kind": "method"}, bad), ({"names": ["old"], "storage": "class"}, good),
        ({"names": ["area"], "member_kind": "property"}, bad), ({"names": ["area"], "member_kind": "method"}, good), ({"names": ["size"], "storage": "instance"}, bad), ({"names": ["size"], "storage": "class"}, good), ({"names": ["level"], "storage": "class"}, bad),
        ({"names": ["later"]}, good), ({"names": ["later"], "include_dynamic_attributes": True}, bad), ({"names": ["cost"], "member_kind": "property"}, good), ({"names": ["cost"], "member_kind": "property", "descriptor_kinds": ["cached_property"]}, bad),
        ({"pattern": "s.*e"}, bad), ({"pattern": "zz.*"}, good),
    ]
    assert judged(world, [("member_absence", "A", p) for p, _ in cases]) == [want for _, want in cases]


def test_sets_of_methods_and_members(world):
    cases = [
        ("method_set", {"names": ["shared", "old"], "min_count": 2}, "OK"), ("method_set", {"names": ["shared"], "declared_only": True}, "FAILED"), ("method_set", {"method_kind": "class", "max_count": 1}, "OK"), ("method_set", {"pattern": "prep.*", "method_kind": "instance"}, "FAILED"),
        ("member_set", {"names": ["size", "limit"], "member_kinds": ["attribute"], "min_count": 2}, "OK"), ("member_set", {"names": ["area"], "allow_property": False}, "FAILED"), ("member_set", {"member_kinds": ["constructor"], "max_count": 1}, "OK"), ("member_set", {"names": ["size"], "storage": "class"}, "FAILED"),
    ]
    assert [s for s, _ in judged(world, [(k, "A", p) for k, p, _ in cases])] == [want for _, _, want in cases]


def test_methods_come_from_the_first_in_order(world):
    """shared is Left's, though Right and Base are as near or define it too."""
    facts, matches, _ = world
    ctx = R.Context(facts, matches)
    own = ctx.offered().where("name = 'shared'").collect()
    assert {r.owner_id.split(":")[3]: [p.name for p in r.params][-1] for r in own if r.owner_id.split(":")[3] in ("A", "Right")} == {"A": "left", "Right": "right"}


def test_kinds_of_protocol_methods(world):
    assert judged(world, [("protocol_conformance", "Port", {"protocol": "m.Port"}), ("protocol_conformance", "Port", {"protocol": "m.Port", "enforce_method_kind": False, "mode": "any"})]) == [("FAILED", "protocol_not_met"), ("OK", None)]


def test_a_thousand_rules_are_one_plan(world):
    facts, matches, ids = world
    ctx = R.Context(facts, matches)
    for kind, name in (("attribute_contract", "name"), ("member_absence", "pattern"), ("method_set", "pattern"), ("member_set", "pattern")):
        few, many = ([R.Rule(f"r{k}", kind, ids["A"], params={name: f"x{k}"}) for k in range(n)] for n in (1, 1000))
        sizes = []
        for rules in (few, many):
            good, bad = R.compile_rules(rules)
            assert not bad
            plan = R.EVALUATORS[kind](ctx, good)._jdf.queryExecution().optimizedPlan().toString()
            sizes.append(len(re.findall(r"\n", re.sub(r"LocalRelation.*", "", plan))))
        assert sizes[0] == sizes[1]
    many = [R.Rule(f"r{k}", "attribute_contract", ids["A"], params={"name": f"x{k}"}) for k in range(1000)]
    assert R.EVALUATORS["attribute_contract"](ctx, R.compile_rules(many)[0]).where("reason = 'missing_attribute'").count() == 1000


def test_imports_by_scope(spark):
    files = {"pkg/__init__.py": "", "pkg/a.py": "import pkg.b\n", "pkg/b.py": "import bad.x\ndef f():\n    import bad.y\n", "other.py": "import pkg.b\n"}
    rows = [("ref", "source", "pkg/a.py", "import pkg.b\n")] + [("t", "target", k, v) for k, v in files.items()]
    facts = P.extract(spark.createDataFrame(rows, "project string, role string, path string, text string")).cache()
    matches = matching.match(P.entities(facts.where("role = 'source'")), P.entities(facts.where("role = 'target'")))
    source = P.entities(facts.where("role = 'source'")).first().canonical_id
    rules = [R.Rule(f"r{k}", "import_policy", source, params={"forbidden": ["bad"]} | p) for k, p in enumerate([{}, {"scope": "module"}, {"package": "other"}, {"allow": ["pkg"]}, {"scope": "module", "mode": "direct"}, {"mode": "direct"}])]
    got = {r.rule_id: r.detail for r in R.evaluate(facts, matches, rules).collect()}
    assert got["r0"] == "3 paths: pkg.b -> bad.x; other -> pkg.b -> bad.x; pkg.a -> pkg.b -> bad.x"
    assert got["r1"] == "1 path: pkg.a -> pkg.b -> bad.x" and got["r2"] == "1 path: other -> pkg.b -> bad.x" and got["r3"] is None and got["r4"] is None
    assert "bad.y" in got["r5"]


def test_bases_through_reexports(spark):
    files = {"shapes/__init__.py": "from shapes.core import Shape as Form\n", "shapes/core.py": "class Shape:\n    def area(self): ...\n", "app.py": "from shapes import Form\nclass Circle(Form):\n    pass\n", "other.py": "import app\nclass Wheel(app.Form):\n    pass\n"}
    facts = P.extract(spark.createDataFrame([("t", "target", k, v) for k, v in files.items()], "project string, role string, path string, text string"))
    ctx = R.Context(facts, spark.createDataFrame([], matching.SCHEMA))
    assert {(r.origin.split(":")[3], r.end.split(":")[3]) for r in ctx.bases().collect()} == {("Circle", "Shape"), ("Wheel", "Shape")}


def test_what_is_not_supported_is_an_issue():
    def compiled(marker, **p):
        return M.compile_marker({"marker": marker, "params": p, "module": "m", "qualname": "A", "severity": "error", "issues": ""}, "s", {})[0]

    assert compiled("does_not_have", name="x", signature_mode="exact").params["issues"] == ["signature_mode is not supported"]
    assert compiled("does_not_have", name="x", signature_mode="any").rule_type == "member_absence"
    assert compiled("require_member_set", descriptor_kinds=["cached_property"]).rule_type == "compiler_invalid_param"
    r = compiled("does_not_have", name_match="alias", aliases=["a", "b"], include_descriptors=True)
    assert r.params["names"] == ["a", "b"] and r.params["descriptor_kinds"] == ["cached_property", "classproperty"]
    assert compiled("forbid_imports", forbidden=["x"], scope="module").params["scope"] == "module"


def test_likenesses_and_predicates_can_be_exchanged(spark):
    text = "def f(a):\n    return a\n"
    rows = [("ref", "source", "m.py", text), ("t", "target", "m.py", text.replace("def f", "def g")), ("t", "target", "deep/er/n.py", text.replace("def f", "def h"))]
    facts = P.extract(spark.createDataFrame(rows, "project string, role string, path string, text string")).cache()
    sources, targets = (P.entities(facts.where(F.col("role") == r)).where("kind = 'function'") for r in ("source", "target"))
    best = lambda **k: matching.candidates(sources, targets, **k).where("rank = 1").first().target_id.split(":")[3]
    assert best() == "g"
    far = matching.Similarities(module=lambda a, b: 1.0 - matching.C.module_similarity(a, b))
    assert best(alike=far) == "h"
    calls = spark.createDataFrame([("p", "main", "ask"), ("p", "main", "f"), ("p", "f", "print")], "project string, caller string, callee string")
    none = spark.createDataFrame([], "project string, function string")
    roles = lambda *p: {(r.function, r.role) for r in principles.io_roles(calls, none, *p).collect()}
    assert roles() == set()
    assert roles(principles.Predicates(reads=lambda c: c == "ask", talks=lambda c: c.isin("ask", "print"))) == {("main", "io"), ("f", "disputed")}
