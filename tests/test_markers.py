import pytest

from structura.functions import annotations as A
from structura.operators import matching
from structura.plans import member_rules, rules as R
from structura.sources import markers as M
from structura.sources import python_source as P

REFERENCE = {
    "base.py": "from typing import Annotated\nfrom rules import *\nfrom abc import ABC, abstractmethod\n\nclass Shape(ABC):\n    __archtest__: Annotated[None, is_abstract_class()]\n    @abstractmethod\n    def area(self) -> float: ...\n",
    "shop.py": (
        "from typing import Annotated\nimport rules\nfrom base import Shape\n\n__archtest__: Annotated[None, rules.forbid_imports('flask', mode='direct'), rules.module_interface('Circle', 'make')]\n\n"
        "class Circle(Shape):\n    __archtest__: Annotated[None, rules.subclass_of(Shape), rules.required_attribute('radius', storage='instance'), rules.require_member_set(names=['area', 'radius'], name_match='names', min_count=2), rules.required_constructor(), rules.does_not_have('scale')]\n"
        "    def __init__(self, radius: float):\n        self.radius = radius\n"
        "    def area(self) -> float:\n        __archtest__: Annotated[None, rules.required_method()]\n        return 3 * self.radius\n"
        "    @classmethod\n    def unit(cls) -> 'Circle':\n        __archtest__: Annotated[None, rules.required_factory(satisfy_with=['classmethod'])]\n        return cls(1)\n\n"
        "def make(radius: float) -> Annotated[Circle, rules.required_entity_signature(mode='exact', return_annotation='error')]:\n    return Circle(radius)\n\n"
        "def broken():\n    __archtest__: Annotated[None, rules.is_enum(mystery=1)]\n    return None\n"
    ),
}
GOOD = {k: "\n".join(x for x in v.split("\n") if "__archtest__" not in x and "rules" not in x.split("(")[0] or x.startswith("def make")) for k, v in REFERENCE.items()}
GOOD["shop.py"] = GOOD["shop.py"].replace("Annotated[Circle, rules.required_entity_signature(mode='exact', return_annotation='error')]", "Circle")
BAD = {
    "base.py": "class Shape:\n    def area(self):\n        return 0.0\n",
    "shop.py": "import flask\n\nclass Circle:\n    scale = 1\n    def __init__(self, radius, colour):\n        self.colour = colour\n    def area(self, unit):\n        return unit\n    @classmethod\n    def unit(cls) -> int:\n        return 1\n    @classmethod\n    def other(cls, a):\n        return 1\n\ndef make(r: float) -> str:\n    return ''\n\ndef broken():\n    return None\n",
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [("ref", "source", k, v) for k, v in REFERENCE.items()] + [(p, "target", k, v) for p, files in (("good", GOOD), ("bad", BAD)) for k, v in files.items()]
    files = spark.createDataFrame(rows, "project string, role string, path string, text string")
    facts = P.extract(files).cache()
    sources, targets = P.entities(facts.where("role = 'source'")), P.entities(facts.where("role = 'target'"))
    declared = M.read_markers(files.where("role = 'source'")).cache()
    rules = M.rules_of(declared, sources)
    matches = matching.match(sources, targets).cache()
    return declared, rules, {(r.project, r.rule_id): r for r in R.evaluate(facts, matches, rules).collect()}


def test_declarations(judged):
    declared, rules, _ = judged
    rows = declared.collect()
    assert {r.marker for r in rows} == {"is_abstract_class", "forbid_imports", "module_interface", "subclass_of", "required_attribute", "require_member_set", "required_constructor", "does_not_have", "required_method", "required_factory", "required_entity_signature", "is_enum"}
    by = {r.marker: r for r in rows}
    assert by["subclass_of"].params == '{"base": "base.Shape"}' and by["forbid_imports"].params == '{"forbidden": ["flask"], "mode": "direct"}'
    assert by["required_entity_signature"].container == "signature" and "mystery" in by["is_enum"].issues
    assert len({r.rule_id for r in rules}) == len(rules) == len(rows) + 1  # the return of make is a rule of its own


def test_rules_pass_on_the_reference_itself(judged):
    got = {k[1]: v for k, v in judged[2].items() if k[0] == "good"}
    assert {k: (v.status, v.reason, v.detail) for k, v in got.items() if v.status != "OK"} == {"is_enum@shop.broken": ("FAILED", "invalid_parameter", got["is_enum@shop.broken"].detail)}


def test_rules_fail_where_they_should(judged):
    got = {k[1]: v for k, v in judged[2].items() if k[0] == "bad"}
    reasons = {k: v.reason for k, v in got.items() if v.status == "FAILED"}
    assert reasons["is_abstract_class@base.Shape"] == "class_is_concrete" and reasons["subclass_of@shop.Circle"] == "nominal_relation_differs"
    assert reasons["required_attribute@shop.Circle"] == "missing_attribute" and reasons["does_not_have@shop.Circle"] == "forbidden_member"
    assert reasons["require_member_set@shop.Circle"] == "too_few_matching_members" and reasons["required_constructor@shop.Circle"] == "constructor_differs"
    assert reasons["required_method@shop.Circle.area"] == "no_compatible_candidate" and reasons["required_factory@shop.Circle.unit"] == "no_compatible_candidate"
    assert reasons["required_entity_signature@shop.make"] == "signature_differs" and reasons["required_entity_signature@shop.make#return"] == "return_annotation_differs"
    assert got["forbid_imports@shop"].status == "FAILED" and "mystery" in got["is_enum@shop.broken"].detail


def test_every_marker_compiles():
    for marker in M.MARKERS:
        p = {"base": "base.Shape", "name": "x", "stages": ["a"], "layers": ["a", "b"]}
        params = {k: p[k] for k in p if k in M.MARKERS[marker].replace("*", "").split()}
        if "cases" in M.MARKERS[marker].split():
            params["cases"] = [{}]
        own = M.compile_marker({"marker": marker, "params": params, "module": "m", "qualname": "C", "severity": "error", "issues": ""}, "id", {"base.Shape": "b"})
        assert own or marker == "flow"
        static = [r for r in own if not r.rule_type.startswith(("runtime_", "architecture_runtime", "variable_flow"))]
        assert R.compile_rules(static)[1] == [] and member_rules.MEMBER_KINDS


@pytest.mark.parametrize(
    "expected, found, variance, ok",
    [
        ("Optional[int]", "int | None", "invariant", True), ("Union[str, int]", "int | str", "invariant", True), ("List[int]", "list[int]", "invariant", True), ("'Order'", "Order", "invariant", True),
        ("int | None", "int", "covariant", True), ("int", "int | None", "covariant", False), ("int", "int | None", "contravariant", True), ("Sequence[int]", "list[bool]", "covariant", True), ("list[int]", "list[bool]", "covariant", False),
        ("Base", "Child", "covariant", True), ("Child", "Base", "covariant", False), ("Callable[[int], int]", "Callable[[object], bool]", "covariant", True), ("tuple[int, ...]", "tuple[int, bool]", "covariant", True),
        ("Literal['a', 'b']", "Literal['a']", "covariant", True), ("Any", "str", "covariant", True), (None, "str", "invariant", True), ("int", None, "invariant", False), ("Annotated[int, 3]", "int", "invariant", True),
    ],
)
def test_annotations(expected, found, variance, ok):
    assert A.fits(expected, found, variance, {("Child", "Base")}) is ok
    assert A.normal("Optional[ int ]") == "None | int" and A.members("int | str") == ["int", "str"] and A.optional("int | None") and A.element("dict[str, int]") == "int"
