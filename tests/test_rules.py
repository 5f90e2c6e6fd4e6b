import pytest

from structura.operators import matching, summary
from structura.plans import rules as R
from structura.sources import python_source as P

REFERENCE = {
    "app/__init__.py": "",
    "app/models.py": '"""Orders."""\nfrom abc import ABC, abstractmethod\nimport enum\n\nclass State(enum.Enum):\n    NEW = 1\n\nclass Base(ABC):\n    @abstractmethod\n    def price(self, qty: int) -> int: ...\n\nclass Order(Base):\n    rate: int = 1\n    def __init__(self, qty):\n        self.qty = qty\n    def price(self, qty: int) -> int:\n        return qty * self.rate\n    def total(self, a, b=1):\n        return a + b\n',
    "app/service.py": "from app.models import Order\n\ndef place(order, *, fast=False):\n    return Order(1).price(2)\n",
    "app/web.py": "from app import service\n\ndef handle(request):\n    return service.place(request)\n",
}
GOOD = {k.removeprefix("app/"): v.replace("app.models", "models").replace("from app import", "import").replace("import service", "import service") for k, v in REFERENCE.items()}
BAD = {
    "models.py": "import web\nclass Order:\n    def price(self, quantity):\n        return quantity\n    def total(self, a, b):\n        return a\n    def _hidden(self): return 1\n",
    "service.py": "from models import Order\nimport flask\n\ndef place(order, extra):\n    return Order()._hidden()\n",
    "web.py": "import service\nfrom models import Order\n\ndef handle(request):\n    return service.place(request)\n",
    "broken.py": "def f(:\n",
}


@pytest.fixture(scope="module")
def world(spark):
    rows = [("ref", "source", k.removeprefix("app/"), v.replace("app.models", "models").replace("from app import", "import")) for k, v in REFERENCE.items()]
    rows += [(p, "target", k, v) for p, files in (("good", GOOD), ("bad", BAD)) for k, v in files.items()]
    facts = P.extract(spark.createDataFrame(rows, "project string, role string, path string, text string")).cache()
    sources, targets = P.entities(facts.where("role = 'source'")), P.entities(facts.where("role = 'target'"))
    matches = matching.match(sources, targets).cache()
    ids = {r.qualname if r.kind != "module" else f"module {r.module}": r.canonical_id for r in sources.collect()}
    return facts, matches, ids


def test_extraction(world):
    facts = world[0]
    assert [(r.project, r.path) for r in P.syntax_errors(facts).collect()] == [("bad", "broken.py")]
    e = {(r.project, r.module, r.qualname): r for r in P.entities(facts.where("role = 'target'")).collect()}
    total = e[("good", "models", "Order.total")]
    assert total.signature_key == "p0-a3-v0-k0-w0-d1-kd0" and [(p.name, p.required) for p in total.params] == [("self", True), ("a", True), ("b", False)]
    assert e[("good", "models", "State")].bases == ["enum.Enum"] and e[("good", "models", "Base.price")].decorators == ["abc.abstractmethod"]
    assert {(r.name, r.storage) for r in P.attributes(facts.where("project = 'good'")).collect()} == {("NEW", "class"), ("rate", "class"), ("qty", "instance")}
    assert {(r.base, r.name) for r in P.private_reads(facts.where("project = 'bad'")).collect()} == {("Order()", "_hidden")}


def test_matching(world):
    _, matches, ids = world
    got = {(r.project, r.source_id): r for r in matches.collect()}
    assert all(got[("good", i)].status == "MATCHED" and got[("good", i)].target_id.split(":", 2)[2] == i.split(":", 2)[2] for i in ids.values())
    assert got[("bad", ids["Order"])].status == "MATCHED" and got[("bad", ids["State"])].status == "UNMATCHED"
    taken = [r.target_id for r in got.values() if r.project == "bad" and r.status == "MATCHED"]
    assert len(taken) == len(set(taken))


def results(world, rules, **k):
    facts, matches, _ = world
    return {(r.project, r.rule_id): r for r in R.evaluate(facts, matches, rules, **k).collect()}


def test_project_rules(world):
    got = results(
        world,
        [
            R.Rule("cycles", "module_cycles"), R.Rule("layers", "module_layers", params={"layers": ["web", "service", "models"]}), R.Rule("imports", "import_policy", params={"forbidden": ["flask"]}),
            R.Rule("direct", "import_policy", params={"forbidden": ["flask"], "mode": "direct"}), R.Rule("arch", "architecture_static", params={"policy": "strict"}), R.Rule("private", "private_access"),
            R.Rule("odd", "module_layers", params={"layers": ["a | b : c"]}), R.Rule("odd2", "import_policy", params={"mode": "sideways"}),
        ],
    )
    for rule in ("cycles", "layers", "imports", "direct", "arch", "private"):
        assert got[("good", rule)].status == "OK" and got[("bad", rule)].status == "FAILED", rule
    assert got[("bad", "cycles")].detail == "models -> web -> models"
    assert "upward: models -> web" in got[("bad", "layers")].detail
    assert got[("bad", "direct")].detail == "service -> flask"
    assert {got[(p, r)].reason for p in ("good", "bad") for r in ("odd", "odd2")} == {"invalid_parameter"}


def test_entity_rules(world):
    ids = world[2]
    got = results(
        world,
        [
            R.Rule("sub", "nominal_type", ids["Order"], params={"base": ids["Base"]}), R.Rule("enum", "enum_type", ids["State"]), R.Rule("abstract", "abstract_class", ids["Base"]),
            R.Rule("concrete", "abstract_class", ids["Order"], params={"negated": True}), R.Rule("methods", "method_set", ids["Order"], params={"names": ["price", "total"], "min_count": 2}),
            R.Rule("absent", "member_absence", ids["Order"], params={"pattern": "_[^_].*"}), R.Rule("attr", "attribute_contract", ids["Order"], params={"name": "rate", "annotation": "int"}),
            R.Rule("sig", "api_signature", ids["Order.total"]), R.Rule("place", "api_signature", ids["place"]), R.Rule("proto", "protocol_conformance", ids["Order"], params={"protocol": "models.Base"}),
            R.Rule("iface", "module_interface", ids["module models"]), R.Rule("final", "decorated", ids["Order"], params={"negated": True}),
        ],
    )
    for rule in ("sub", "enum", "abstract", "concrete", "methods", "absent", "attr", "sig", "place", "proto", "iface", "final"):
        assert got[("good", rule)].status == "OK", (rule, got[("good", rule)])
    assert got[("bad", "sub")].reason == "base_not_matched" and got[("bad", "enum")].status == "SKIPPED"
    assert got[("bad", "absent")].status == "FAILED" and got[("bad", "attr")].reason == "missing_attribute"
    assert "missing qty" in got[("bad", "proto")].detail


def test_unmatched_and_summary(world):
    ids = world[2]
    got = results(world, [R.Rule("enum", "enum_type", ids["State"])], fail_on_unmatched=True)
    assert got[("bad", "enum")].reason == "required_target_missing"
    facts, matches, _ = world
    rows = R.evaluate(facts, matches, [R.Rule("cycles", "module_cycles"), R.Rule("private", "private_access")])
    codes = {r.target: r.exit_code for r in summary.target_exit_codes(rows.withColumnRenamed("project", "target")).collect()}
    assert codes == {"good": 0, "bad": 1}


def test_scan(spark, tmp_path):
    for p, text in {"one/a.py": "x = 1", "one/pkg/__init__.py": "", "one/.git/c.py": "", "two/venv/d.py": "", "two/b.txt": "", "two/e.py": "y"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    got = {(r.project, r.path) for r in P.scan(spark, str(tmp_path)).collect()}
    assert got == {("one", "a.py"), ("one", "pkg/__init__.py"), ("two", "e.py")}
    assert {r.path for r in P.scan(spark, str(tmp_path / "one"), project="p", init_files=False, max_depth=0).collect()} == {"a.py"}


def test_mapping_rows():
    assert P.mapping_rows({"pairs": {"a": "b"}, "targets": {"t": {"pairs": {"c": "d"}}}}) == [("*", "a", "b"), ("t", "c", "d")]
    for bad in ({}, {"pairs": {"a": 1}}, {"targets": {"t": {}}}):
        with pytest.raises(ValueError):
            P.mapping_rows(bad)
