import pytest

from structura.operators import matching
from structura.plans import rules as R
from structura.plans import runtime_rules
from structura.sources import markers as M
from structura.sources import python_source as P

FILES = {"a.py": "import b\nclass A:\n    def run(self):\n        return b.f()\n", "b.py": "class P:\n    def go(self): ...\ndef f():\n    return 1\n", "c.py": "from a import A\nclass C(A):\n    pass\n"}


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def world(spark):
    rows = [("ref", "source", k, v) for k, v in FILES.items()] + [(p, "target", k, v) for p in ("good", "bad") for k, v in FILES.items()]
    facts = P.extract(table(spark, rows, "project string, role string, path string, text string")).cache()
    matches = matching.match(P.entities(facts.where("role = 'source'")), P.entities(facts.where("role = 'target'"))).cache()
    edges = "project string, case string, caller string, callee string, function string, via array<string>"
    e = {
        "cases": table(spark, [("good", "x", "completed"), ("bad", "x", "completed")], "project string, case string, status string"),
        "calls": table(spark, [("good", "x", "a", "b", "f", None), ("bad", "x", "c", "a", "_g", None), ("bad", "x", "a", "c", "f", None), ("bad", "x", "a", "os", "getcwd", None)], edges),
        "reference_calls": table(spark, [("x", "a", "b")], "case string, caller string, callee string"),
        "instances": table(spark, [("bad", "x", "b", "a", "A")], "project string, case string, creator string, module string, class string"),
        "imports": table(spark, [("bad", "a", "os.path"), ("good", "a", "b")], "project string, importer string, imported string"),
        "writes": table(spark, [("good", "x", "a", "A.run", "C", "n", "assigned"), ("bad", "x", "b", "f", "A", "n", "assigned")], "project string, case string, module string, function string, class string, attribute string, change string"),
        "spies": table(spark, [("good", "x", "port", "save")], "project string, case string, spy string, member string"),
        "notices": table(spark, [("good", "x", "subscribed"), ("bad", "x", "subscribed"), ("bad", "x", "unsubscribed")], "project string, case string, phase string"),
        "objects": table(spark, [("good", "x", True, "A", [], True), ("bad", "x", True, "A", ["go"], False)], "project string, case string, constructible boolean, class string, abstract_methods array<string>, same boolean"),
        "members": table(spark, [("good", "x", "go", "method", True), ("bad", "x", "old", "int", False)], "project string, case string, name string, type string, callable boolean"),
        "stages": table(spark, [("good", "x", "s1", 0), ("good", "x", "s2", 1), ("bad", "x", "s2", 0), ("bad", "x", "s1", 1)], "project string, case string, stage string, seq int"),
        "reference_stages": table(spark, [("x", "s1", 0), ("x", "s2", 1)], "case string, stage string, seq int"),
    }
    return facts, matches, e


CASE = {"cases": [{"name": "x"}]}
DECLARED = [
    ("forbid_runtime_calls", {"modules": ["os"]}), ("require_runtime_calls", {"modules": ["b"]}), ("forbid_runtime_instantiation", {"modules": ["a"]}), ("enforce_reference_calls", {"require_all": True}),
    ("require_runtime_members", {"names": ["go"]}), ("forbid_runtime_members", {"names": ["old"]}), ("is_runtime_concrete_class", {}), ("implements_runtime_protocol", {"protocol": "b.P"}), ("is_runtime_singleton", {}),
    ("enforce_runtime_observer", {"subscribe": "s", "notify": "n", "unsubscribe": "u"}), ("require_runtime_delegation", {"spy": "port", "member": "save"}), ("forbid_foreign_writes", {}), ("forbid_runtime_imports", {"forbidden": ["os"]}),
    ("enforce_layers", {"layers": ["c", "a", "b"]}), ("forbid_cycles", {}), ("architecture_entry", {"policy": "strict"}), ("enforce_flow", {"stages": ["s1", "s2"]}), ("module_interface", {"names": []}),
]


def judged(world, events, only=None):
    facts, matches, _ = world
    rules = []
    for marker, p in DECLARED:
        d = {"marker": marker, "params": {**p, **(CASE if "cases" in M.MARKERS[marker].split() else {})}, "module": "a", "qualname": "a", "severity": "error", "issues": ""}
        rules += [r for r in M.compile_marker(d, "", {}) if r.rule_type in runtime_rules.JUDGES and (only is None or marker in only)]
    return {(r.project, r.rule_id.split("@")[0]): r for r in R.evaluate(facts, matches, rules, events=events).collect()}


def test_events_decide(world):
    got = judged(world, world[2])
    assert {m for m, _ in DECLARED} == {m for p, m in got if p == "good"}
    assert {k: (v.reason, v.detail) for k, v in got.items() if k[0] == "good" and v.status != "OK"} == {}
    assert {k[1] for k, v in got.items() if k[0] == "bad" and v.status == "OK"} == set()


def test_without_events(world):
    got = judged(world, None, ["forbid_runtime_calls", "is_runtime_singleton"])
    assert {(v.status, v.reason) for v in got.values()} == {("SKIPPED", "dynamic_checks_disabled")}


def test_cases_that_do_not_run(world, spark):
    events = world[2] | {"cases": table(spark, [("good", "x", "setup_failed"), ("bad", "x", "probe_timeout")], "project string, case string, status string")}
    got = judged(world, events, ["forbid_runtime_calls"])
    assert {(k[0], v.status, v.reason) for k, v in got.items()} == {("good", "FAILED", "case_setup_failed"), ("bad", "FAILED", "probe_timeout")}
    events["reference_cases"] = table(spark, [("x", "raised")], "case string, status string")
    got = judged(world, events, ["forbid_runtime_calls"])
    assert got[("good", "forbid_runtime_calls")].status == "ERROR"
