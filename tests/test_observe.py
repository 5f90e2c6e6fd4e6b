import pytest
from pyspark.sql import functions as F

from structura.operators import runtime
from structura.sources import observe as O

FILES = {
    "store.py": "import json\n\nclass Store:\n    def __init__(self):\n        self.rows = []\n    def save(self, x):\n        self.rows.append(x)\n        return json.dumps(x)\n",
    "service.py": "from store import Store\n\nclass Service:\n    def __init__(self, store):\n        self.store = store\n    def run(self, x):\n        if x > 5:\n            return None\n        return self.store.save(x)\n\ndef make():\n    return Service(Store())\n\ndef meddle(s):\n    s.rows = [1]\n    print('done')\n    return s\n\ndef spin():\n    while True:\n        pass\n",
}
CASES = [
    {"name": "run", "call": "service:Service.run", "init": {"args": [{"new": "store:Store"}]}, "args": [1]},
    {"name": "spied", "call": "service:Service.run", "init": {"args": [{"spy": "store"}]}, "args": [1], "spies": ["store"]},
    {"name": "meddle", "call": "service:meddle", "args": [{"new": "store:Store"}]},
    {"name": "make", "call": "service:make", "inspect": True},
    {"name": "wrong", "call": "service:nothing"},
    {"name": "raises", "call": "service:Service.run", "init": {"args": [None]}, "args": [1]},
]


@pytest.fixture(scope="module")
def observed(spark):
    rows = [(p, k, v) for p in ("a", "b") for k, v in FILES.items()] + [("c", "service.py", "import sys\nsys.exit(3)\n")]
    return O.observe(spark.createDataFrame(rows, "project string, path string, text string"), CASES).cache()


def test_statuses(observed):
    got = {(r.project, r.case): r.status for r in observed.collect()}
    assert {c: s for (p, c), s in got.items() if p == "a"} == {"run": "completed", "spied": "completed", "meddle": "completed", "make": "completed", "wrong": "setup_failed", "raises": "raised"}
    assert {s for (p, _), s in got.items() if p == "c"} == {"setup_failed"}
    assert O.probe(FILES, [{"name": "spin", "call": "service:spin"}], timeout_s=0.1)[0]["status"] == "probe_timeout"
    assert O.probe({"../x.py": ""}, [{"name": "x", "call": "x:y"}])[0]["status"] == "probe_invalid"


def test_events(observed):
    calls = {tuple(r) for r in O.events(observed, "calls").where("project = 'a'").select("case", "caller", "callee", "function").collect()}
    assert ("run", "service", "store", "Store.save") in calls and ("meddle", "service", "builtins", "print") in calls
    assert {tuple(r) for r in O.events(observed, "instances").where("project = 'a'").select("case", "creator", "class").collect()} == {("make", "service", "Store"), ("make", "service", "Service")}
    assert {tuple(r) for r in O.events(observed, "writes").where("project = 'a' and case = 'meddle'").select("writer", "class", "attribute", "change").collect()} == {("service", "Store", "rows", "assigned")}
    assert {tuple(r) for r in O.events(observed, "spies").where("project = 'b'").select("case", "spy", "member").collect()} == {("spied", "store", "save")}
    lines = {r.line for r in O.events(observed, "lines").where("project = 'a' and case = 'run' and module = 'service'").collect()}
    assert 9 in lines and 8 not in lines


def test_judging_what_was_observed(observed):
    calls = O.events(observed, "calls")
    cases = observed.where("status = 'completed' and project <> 'c'")
    assert {(r.project, r.case) for r in runtime.missing_calls(calls, cases.where("case in ('run', 'meddle')"), ["store"]).collect()} == {("a", "meddle"), ("b", "meddle")}
    assert {r.case for r in runtime.forbidden_calls(calls.drop("function"), ["builtins"]).collect()} >= {"meddle"}
    assert runtime.missing_delegation(O.events(observed, "spies"), cases.where("case = 'spied'"), "save").count() == 0
    objects = O.objects(observed.where("case = 'make' and project <> 'c'"))
    assert runtime.class_kind(objects, abstract=False).count() == 0 and runtime.class_kind(objects, abstract=True).count() == 2
    assert {r.same for r in objects.collect()} == {False}
    members = objects.select("project", "case", F.explode("members").alias("m")).select("project", "case", "m.*")
    assert {(r.name, r.reason) for r in runtime.member_violations(objects, members, ["store", "missing"]).collect()} == {("missing", "missing")}
