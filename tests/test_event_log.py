import json

import pytest

from structura import run as X
from structura.operators import matching
from structura.plans import rules as R
from structura.plans import runtime_rules
from structura.sources import config as C
from structura.sources import event_log as L
from structura.sources import markers as M
from structura.sources import python_source as P

CASES = "cases=[{'name': 'x'}]"
#: A marker of every kind of observing rule, by the module whose body declares it.
MARKERS = {
    "a.py": [
        f"forbid_runtime_calls('os', {CASES})", f"require_runtime_calls('b', {CASES})", f"forbid_runtime_instantiation('a', {CASES})", f"enforce_reference_calls(require_all=True, {CASES})", f"require_runtime_members('go', {CASES})",
        f"forbid_runtime_members('old', {CASES})", f"is_runtime_concrete_class({CASES})", f"implements_runtime_protocol('b.P', {CASES})", f"is_runtime_singleton({CASES})", f"enforce_runtime_observer(subscribe='s', notify='n', unsubscribe='u', {CASES})",
        f"require_runtime_delegation(spy='port', member='save', {CASES})", f"forbid_foreign_writes({CASES})", f"forbid_runtime_imports('os', {CASES})", f"enforce_layers('c', 'a', 'b', {CASES})", f"forbid_cycles({CASES})",
        f"architecture_entry(policy='strict', {CASES})", f"enforce_flow(stages=['b.f', 'b.g'], {CASES})", f"module_interface('run', {CASES})",
    ],
}
FILES = {"a.py": "import b\nclass A:\n    def run(self):\n        return b.f()\n", "b.py": "class P:\n    def go(self): ...\ndef f():\n    return 1\ndef g():\n    return 2\n", "c.py": "from a import A\nclass C(A):\n    pass\n"}
#: What was recorded; rows without project are the reference's.
RECORDED = {
    "cases": [("reference", "x", "completed"), ("good", "x", "completed"), ("bad", "x", "completed"), ("bad", "y", "raised")],
    "calls": [("reference", "x", "a", "b", "f", 0), ("reference", "x", "a", "b", "g", 1), ("good", "x", "a", "b", "f", 0), ("good", "x", "a", "b", "g", 1), ("bad", "x", "c", "a", "_g", 0), ("bad", "x", "b", "c", "f", 1), ("bad", "x", "a", "os", "getcwd", 2), ("bad", "x", "b", "a", "q", 3), ("bad", "x", "a", "c", "q", 4)],
    "instances": [("bad", "x", "b", "a", "A")],
    "imports": [("bad", "a", "os.path"), ("good", "a", "b")],
    "writes": [("good", "x", "a", "A.run", "A", "n", "assigned"), ("bad", "x", "b", "f", "A", "n", "assigned")],
    "spies": [("good", "x", "port", "save")],
    "notices": [("good", "x", "subscribed"), ("bad", "x", "unsubscribed")],
    "objects": [("good", "x", True, "A", [], True), ("bad", "x", True, "A", ["go"], False)],
    "members": [("good", "x", "go", "method", True, True), ("bad", "x", "old", "int", False, True)],
}
NAMES = {"calls": ["project", "case", "caller", "callee", "function", "seq"], "objects": ["project", "case", "constructible", "class", "abstract_methods", "same"], "members": ["project", "case", "name", "type", "callable", "binds"]}


def named(kind):
    return NAMES.get(kind) or L.columns(kind)[1]


def projects(root):
    declared = "from typing import Annotated\nfrom rules import *\n" + "".join(f"__archtest__: Annotated[None, {m}]\n" for m in MARKERS["a.py"])
    for where in ("ref", "subs/good", "subs/bad"):
        (root / where).mkdir(parents=True)
        for name, text in FILES.items():
            (root / where / name).write_text((declared if where == "ref" and name in MARKERS else "") + text)
    return C.RunConfig(reference=f"{root}/ref", targets=(f"{root}/subs/*",))


def write_json(folder, recorded, extra=None):
    folder.mkdir()
    for kind, rows in recorded.items():
        lines = [json.dumps(dict(zip(named(kind), r))) for r in rows]
        (folder / f"{kind}.json").write_text("\n".join([*lines, *(extra or {}).get(kind, [])]) + "\n")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("events")
    config = projects(root)
    write_json(root / "log", RECORDED)
    tables = {k: spark.createDataFrame([dict(zip(named(k), r)) for r in rows], L.columns(k)[0]) for k, rows in RECORDED.items()}
    L.write_log(tables, str(root / "parquet"))
    files = X.files_of(spark, config)
    facts = P.extract(files).cache()
    sources, targets = (P.entities(facts.where(f"role = '{r}'")) for r in ("source", "target"))
    rules = [r for r in M.rules_of(M.read_markers(files.where("role = 'source'")), sources) if r.rule_type in runtime_rules.JUDGES]
    return root, (config, facts, matching.match(sources, targets).cache(), rules)


#: Two kinds that need no search, for what is the same for all kinds.
SOME = ("runtime_members", "runtime_imports")


def verdicts(spark, config, folder, kinds=SOME):
    _, facts, matches, rules = config
    log = L.read_log(spark, str(folder), ["reference", "good", "bad"])
    rows = R.evaluate(facts, matches, [r for r in rules if r.rule_type in kinds], events=L.rule_events(log)).collect()
    return {(r.project, r.rule_id.split("#")[0]): r for r in rows}


def test_every_observing_rule_gets_its_verdict(spark, world):
    root, config = world
    got = verdicts(spark, config, root / "parquet", tuple(runtime_rules.JUDGES))
    kinds = {r.rule_type for r in got.values()}
    assert kinds == set(runtime_rules.JUDGES) and len([k for k in got if k[0] == "good"]) == len(MARKERS["a.py"])
    assert {k: (v.status, v.reason, v.detail) for k, v in got.items() if k[0] == "good" and v.status != "OK"} == {}
    assert {k for k, v in got.items() if k[0] == "bad" and v.status != "FAILED"} == set()
    markers = {**M.RUNTIME, **M.ALSO_OBSERVED}
    assert {k[1].split("@")[0] for k in got} == set(markers) - {"is_runtime_abstract_class"}  # no class is of both kinds


def test_a_run_reads_the_folder(spark, world, tmp_path):
    root, config = world
    from dataclasses import replace

    (tmp_path / "log").mkdir()
    for f in (root / "log").iterdir():
        (tmp_path / "log" / f.name).write_text(f.read_text() + ("{broken\n" if f.name == "calls.json" else ""))
    document = X.run(spark, replace(config[0], events=str(tmp_path / "log")), keep=lambda r: r.rule_type == "runtime_imports")
    assert document["exit_code"] == 1 and document["summary"]["results"]["status_counts"] == {"ERROR": 1, "FAILED": 1, "OK": 1}


def test_both_forms_say_the_same(spark, world):
    root, _ = world
    a, b = (L.read_log(spark, str(root / form)).tables for form in ("log", "parquet"))
    for kind in RECORDED:
        assert sorted(map(repr, a[kind].collect())) == sorted(map(repr, b[kind].collect())) and a[kind].count() == len(RECORDED[kind])


def test_unrecorded_cases_are_not_judged(spark, world, tmp_path):
    root, config = world
    write_json(tmp_path / "log", {k: [r for r in rows if r[0] != "good"] for k, rows in RECORDED.items()} | {"cases": [("bad", "y", "completed"), ("reference", "x", "completed")]})
    got = verdicts(spark, config, tmp_path / "log")
    assert {(k[0], v.status, v.reason) for k, v in got.items()} == {("good", "SKIPPED", "no_recorded_case"), ("bad", "SKIPPED", "no_recorded_case")}


def test_cases_that_failed(spark, world, tmp_path):
    root, config = world
    write_json(tmp_path / "a", RECORDED | {"cases": [("good", "x", "raised"), ("bad", "x", "probe_timeout"), ("reference", "x", "completed")]})
    got = verdicts(spark, config, tmp_path / "a")
    assert {(k[0], v.status, v.reason) for k, v in got.items()} == {("good", "FAILED", "case_setup_failed"), ("bad", "FAILED", "probe_timeout")}
    write_json(tmp_path / "b", RECORDED | {"cases": [("good", "x", "raised"), ("bad", "x", "completed"), ("reference", "x", "raised")]})
    got = verdicts(spark, config, tmp_path / "b")
    assert {(v.status, v.reason) for k, v in got.items() if k[0] == "good"} == {("ERROR", "reference_case_invalid")}


def test_rows_that_cannot_be_used(spark, world, tmp_path):
    root, config = world
    write_json(tmp_path / "log", RECORDED, {"calls": ["{broken", json.dumps({"project": "bad", "case": "x", "caller": None, "callee": "b"})], "notices": [json.dumps({"project": "good", "case": "x", "phase": "later"})]})
    log = L.read_log(spark, str(tmp_path / "log"))
    assert sorted((r.project, r.kind, r.reason) for r in log.rejected.collect()) == [("", "calls", "broken_record"), ("bad", "calls", "no_caller"), ("good", "notices", "unknown_phase")]
    assert log.tables["calls"].count() == len(RECORDED["calls"]) and log.tables["notices"].count() == len(RECORDED["notices"])


def test_wrong_logs_are_errors(spark, tmp_path):
    with pytest.raises(L.EventLogError, match="no event log"):
        L.read_log(spark, str(tmp_path / "none"))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/other.parquet").mkdir()
    (tmp_path / "a/calls").mkdir()
    with pytest.raises(L.EventLogError, match="calls has neither Parquet nor JSON files; other.parquet is no kind of events"):
        L.read_log(spark, str(tmp_path / "a"))
    write_json(tmp_path / "b", {"spies": []})
    with pytest.raises(L.EventLogError, match="cases are missing"):
        L.read_log(spark, str(tmp_path / "b"))
    spark.createDataFrame([("p", 1, True)], "project string, case int, status boolean").write.parquet(str(tmp_path / "c/cases.parquet"))
    with pytest.raises(L.EventLogError, match="cases.status is boolean, not string"):
        L.read_log(spark, str(tmp_path / "c"))
    spark.createDataFrame([("p", "x")], "project string, case string").write.parquet(str(tmp_path / "d/cases.parquet"))
    with pytest.raises(L.EventLogError, match="cases lacks status"):
        L.read_log(spark, str(tmp_path / "d"))
    with pytest.raises(L.EventLogError, match="lacks status"):
        L.write_log({"cases": spark.createDataFrame([("p", "x")], "project string, case string")}, str(tmp_path / "e"))


def test_partitioned_tables_and_projects(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "x", "completed"), ("p2", "x", "completed"), ("7", "x", "raised")], "project string, case string, status string")
    rows.write.partitionBy("project").parquet(str(tmp_path / "log/cases"))
    log = L.read_log(spark, str(tmp_path / "log"), ["p1", "7"])
    assert sorted(r.project for r in log.tables["cases"].collect()) == ["7", "p1"] and log.rejected.count() == 0
    assert log.tables["calls"].count() == 0 and L.rule_events(log)["stages"].count() == 0


def test_stages_come_from_calls(spark, tmp_path):
    write_json(tmp_path / "log", {"cases": [("p", "x", "completed")], "calls": [("p", "x", "a", "b", "f", 1), ("p", "x", "a", "c", None, 0), ("reference", "x", "a", "b", "f", 0)]})
    events = L.rule_events(L.read_log(spark, str(tmp_path / "log")))
    assert sorted(tuple(r) for r in events["stages"].collect()) == [("p", "x", "b", 1), ("p", "x", "b.f", 1), ("p", "x", "c", 0)]
    assert {r.stage for r in events["reference_stages"].collect()} == {"b", "b.f"} and "project" not in events["reference_calls"].columns
