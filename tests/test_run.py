import json

import pytest
from pyspark.sql import functions as F

from structura import run as X
from structura.plans import principles
from structura.sinks import report
from structura.sources import config as C
from structura.sources import evidence as E


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    reference = {"shop.py": "from typing import Annotated\nfrom rules import *\n\ndef price(qty: int, rate: int = 1) -> int:\n    __archtest__: Annotated[None, required_entity_signature()]\n    return qty * rate\n"}
    targets = {"a": {"shop.py": "def price(qty: int, rate: int = 1) -> int:\n    return qty * rate\n"}, "b": {"shop.py": "def price(amount):\n    return amount\n", "bad.py": "def (:\n"}, "old_c": {"shop.py": "x = 1\n"}}
    for name, files in {"ref": reference, **{f"subs/{k}": v for k, v in targets.items()}}.items():
        (root / name).mkdir(parents=True)
        for path, text in files.items():
            (root / name / path).write_text(text)
    (root / "run.ini").write_text(f"[run]\nreference = {root}/ref\ntargets = {root}/subs/*\nexclude = old_*\nreport = {root}/out\n[matching]\nthreshold = 0.7\n")
    return root


def test_config(folders, tmp_path):
    c = C.load_config(str(folders / "run.ini"))
    assert c.matching.threshold == 0.7 and [t for t, _ in C.resolve_targets(c.targets, c.exclude)] == ["a", "b"]
    for text in ("[run]\nnothing = 1\n", "[other]\n", "[run]\nthreshold = x\n", "[run]\npolicy = never\n"):
        (tmp_path / "x.ini").write_text(text)
        with pytest.raises(C.ConfigError):
            C.load_config(str(tmp_path / "x.ini"))
    with pytest.raises(C.ConfigError):
        C.resolve_targets([str(folders / "none")])


def test_run_and_questions(spark, folders):
    heard = []
    document = X.run(spark, C.load_config(str(folders / "run.ini")), progress=heard.append)
    assert heard == ["facts", "markers", "matching", "rules"] and document["exit_code"] == 1
    s = document["summary"]
    assert (s["targets_total"], s["targets_failed"], s["results"]["status_counts"]["ERROR"]) == (2, 1, 1)
    assert json.loads((folders / "out/run.json").read_text()) == document
    reports = report.read_reports(spark, str(folders / "out")).cache()
    rows = {r.target: r for r in reports.collect()}
    assert rows["a"].exit_code == 0 and rows["b"].exit_code == 1 and rows["b"].counts["ERROR"] == 1
    assert {r.rule_id for r in report.explain_target(reports, "b").collect()} >= {"syntax@bad.py"}
    assert [r.targets for r in report.explain_rule(reports, "syntax").collect()] == [1]
    pages = {r.path: r.text for r in report.bundle(reports, document).collect()}
    assert len(pages) == 3 and "1 of 2 targets failed" in pages["index.md"] and any("No problems." in t for t in pages.values())
    with pytest.raises(ValueError):
        (folders / "out2").mkdir()
        (folders / "out2/run.json").write_text('{"schema_version": "0"}')
        report.read_reports(spark, str(folders / "out2"))


def test_mapping_names_are_checked(spark, folders):
    files = X.files_of(spark, C.load_config(str(folders / "run.ini")))
    with pytest.raises(C.ConfigError, match="reference shop.nothing, target z"):
        X.evaluate(files, mapping=spark.createDataFrame([("z", "shop.nothing", "shop.price")], "target string, reference string, to string"))


def test_markers_command(capsys):
    assert X.main(["markers"]) == 0 and "forbid_imports(*forbidden" in capsys.readouterr().out


def test_golden_summary(spark):
    rows = spark.createDataFrame([("a", "arch/ok", "OK", "info", "arch"), ("b", "arch/fail", "FAILED", "error", "arch")], "target string, rule_id string, status string, severity string, category string")
    s = report.run_summary(rows)
    assert s["exit_code"] == 1 and s["summary"]["targets_failed"] == 1 and s["summary"]["results"]["status_counts"] == {"FAILED": 1, "OK": 1} and s["summary"]["results"]["top_rules"] == [{"name": "arch/fail", "count": 1}]
    assert report.run_summary(rows, "all_fail")["exit_code"] == 0 and report.run_summary(rows, "threshold", 2)["exit_code"] == 0
    assert report.run_summary(rows.where("false"))["exit_code"] == 0


def test_module_files(spark):
    files = spark.createDataFrame([("a/b.py",), ("a/b.pyi",), ("a/c/__init__.py",), ("a/c.py",)], "path string")
    names = spark.createDataFrame([("a.b",), ("a.c",), ("a.d",)], "module string")
    assert {tuple(r) for r in C.module_files(files, names).collect()} == {("a.b", "a/b.py"), ("a.c", "a/c/__init__.py")}
    assert {tuple(r) for r in C.module_files(files, names, True).collect()} == {("a.b", "a/b.pyi"), ("a.c", "a/c/__init__.py")}


def test_catalogue_and_task(tmp_path, spark):
    (tmp_path / "io.toml").write_text('id = "io"\nname = "IO"\n[roles]\nlogic = "x"\nio = "y"\n[[checks]]\nmarker = "forbid_runtime_calls"\nrole = "logic"\nmodules = ["builtins.print"]\ntarget_role = "io"\n[[errors]]\nid = "prints"\ndetected_by = "forbid_runtime_calls"\noperator = "add_io_call"\n[errors.signature]\nkind = "call"\n')
    p = C.load_catalogue(str(tmp_path))["io"]
    (tmp_path / "task.toml").write_text('principle = "io"\n[roles]\nlogic = ["grades"]\nio = ["app.main"]\n[cases]\n"grades.mean" = [{ args = [[1]] }]\n')
    task = C.load_task(str(tmp_path))
    rows = [("grades", "", "grades", "module", "m"), ("grades", "mean", "mean", "function", "f"), ("grades", "_own", "_own", "function", "g"), ("app", "main", "main", "function", "h")]
    reference = spark.createDataFrame(rows, "module string, qualname string, name string, kind string, canonical_id string")
    rules = principles.bind_task(p, task, reference)
    assert [(r.source_id, r.rule_type, r.params["modules"]) for r in rules] == [("f", "runtime_calls", ["builtins.print", "app"])]
    with pytest.raises(C.ConfigError):
        principles.resolve_name("nothing", [r.asDict() for r in reference.collect()])
    for bad in ({"id": "x", "name": "X", "roles": {"a": ""}, "checks": [{"marker": "m", "role": "b"}]}, {"id": "x", "name": "X", "roles": {"a": ""}, "errors": [{"id": "e"}]}):
        with pytest.raises(C.ConfigError):
            C.parse_principle(bad, "x")


def test_roles_and_statuses(spark):
    roles = spark.createDataFrame([("p", "a", "io"), ("p", "b", "logic"), ("q", "a", "io")], "project string, function string, role string")
    over = spark.createDataFrame([("p", "a", "to_logic"), ("p", "b", "dispute"), ("p", "c", "add_io"), ("q", "z", "dispute")], "project string, function string, action string")
    got = {(r.project, r.function): r.role for r in principles.override_roles(roles, over).collect()}
    assert got == {("p", "a"): "logic", ("p", "b"): "disputed", ("p", "c"): "io", ("q", "a"): "io"}
    applied = principles.applies(roles, roles, ["io", "logic"])
    found = spark.createDataFrame([("p", "b", "prints"), ("p", "a", "missing")], "project string, function string, error string")
    adjusted = principles.adjust(found, spark.createDataFrame([("p", "b")], "project string, function string"), ["missing"])
    assert {(r.error, r.counts_as) for r in adjusted.collect()} == {("prints", "disputed"), ("missing", "dropped")}
    none = spark.createDataFrame([], "project string, covered boolean"), spark.createDataFrame([], "project string, outcome string")
    got = {r.project: (r.status, r.reason) for r in principles.global_statuses(applied, adjusted, *none).collect()}
    assert got == {"p": ("unverified", "dropped"), "q": ("not_applied", "no_role")}


def test_evidence(spark):
    text = "import os\nfrom a import B\n\nclass C(B):\n    def m(self):\n        os.getcwd()\n        __import__('x')\n        return C()\n"
    rows = E.evidence(text, "p/m.py")
    assert {(r["kind"], r["name"]) for r in rows} == {("import", "os"), ("import", "a"), ("class", "C"), ("function", "C.m"), ("call", "os.getcwd"), ("dynamic_import", "__import__"), ("instantiation", "C")}
    assert E.canonical_text({"b": [2, 1], "a": {"d": None, "c": 1}}) == '{"a":{"c":1,"d":null},"b":[1,2]}'
    files = spark.createDataFrame([("p", "target", "m.py", text), ("p", "target", "x.py", "def (")], "project string, role string, path string, text string")
    got = E.collect(files)
    assert {r.kind: r.n for r in E.statistics(got).collect()} == {"import": 2, "class": 1, "function": 1, "call": 1, "dynamic_import": 1, "instantiation": 1}
    entities = spark.createDataFrame([("_x.y", "function"), ("A.__init__", "method"), ("A", "class")], "qualname string, kind string")
    assert {v: E.in_scope(entities, v).count() for v in ("all", "public", "top_level", "classes")} == {"all": 3, "public": 2, "top_level": 1, "classes": 2}
    assert got.where(F.length("evidence_id") == 16).count() == 7
