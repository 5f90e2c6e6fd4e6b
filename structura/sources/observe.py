"""Observed events as tables: each submission's cases run in a process of its own, with a time limit, and what they did is recorded.

Code of submissions only ever runs in that process, in a folder of its own that is removed afterwards. Whatever it does,
the result is rows: a probe that times out or crashes is a status, not an error of the job.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.sources import python_source as P

OBSERVED = "project string, case string, status string, error string, events string, object string"
RECORDS = ("calls", "instances", "imports", "lines", "writes", "spies")
#: Columns of each kind of events.
EVENTS = {
    "calls": "caller string, caller_function string, callee string, function string, via array<string>", "instances": "creator string, module string, class string", "imports": "importer string, imported string, names array<string>",
    "lines": "module string, line int", "writes": "writer string, function string, class string, module string, attribute string, change string", "spies": "spy string, member string, arguments int",
}
PROBE = os.path.join(os.path.dirname(__file__), "probe.py")


def probe(files: dict[str, str], cases: Sequence[dict], record: Sequence[str] = RECORDS, timeout_s: float = 5.0) -> list[dict]:
    """(case, status, error, events, object) of each case of one project; timeouts and crashes are statuses."""

    def all_of(status: str, error: str) -> list[dict]:
        return [{"case": c.get("name", ""), "status": status, "error": error, "events": "{}", "object": None} for c in cases]

    with tempfile.TemporaryDirectory(prefix="structura-probe-") as root:
        modules = []
        for path, text in files.items():
            own = os.path.normpath(os.path.join(root, path))
            if not own.startswith(root + os.sep):
                return all_of("probe_invalid", f"a path outside the project: {path}")
            os.makedirs(os.path.dirname(own), exist_ok=True)
            with open(own, "w", encoding="utf-8") as f:
                f.write(text or "")
            if P.module_of_path(path):
                modules.append(P.module_of_path(path))
        request = {"root": root, "modules": sorted(modules), "cases": list(cases), "record": list(record)}
        environment = {"PATH": os.environ.get("PATH", ""), "PYTHONHASHSEED": "0", "PYTHONIOENCODING": "utf-8", "HOME": root, "TMPDIR": root}
        try:
            done = subprocess.run([sys.executable, "-I", "-B", PROBE], input=json.dumps(request), capture_output=True, text=True, timeout=timeout_s * max(1, len(cases)) + 5, cwd=root, env=environment, start_new_session=True)  # noqa: S603
        except subprocess.TimeoutExpired:
            return all_of("probe_timeout", f"more than {timeout_s} s a case")
        try:
            found = json.loads(done.stdout)["cases"]
        except (ValueError, KeyError):
            return all_of("probe_crashed", done.stderr[-500:])
    return [{"case": c["name"], "status": c["status"], "error": c["error"], "events": json.dumps(c.get("events", {})), "object": json.dumps(c["object"]) if c.get("object") else None} for c in found]


def observe(files: DataFrame, cases: Sequence[dict], record: Sequence[str] = RECORDS, timeout_s: float = 5.0) -> DataFrame:
    """Each case of each project (columns OBSERVED). files: project, path, text; one task a project, as a program runs whole."""
    wanted, kinds = [dict(c) for c in cases], list(record)

    def run(key, pdf):
        import pandas as pd

        rows = [{"project": key[0]} | r for r in probe(dict(zip(pdf["path"], pdf["text"])), wanted, kinds, timeout_s)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OBSERVED.split(", ")])

    return files.select("project", "path", "text").groupBy("project").applyInPandas(run, OBSERVED)


def events(observed: DataFrame, kind: str) -> DataFrame:
    """(project, case, and the columns of EVENTS) of one kind of events, in the order in which they happened (seq)."""
    rows = F.from_json(F.get_json_object("events", f"$.{kind}"), f"array<struct<{EVENTS[kind].replace(' ', ': ')}>>".replace(",: ", ", "))
    return observed.select("project", "case", F.posexplode(rows).alias("seq", "e")).select("project", "case", "seq", "e.*")


def objects(observed: DataFrame) -> DataFrame:
    """(project, case, constructible, class, abstract_methods, same, members) of the objects that inspected cases returned."""
    kind = "struct<class: string, members: array<struct<name: string, type: string, callable: boolean>>, abstract_methods: array<string>, same: boolean>"
    o = F.from_json("object", kind)
    return observed.select("project", "case", F.col("object").isNotNull().alias("constructible"), o.alias("o")).select("project", "case", "constructible", "o.class", "o.abstract_methods", "o.same", "o.members")
