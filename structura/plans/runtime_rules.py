"""Rules that recorded events decide: observing markers as kinds of rules. Importing this module makes them known.

Events are tables by name: cases (project, case, status), calls, instances, imports, writes, spies, objects, members,
stages as structura.sources.observe gives them, and reference_calls, reference_stages of the reference's own run. Without
events every such rule is SKIPPED; a case that didn't complete fails its rules, or is the reference's error. A rule that lists
cases is judged by those, and SKIPPED where one of them wasn't recorded, as is any rule in a project without cases.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structura.operators import runtime
from structura.plans import rules as R
from structura.sources.markers import ALSO_OBSERVED, MARKERS, RUNTIME

Judge = Callable[[R.Context, dict], tuple[DataFrame, str, Column]]


def _edges(calls: DataFrame) -> DataFrame:
    keys = [c for c in ("project", "case") if c in calls.columns]
    return calls.select(*keys, F.col("caller").alias("origin"), F.col("callee").alias("end")).where("origin <> end")


def _cases(ctx: R.Context) -> DataFrame:
    return ctx.events["cases"].where("status = 'completed'").select("project", "case")


def _show(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def _calls(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    if p["marker"] == "require_runtime_calls":
        return runtime.missing_calls(ctx.events["calls"], _cases(ctx), p["modules"]), "missing_call", _show("case", "module")
    calls = ctx.events["calls"] if "branches" in ctx.events["calls"].columns else ctx.events["calls"].drop("function")
    return runtime.forbidden_calls(calls, p["modules"], p["allow"] or (), p["through"] or (), bool(p["transitive"])), "forbidden_call", _show("case", "caller", "callee")


def _instances(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    name = F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "qualname")
    own = ctx.entities.where("kind = 'class'").select("project", F.col("canonical_id").alias("target_id"), name.alias("class"))
    model = ctx.reference.where("kind = 'class'").select(F.col("canonical_id").alias("source_id"), name.alias("reference_class"))
    names = ctx.matches.where("status = 'MATCHED'").select("project", "source_id", "target_id").join(own, ["project", "target_id"]).join(model, "source_id").select("project", "class", "reference_class")
    made = ctx.events["instances"].select("project", "case", "creator", F.concat_ws(".", "module", "class").alias("class"), (F.col("kin") if "kin" in ctx.events["instances"].columns else F.lit(False)).alias("kin"))
    return runtime.forbidden_instances(made, names, p["modules"], p["allow"] or ()), "forbidden_instance", _show("case", "creator", "class")


def _reference_calls(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    known = ctx.reference_modules.select("module") if p["allow_new_modules"] else None
    return runtime.reference_calls(_edges(ctx.events["reference_calls"]), _edges(ctx.events["calls"]), bool(p["require_all"]), known), "call_graph_differs", _show("kind", "case", "origin", "end")


def _members(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    return runtime.member_violations(ctx.events["objects"], ctx.events["members"], p["names"], p["types"], p["marker"] == "forbid_runtime_members"), "members_differ", _show("case", "name", "reason")


def _class_kind(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    return runtime.class_kind(ctx.events["objects"], p["marker"] == "is_runtime_abstract_class"), "class_kind_differs", F.concat_ws(" ", "class", F.array_join("abstract_methods", ","))


def _protocol(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    owner = F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1))
    needed = ctx.reference.where((F.col("kind") == "method") & (owner == str(p["protocol"])) & ~F.startswith("name", F.lit("__"))).select("name", (~F.col("is_property")).alias("callable"))
    seen = ctx.events["members"]
    seen = seen if "binds" in seen.columns else seen.withColumn("binds", F.lit(True))
    return runtime.protocol_violations(ctx.events["objects"], needed, seen), "protocol_not_met", _show("case", "name", "reason")


def _pattern(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    if p["marker"] == "is_runtime_singleton":
        return ctx.events["objects"].where("not same").select("project", "case"), "not_a_singleton", _show("case")
    if p["marker"] == "enforce_runtime_observer":
        return runtime.observer_violations(ctx.events["notices"], _cases(ctx), p["unsubscribe"] is not None), "observer_differs", _show("case", "reason")
    spies = ctx.events["spies"].where(F.col("spy") == str(p["spy"]))
    return runtime.missing_delegation(spies, _cases(ctx), p["member"]), "missing_delegation", _show("case")


def _writes(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    name = ctx.entities.where("kind = 'class'").select("project", F.col("canonical_id").alias("id"), "name")
    up = ctx.ancestors().join(name.select("project", F.col("id").alias("start"), F.col("name").alias("class")), ["project", "start"]).join(name.select("project", F.col("id").alias("node"), F.col("name").alias("base")), ["project", "node"])
    # A write's function says which class's method it was made in.
    writer = F.when(F.contains("function", F.lit(".")), F.element_at(F.split("function", r"\."), -2))
    writes = ctx.events["writes"].withColumn("writer", writer).withColumn("class", F.substring_index("class", ".", -1))
    return runtime.foreign_writes(writes, up.select("project", "class", "base")), "foreign_write", _show("case", "writer", "class", "attribute", "change")


def _imports(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    return runtime.forbidden_imports(ctx.events["imports"], p["forbidden"], p["allow"] or ()), "forbidden_import", _show("importer", "imported")


def _layers(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    return runtime.runtime_layers(_edges(ctx.events["calls"]), _edges(ctx.events["reference_calls"]), p["layers"], p["closed"] or ()), "layer_violation", F.concat_ws(" ", "kind", F.array_join("path", " -> "))


def _cycles(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    return runtime.runtime_cycles(_edges(ctx.events["calls"]), _edges(ctx.events["reference_calls"])), "cycle", F.array_join("nodes", " -> ")


def _architecture(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    pairs = lambda raw: [tuple(x.strip() for x in t.split("->")) for t in raw or []]
    found = runtime.architecture_runtime(_edges(ctx.events["reference_calls"]).select("origin", "end"), _edges(ctx.events["calls"]), None, p["policy"] or "allow_new_modules", ctx.reference_modules.select("module").crossJoin(F.broadcast(ctx.projects)), bool(p["require_all"]), pairs(p["allow"]), pairs(p["forbid"]))
    bad = found.where("kind = 'divergent'" if not p["require_all"] else "kind in ('divergent', 'absent')")
    return bad, "architecture_differs", _show("kind", "origin", "end")


def _interface(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    home = p.get("module") or ""
    return runtime.module_interface_calls(ctx.events["calls"], home, p["names"] or ()), "outside_interface", _show("case", "caller", "callee", "function")


def _flow(ctx: R.Context, p: dict) -> tuple[DataFrame, str, Column]:
    found = runtime.runtime_flow(ctx.events["stages"], ctx.events["reference_stages"], p["stages"], ["seq"])
    return found.where("status <> 'OK'"), "flow_differs", _show("case", "reason")


JUDGES: dict[str, Judge] = {
    "runtime_calls": _calls, "runtime_instances": _instances, "runtime_reference_calls": _reference_calls, "runtime_members": _members, "runtime_class_kind": _class_kind, "runtime_protocol": _protocol, "runtime_pattern": _pattern,
    "runtime_writes": _writes, "runtime_imports": _imports, "runtime_layers": _layers, "runtime_cycles": _cycles, "architecture_runtime": _architecture, "runtime_module_interface": _interface, "runtime_flow": _flow,
}


def _of_cases(ctx: R.Context, rule: R.Rule) -> tuple[R.Context, list[str]]:
    """The context with the events of the cases that a rule names, and their names; of all cases where it names none."""
    names = sorted({str(c["name"]) for c in rule.params.get("cases") or [] if isinstance(c, dict) and c.get("name")})
    if not names:
        return ctx, names
    own = copy.copy(ctx)
    named = lambda k: F.col("case").isin(names) | (F.col("case").isNull() if k == "imports" else F.lit(False))  # noqa: E731  imports happen before any case
    own.events = {k: t.where(named(k)) if "case" in t.columns else t for k, t in ctx.events.items()}
    return own, names


def _failing(ctx: R.Context) -> set[str]:
    """The reference's own cases that didn't complete, asked once a run: cases of one reference."""
    if not hasattr(ctx, "failing"):
        cases = ctx.events.get("reference_cases")
        ctx.failing = set() if cases is None else {r.case for r in cases.where("status <> 'completed'").select("case").distinct().collect()}
    return ctx.failing


def _evaluator(kind: str) -> Callable[[R.Context, Sequence[R.Rule]], DataFrame]:
    def evaluate(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
        if not ctx.events:
            rows = ctx.of_projects(rules)
            return R._results(rows, F.lit(False), F.lit("dynamic_checks_disabled")).withColumn("status", F.lit("SKIPPED"))

        def judge(r: R.Rule) -> DataFrame:
            own, names = _of_cases(ctx, r)
            rows = own.of_projects([r])
            hits, reason, shown = JUDGES[kind](own, r.params)
            judged = R._by_hits(rows, hits, ["project"], reason, shown)
            # A case of the project that didn't run decides before its events: the reference's fault if it can't run it either.
            cases = own.events["cases"].groupBy("project").agg(F.min(F.when(F.col("status") != "completed", F.struct(F.lit(True).alias("x"), "status"))).alias("bad"), F.countDistinct("case").alias("recorded"))
            failing = bool(_failing(ctx) & set(names) if names else _failing(ctx))
            gate = runtime.gate(F.lit(True), F.lit(True), F.when(F.startswith("bad.status", F.lit("probe_")), F.substr("bad.status", F.lit(7))).otherwise("completed"), F.col("bad").isNull(), F.lit(not failing))
            unseen = F.coalesce("recorded", F.lit(0)) < max(1, len(names))
            skipped = F.struct(F.lit("SKIPPED").alias("status"), F.when(F.coalesce("recorded", F.lit(0)) == 0, "no_recorded_case").otherwise("case_not_recorded").alias("reason"))
            out = judged.join(cases, "project", "left").withColumn("gate", F.when(unseen & F.col("bad").isNull(), skipped).otherwise(gate))
            return out.withColumns({"status": F.coalesce("gate.status", "status"), "reason": F.coalesce("gate.reason", "reason")}).select(*judged.columns)

        return R._one(rules, judge)

    return evaluate


def _parameters(kind: str) -> dict:
    own = [m for m, k in {**RUNTIME, **ALSO_OBSERVED}.items() if k == kind]
    return {"marker": "", "module": None} | {p.lstrip("*"): None for m in own for p in MARKERS[m].split()}


for _kind in JUDGES:
    R.register(_kind, _evaluator(_kind), _parameters(_kind))
R.PROJECT_WIDE = (*R.PROJECT_WIDE, *JUDGES)
