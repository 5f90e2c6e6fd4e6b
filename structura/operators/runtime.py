"""Judging recorded events: calls, instances, writes, imports, members and stages that a program showed while it ran.

Event tables have `project` (a submission) and mostly `case`. Each function returns what is wrong, a row each; a project
without rows passes. Events are reduced to what is asked before anything is joined, and rules (lists of prefixes, stages,
names) are literals or small tables, never crossed with events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import edges, graph

#: Calls that test a type: they count only where their outcome is a branch.
TYPE_TESTS = ("isinstance", "type")
#: Why an observing rule has no verdict of its own, first match first.
GATES = ("dynamic_checks_disabled", "kind_mismatch", "probe_failed", "reference_case_invalid", "case_setup_failed")


def _under(name: C.Name, prefixes: Sequence[str]) -> Column:
    """Whether a dotted name is one of the prefixes or below it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | C.in_module(name, F.lit(p))
    return F.coalesce(out, F.lit(False))


def gate(dynamic: Column, kind_fits: Column, probe: Column, case_ran: Column, reference_ran: Column) -> Column:
    """struct(status, reason) that an observing rule gets before its events are looked at; null where they are to be judged.

    A case that can't run is the reference's fault (ERROR) where the reference can't run it either.
    """

    def verdict(status: str, reason: Column | str) -> Column:
        return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    return (
        F.when(~dynamic, verdict("SKIPPED", GATES[0]))
        .when(~kind_fits, verdict("FAILED", GATES[1]))
        .when(probe != "completed", verdict("FAILED", F.concat(F.lit("probe_"), probe)))
        .when(~case_ran & ~reference_ran, verdict("ERROR", GATES[3]))
        .when(~case_ran, verdict("FAILED", GATES[4]))
    )


# ---- calls and instances


def missing_calls(calls: DataFrame, cases: DataFrame, modules: Sequence[str]) -> DataFrame:
    """(project, case, module): required modules that a case calls nothing of. calls: project, case, callee; cases: project, case.

    Needs are cases times modules of the rule; each call is reduced to the modules that it meets before the join.
    """
    need = cases.select("project", "case").distinct().withColumn("module", F.explode(F.array(*[F.lit(m) for m in modules])))
    met = F.filter(F.array(*[F.when(C.in_module("callee", F.lit(m)), F.lit(m)) for m in modules]), lambda x: x.isNotNull())
    hit = calls.select("project", "case", F.explode(met).alias("module")).distinct()
    return need.join(hit, ["project", "case", "module"], "left_anti")


def forbidden_calls(calls: DataFrame, modules: Sequence[str], allow: Sequence[str] = (), through: Sequence[str] = (), transitive: bool = False) -> DataFrame:
    """(project, case, caller, callee) of calls into forbidden modules that neither the callee nor, if transitive, a module on the way excuses.

    `via` (array of modules between origin and callee; null for a direct call) matters for transitive rules only: without
    them a call counts where it has no `via`. `function`, if there is such a column, tells type tests, which count where
    `branches` holds.
    """
    own = calls.where(_under("callee", modules) & ~_under("callee", allow))
    if "via" in calls.columns:
        if transitive:
            own = own.where(~F.coalesce(F.exists("via", lambda v: _under(v, through)), F.lit(False)))
        else:
            own = own.where(F.col("via").isNull() | (F.size("via") == 0))
    if "function" in calls.columns:
        own = own.where(~F.col("function").isin(*TYPE_TESTS) | F.coalesce(F.col("branches"), F.lit(False)))
    return own.select("project", "case", "caller", "callee").distinct()


def forbidden_instances(instances: DataFrame, names: DataFrame, modules: Sequence[str], allow: Sequence[str] = ()) -> DataFrame:
    """(project, case, creator, class) of objects of forbidden modules or classes. instances: project, case, creator, class, kin.

    Classes are named as in the reference where names (project, class, reference_class) has them. One without a
    counterpart counts only where its own module is named and it looks like kin of a class there.
    """
    known = instances.join(names.select("project", "class", "reference_class"), ["project", "class"], "left")
    named = F.coalesce("reference_class", "class")
    bad = known.withColumn("named", named).where(_under("named", modules) & ~_under("named", allow) & (F.col("reference_class").isNotNull() | F.coalesce(F.col("kin"), F.lit(False))))
    return bad.select("project", "case", "creator", F.col("named").alias("class")).distinct()


def reference_calls(reference: DataFrame, target: DataFrame, require_all: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(project, case, origin, end, kind): per case, edges that the reference's run lacks (extra) and, if all are required,
    those only it has (missing). With known modules the target's new ones fold into their users first."""
    own = target.select("project", "case", "origin", "end").distinct()
    if known is not None:
        groups = own.select("project", "case").distinct()
        own = edges.fold_new_modules(own, groups.crossJoin(F.broadcast(known.select("module").distinct())), ["project", "case"])[0].select("project", "case", "origin", "end")
    model = target.select("project", "case").distinct().join(reference.select("case", "origin", "end").distinct(), "case")
    key = ["project", "case", "origin", "end"]
    extra = own.join(model, key, "left_anti").withColumn("kind", F.lit("extra"))
    return extra.unionByName(model.join(own, key, "left_anti").withColumn("kind", F.lit("missing"))) if require_all else extra


def module_interface_calls(calls: DataFrame, module: str, names: Sequence[str] = ()) -> DataFrame:
    """(project, case, caller, callee, function): calls from other modules to names of a module that aren't its interface
    (the listed names, or without any all public ones)."""
    outside = C.in_module("callee", F.lit(module)) & ~C.in_module("caller", F.lit(module))
    hidden = ~F.col("function").isin(list(names)) if names else C.is_private("function")
    return calls.where(outside & hidden).select("project", "case", "caller", "callee", "function").distinct()


def architecture_runtime(reference: DataFrame, target: DataFrame, permitted: DataFrame | None = None, policy: str = "strict", known: DataFrame | None = None, require_all: bool = False, allow: edges.Exceptions = (), forbid: edges.Exceptions = ()) -> DataFrame:
    """(project, origin, end, kind, case): all cases' edges merged, with the first case that shows each, compared with the reference's.

    Static imports may be permitted as calls. What only the reference shows is listed where all is required.
    """
    first = target.groupBy("project", "origin", "end").agg(F.min("case").alias("case"))
    found = edges.compare_edges(reference, first, policy, known=known, allow=allow, forbid=forbid, permitted=permitted, by=["project"])
    found = found if require_all else found.where("kind <> 'absent'")
    return found.join(first, ["project", "origin", "end"], "left").select("project", "origin", "end", "kind", "case")


# ---- layers, cycles, stages


def runtime_layers(calls: DataFrame, reference: DataFrame, layers: Sequence[str], closed: Sequence[str] = ()) -> DataFrame:
    """(project, kind, origin_layer, target_layer, path) of direct calls against the layers, less those that the reference makes too."""
    found = graph.layer_violations(calls.select("project", "origin", "end").distinct(), layers, closed=closed, chains=False, by=["project"])
    same = graph.layer_violations(reference.select("origin", "end").distinct(), layers, closed=closed, chains=False)
    return found.join(same.select("kind", "path").distinct(), ["kind", "path"], "left_anti").select("project", "kind", "origin_layer", "target_layer", "path")


def runtime_cycles(calls: DataFrame, reference: DataFrame) -> DataFrame:
    """(project, component, nodes) of the target's cycles that lie within none of the reference's."""
    own = graph.strongly_connected(calls.select("project", "origin", "end").distinct(), ["project"])
    model = graph.strongly_connected(reference.select("origin", "end").distinct()).select("node", F.col("component").alias("home"))
    # Within one of the reference's: all nodes have the same home there.
    out = own.join(model, "node", "left").groupBy("project", "component").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.count("home").alias("homed"), F.min("home").alias("a"), F.max("home").alias("b"))
    return out.where((F.col("homed") < F.size("nodes")) | (F.col("a") != F.col("b"))).select("project", "component", "nodes")


def runtime_flow(calls: DataFrame, reference: DataFrame, stages: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(project, case, status, reason): whether each case meets the stages in order. calls: project, case, stage and order columns.

    The reference's own run decides what a case needs: ERROR where it calls no stage or misses one; else the target's
    calls must contain the reference's as a greedy subsequence. Only calls of stages are gathered, one array a case.
    """
    listed = list(stages)

    def runs(df: DataFrame, keys: list[str]) -> DataFrame:
        own = df.where(F.col("stage").isin(listed)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "stage"))).alias("s"))
        return own.select(*keys, F.transform("s", lambda x: x["stage"]).alias("called"))

    model = runs(reference, ["case"]).withColumnRenamed("called", "model")
    cases = calls.select("project", "case").distinct()
    both = cases.join(model, "case", "left").join(runs(calls, ["project", "case"]), ["project", "case"], "left")
    none, missing = F.col("model").isNull(), F.size(F.array_except(F.array(*[F.lit(s) for s in listed]), "model")) > 0
    called = F.coalesce("called", F.array().cast("array<string>"))
    kept = F.aggregate(called, F.lit(0), lambda k, s: F.when(s == F.get("model", k), k + 1).otherwise(k)) == F.size("model")
    return both.select(
        "project", "case", F.when(none | missing, "ERROR").when(kept, "OK").otherwise("FAILED").alias("status"),
        F.when(none, "reference_calls_nothing").when(missing, "reference_misses_stage").when(kept, "").otherwise("out_of_order").alias("reason"),
    )


# ---- objects


def member_violations(built: DataFrame, observed: DataFrame, names: Sequence[str], types: dict[str, str] | None = None, forbidden: bool = False) -> DataFrame:
    """(project, case, name, reason) about built objects. built: project, case, constructible; observed: project, case, name, type.

    An object that can't be built is a violation itself. Required members must be there, with their types where given;
    forbidden ones must not.
    """
    bad = built.where(~F.col("constructible")).select("project", "case", F.lit(None).cast("string").alias("name"), F.lit("not_constructible").alias("reason"))
    have = observed.where(F.col("name").isin(list(names))).select("project", "case", "name", "type").distinct()
    good = built.where("constructible").select("project", "case")
    if forbidden:
        return bad.unionByName(have.join(good, ["project", "case"]).select("project", "case", "name", F.lit("present").alias("reason")).distinct())
    need = good.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    both = need.join(have, ["project", "case", "name"], "left")
    expected = F.create_map(*[F.lit(x) for kv in (types or {}).items() for x in kv])[F.col("name")] if types else F.lit(None).cast("string")
    reason = F.when(F.col("type").isNull(), "missing").when(expected.isNotNull() & (expected != F.col("type")), "type_differs")
    return bad.unionByName(both.withColumn("reason", reason).where("reason is not null").select("project", "case", "name", "reason").distinct())


def class_kind(classes: DataFrame, abstract: bool) -> DataFrame:
    """(project, class, abstract_methods) of classes of the wrong kind: with abstract methods left, or where they should be abstract without any."""
    left = F.size(F.coalesce("abstract_methods", F.array().cast("array<string>"))) > 0
    return classes.where(~left if abstract else left).select("project", "class", "abstract_methods")


def protocol_violations(built: DataFrame, needed: DataFrame, observed: DataFrame) -> DataFrame:
    """(project, case, name, reason): protocol members that a built object lacks, that aren't callable, or whose signature doesn't bind.

    needed: name, callable; observed: project, case, name, callable, binds.
    """
    need = built.select("project", "case").distinct().crossJoin(F.broadcast(needed.select("name", F.col("callable").alias("must"))))  # members of one protocol
    both = need.join(observed.groupBy("project", "case", "name").agg(F.max("callable").alias("callable"), F.max("binds").alias("binds")), ["project", "case", "name"], "left")
    reason = F.when(F.col("callable").isNull(), "missing").when(F.col("must") & ~F.col("callable"), "not_callable").when(F.col("must") & ~F.col("binds"), "does_not_bind")
    return both.withColumn("reason", reason).where("reason is not null").select("project", "case", "name", "reason")


def singleton_violations(obtained: DataFrame) -> DataFrame:
    """(project, case, objects): cases that obtain more than one object. obtained: project, case, object."""
    return obtained.groupBy("project", "case").agg(F.countDistinct("object").alias("objects")).where("objects > 1")


def observer_violations(notices: DataFrame, cases: DataFrame, unsubscribes: bool = True) -> DataFrame:
    """(project, case, reason): a subscriber that wasn't told after it subscribed, or was after it left. notices: project, case, phase."""
    seen = notices.groupBy("project", "case").agg(F.max(F.col("phase") == "subscribed").alias("told"), F.max(F.col("phase") == "unsubscribed").alias("late"))
    both = cases.select("project", "case").distinct().join(seen, ["project", "case"], "left")
    reason = F.when(~F.coalesce("told", F.lit(False)), "not_notified")
    if unsubscribes:
        reason = reason.when(F.col("late"), "notified_after_leaving")
    return both.withColumn("reason", reason).where("reason is not null").select("project", "case", "reason")


def missing_delegation(spies: DataFrame, cases: DataFrame, member: str | None = None) -> DataFrame:
    """(project, case): cases in which the injected spy (or this member of it) isn't called."""
    hit = spies if member is None else spies.where(F.col("member") == member)
    return cases.select("project", "case").distinct().join(hit.select("project", "case").distinct(), ["project", "case"], "left_anti")


def foreign_writes(writes: DataFrame, family: DataFrame) -> DataFrame:
    """(project, case, writer, class, attribute, change): writes to an object from outside its class and the bases of it.

    writes: project, case, writer (a class, null for other code), class, attribute, change; family: project, class, base,
    with every base, however far.
    """
    own = family.select("project", "class", F.col("base").alias("writer")).distinct()
    outside = writes.where(F.col("writer").isNull() | (F.col("writer") != F.col("class")))
    return outside.join(own, ["project", "class", "writer"], "left_anti").select("project", "case", "writer", "class", "attribute", "change").distinct()


def forbidden_imports(imports: DataFrame, forbidden: Sequence[str], allow: Sequence[str] = ()) -> DataFrame:
    """(project, importer, imported, prefix): what target code imported under forbidden prefixes while it loaded; the first prefix in order."""
    bad = imports.withColumn("prefix", C.first_prefix("imported", list(forbidden))).where(F.col("prefix").isNotNull() & ~_under("imported", allow))
    return bad.select("project", "importer", "imported", "prefix").distinct()


def translate(rows: DataFrame, names: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column's names as the reference's where names (project, target, reference) has them; unmatched ones stay."""
    out = rows
    for c in columns:
        own = names.select("project", F.col("target").alias(c), F.col("reference").alias("_ref"))
        out = out.join(own, ["project", c], "left").withColumn(c, F.coalesce("_ref", c)).drop("_ref")
    return out.select(*rows.columns)


def unexercised(expected: DataFrame, executed: DataFrame) -> DataFrame:
    """(project, file, lines): lines that no case executed, in order. expected, executed: project, file, line."""
    left = expected.select("project", "file", "line").distinct().join(executed.select("project", "file", "line").distinct(), ["project", "file", "line"], "left_anti")
    return left.groupBy("project", "file").agg(F.array_sort(F.collect_list("line")).alias("lines"))

