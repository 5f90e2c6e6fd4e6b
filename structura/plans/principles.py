"""Principles: a catalogue's checks bound to the roles of a task, findings classified as the catalogue's errors, and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import summary
from structura.plans.rules import Rule
from structura.sources.config import ConfigError, Principle, Task
from structura.sources.markers import compile_marker

#: What a finding is called that no error of the catalogue describes.
OTHER = "other"
# Builtins by which a function talks to the user, and the guard of an entry point.
IO_CALLS = ("input", "print", "open")
KEYBOARD = ("input",)


def resolve_name(name: str, entities: Sequence[dict]) -> list[dict]:
    """The entities that a dotted name of a task stands for: a module for its public top-level functions. ConfigError if none."""
    dotted = lambda e: f"{e['module']}.{e['qualname']}" if e["module"] else e["qualname"]
    if any(e["kind"] == "module" and e["module"] == name for e in entities):
        return [e for e in entities if e["module"] == name and e["kind"] == "function" and "." not in e["qualname"] and not e["name"].startswith("_")]
    found = [e for e in entities if e["kind"] != "module" and dotted(e) == name]
    if not found:
        raise ConfigError(f"no entity {name!r} in the reference")
    return found


def bind_task(principle: Principle, task: Task, reference: DataFrame) -> list[Rule]:
    """The rules that a principle's checks make on the entities that play a task's roles, with those entities' cases."""
    if task.principle != principle.id:
        raise ConfigError(f"the task is about {task.principle!r}, not {principle.id!r}")
    unknown = sorted(set(task.roles) - set(principle.roles))
    if unknown:
        raise ConfigError(f"unknown roles {', '.join(unknown)}")
    entities = [r.asDict() for r in reference.select("module", "qualname", "name", "kind", "canonical_id").collect()]  # one reference
    by_name = {f"{e['module']}.{e['qualname']}" if e["module"] else e["qualname"]: e["canonical_id"] for e in entities}
    players = {role: [e for name in names for e in resolve_name(name, entities)] for role, names in task.roles.items()}
    out: list[Rule] = []
    for check in principle.checks:
        params = dict(check.params)
        if check.target_role:
            own = players.get(check.target_role, [])
            targets = sorted({e["module"] if check.target_kind == "module" else f"{e['module']}.{e['qualname']}" for e in own})
            if check.target_kind == "class":
                params["base"] = targets[0] if targets else ""
            else:
                params["modules"] = [*params.get("modules", []), *targets]
        for e in players.get(check.role, []):
            name = f"{e['module']}.{e['qualname']}" if e["module"] else e["qualname"]
            cases = task.cases.get(name, [])
            d = {"marker": check.marker, "params": params | ({"cases": cases} if cases else {}), "module": e["module"], "qualname": e["qualname"], "severity": "error", "issues": ""}
            out += compile_marker(d, e["canonical_id"], by_name)
    return out


def _signature(p: Principle) -> Column:
    """An array of the catalogue's errors as structs (error, marker, keys, ordinal, signature)."""
    rows = [(e.id, e.detected_by, len(e.signature), k, e.signature) for k, e in enumerate(p.errors) if e.detected_by]
    made = [F.struct(F.lit(i).alias("error"), F.lit(m).alias("marker"), F.lit(n).alias("keys"), F.lit(k).alias("ordinal"), (F.create_map(*[F.lit(str(x)) for kv in s.items() for x in kv]) if s else F.create_map().cast("map<string,string>")).alias("signature")) for i, m, n, k, s in rows]
    return F.array(*made)


def classify(results: DataFrame, principle: Principle) -> DataFrame:
    """(target, rule_id, fact, error): a row for each fact of a failed result with the most specific error that fits it.

    results: target, rule_id (`marker@entity`), status, facts (array of maps of texts). Facts that no error fits are `other`.
    """
    facts = results.where("status = 'FAILED'").select("target", "rule_id", F.posexplode("facts").alias("k", "fact"))
    marker = F.substring_index("rule_id", "@", 1)
    hit = F.filter(_signature(principle), lambda e: (e["marker"] == marker) & C.signature_fits(F.col("fact"), e["signature"]))
    best = F.array_min(F.transform(hit, lambda e: F.struct((-e["keys"]).alias("k"), e["ordinal"].alias("o"), e["error"].alias("error"))))
    return facts.select("target", "rule_id", "k", "fact", F.coalesce(best["error"], F.lit(OTHER)).alias("error"))


def classify_targets(results: DataFrame, principle: Principle, missing: DataFrame, syntax_errors: DataFrame) -> DataFrame:
    """(target, error, rule_id) of each target: findings, a missing entity once for each entity, and syntax errors, which stand for all that follows from them.

    missing: target, source_id; syntax_errors: target, path.
    """
    broken = syntax_errors.select("target", F.lit("syntax_error").alias("error"), F.col("path").alias("rule_id")).distinct()
    gone = missing.select("target", F.lit("missing_entity").alias("error"), F.col("source_id").alias("rule_id")).distinct()
    found = classify(results, principle).select("target", "error", "rule_id").distinct()
    return broken.unionByName(gone.unionByName(found).join(broken.select("target").distinct(), "target", "left_anti"))


def judge_submissions(findings: DataFrame, results: DataFrame) -> DataFrame:
    """(target, verdict, reason): failed with a finding, else not judged with the reason if there is one, else passed."""
    bad = findings.groupBy("target").agg(F.count("*").alias("n"))
    why = summary.not_judged_reason(results, ["target"])
    targets = results.select("target").union(findings.select("target")).distinct()
    both = targets.join(bad, "target", "left").join(why, "target", "left")
    verdict = F.when(F.col("n") > 0, "failed").when(F.col("reason").isNotNull(), "not_judged").otherwise("passed")
    return both.select("target", verdict.alias("verdict"), F.when(verdict == "not_judged", F.col("reason")).otherwise("").alias("reason"))


def verify_task(principle: Principle, mutants: DataFrame, findings: DataFrame) -> DataFrame:
    """(error, seeded, killed): for every error that an operator seeds, the mutants and those with a finding of that very error.

    mutants: mutant, operator; findings: target (a mutant), error.
    """
    wanted = [(e.id, e.operator) for e in principle.errors if e.operator]
    rows = mutants.sparkSession.createDataFrame(wanted, "error string, operator string")
    seeded = mutants.select("mutant", "operator").distinct().join(F.broadcast(rows), "operator")  # errors of one catalogue entry
    hit = findings.select(F.col("target").alias("mutant"), "error").distinct().withColumn("hit", F.lit(1))
    return rows.select("error").join(seeded.join(hit, ["mutant", "error"], "left").groupBy("error").agg(F.count("*").alias("seeded"), F.count("hit").alias("killed")), "error", "left").fillna(0, ["seeded", "killed"])


def verify_marker(results: DataFrame, marker: str) -> DataFrame:
    """(mutant, outcome) of one marker's rules on mutants: killed, not_run or survived."""
    return summary.mutant_outcomes(results.where(C.rule_matches("rule_id", [marker])), ["mutant"])


# ---- reference-free: who plays which role


@dataclass(frozen=True)
class Predicates:
    """What discovery takes a call for, as functions of the callee's column: reading from a user, and talking to one at all."""

    reads: Callable[[Column], Column] = lambda callee: callee.isin(*KEYBOARD)
    talks: Callable[[Column], Column] = lambda callee: callee.isin(*IO_CALLS)


def io_roles(calls: DataFrame, entry_points: DataFrame, predicates: Predicates = Predicates()) -> DataFrame:
    """(project, function, role): `io` reads the keyboard, is an entry point, or calls a helper that reads; `logic` is what io calls
    directly; a logic function that talks to the user itself is `disputed`. Other functions play none.

    calls: project, caller, callee (project functions, or builtins by name); entry_points: project, function. predicates say
    which callees read and talk.
    """
    read, talk = predicates.reads(F.col("callee")), predicates.talks(F.col("callee"))
    reads = calls.where(read).select("project", F.col("caller").alias("function")).distinct()
    helped = calls.join(reads.withColumnRenamed("function", "callee"), ["project", "callee"]).select("project", F.col("caller").alias("function"))
    io = reads.union(helped).union(entry_points.select("project", "function")).distinct()
    called = calls.where(~talk).join(io.withColumnRenamed("function", "caller"), ["project", "caller"]).select("project", F.col("callee").alias("function")).distinct()
    logic = called.join(io, ["project", "function"], "left_anti")
    talks = calls.where(talk).select("project", F.col("caller").alias("function")).distinct().withColumn("talks", F.lit(True))
    logic = logic.join(talks, ["project", "function"], "left").select("project", "function", F.when(F.col("talks"), "disputed").otherwise("logic").alias("role"))
    return io.withColumn("role", F.lit("io")).unionByName(logic)


def encapsulation_roles(containers: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """(project, name, role): `owner` is a class with a container that its methods change; `client` every public function and every class with methods that isn't one.

    containers: project, class, attribute, changed; methods: project, class, name; functions: project, name.
    """
    owner = containers.where("changed").select("project", F.col("class").alias("name")).distinct()
    others = methods.where(~C.is_dunder("name")).select("project", F.col("class").alias("name")).distinct().join(owner, ["project", "name"], "left_anti")
    public = functions.where(~C.is_private("name")).select("project", "name").distinct()
    return owner.withColumn("role", F.lit("owner")).unionByName(public.unionByName(others).distinct().withColumn("role", F.lit("client")))


def polymorphism_roles(classes: DataFrame, bases: DataFrame, calls: DataFrame) -> DataFrame:
    """(project, name, role): `base` is an abstract class with a subclass and no abstract class of the project above it, `variant` each class
    below one, `client` who calls a base's method on something else than itself.

    classes: project, class, abstract, methods; bases: project, class, base, all ancestors; calls: project, caller, method.
    """
    abstract = classes.where("abstract").select("project", F.col("class").alias("base"))
    top = abstract.join(bases.join(abstract, ["project", "base"]).select("project", F.col("class").alias("base")).distinct(), ["project", "base"], "left_anti")
    below = bases.join(top, ["project", "base"]).select("project", F.col("class").alias("name"), "base").distinct()
    used = below.select("project", F.col("base").alias("name")).distinct()
    names = classes.join(used.withColumnRenamed("name", "class"), ["project", "class"]).select("project", F.explode("methods").alias("method")).distinct()
    client = calls.join(names, ["project", "method"]).select("project", F.col("caller").alias("name")).distinct()
    return used.withColumn("role", F.lit("base")).unionByName(below.select("project", "name").distinct().withColumn("role", F.lit("variant"))).unionByName(client.withColumn("role", F.lit("client")))


def override_roles(roles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Roles (project, function, role) with a task's overrides (project, function, action): add_io, add_logic, dispute, to_logic. None is ever taken away.

    `dispute` and `to_logic` change a role that is there; additions only fill what has none.
    """
    both = roles.join(overrides, ["project", "function"], "full")
    change = (
        F.when((F.col("action") == "to_logic") & (F.col("role") == "io"), "logic").when((F.col("action") == "dispute") & F.col("role").isNotNull(), "disputed")
        .when(F.col("role").isNotNull(), F.col("role")).when(F.col("action") == "add_io", "io").when(F.col("action") == "add_logic", "logic")
    )
    return both.select("project", "function", change.alias("role")).where("role is not null")


def applies(roles: DataFrame, projects: DataFrame, essential: Sequence[str]) -> DataFrame:
    """(project, applied): whether every essential role is played, disputed or not."""
    have = roles.where(F.col("role").isin(list(essential))).groupBy("project").agg(F.countDistinct("role").alias("n"))
    return projects.select("project").distinct().join(have, "project", "left").select("project", (F.coalesce("n", F.lit(0)) == len(set(essential))).alias("applied"))


def adjust(findings: DataFrame, disputed: DataFrame, dropped_errors: Sequence[str]) -> DataFrame:
    """Findings (project, function, error) with how they count: `disputed` where the function's role is, `dropped` for errors that
    don't hold without a reference (a call that is missing), else `violation`."""
    both = findings.join(disputed.select("project", "function", F.lit(True).alias("_d")).distinct(), ["project", "function"], "left")
    kind = F.when(F.col("error").isin(list(dropped_errors)), "dropped").when(F.col("_d"), "disputed").otherwise("violation")
    return both.select("project", "function", "error", kind.alias("counts_as"))


def global_statuses(applied: DataFrame, adjusted: DataFrame, coverage: DataFrame, mutants: DataFrame) -> DataFrame:
    """(project, status, reason) without a reference: summary.global_status over applied (project, applied), adjusted findings, coverage (project, covered)
    and mutants (project, outcome)."""
    n = adjusted.groupBy("project").agg(*[F.count_if(F.col("counts_as") == k).alias(k) for k in ("violation", "disputed", "dropped")])
    left = mutants.groupBy("project").agg(F.count_if(F.col("outcome") == "survived").alias("survived"), F.count_if(F.col("outcome") == "not_run").alias("unrun"))
    rows = applied.join(n, "project", "left").join(coverage.select("project", "covered"), "project", "left").join(left, "project", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    v = summary.global_status(F.col("applied"), zero("violation"), zero("unrun"), F.coalesce("covered", F.lit(True)), zero("survived"), zero("dropped"), zero("disputed"))
    return rows.select("project", v.alias("v")).select("project", "v.status", "v.reason")
