"""Rules over facts: a rule names a kind, an entity of the reference and parameters; evaluators judge it on every project.

Evaluators are functions (context, rules of one kind) -> results, each one set query over all rules and projects. A rule
whose parameters are bad is never given defaults: it fails on every project with the reason. Results of all kinds are unioned.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import aliases, edges, graph, linearize, module_graph, paths, selection
from structura.plans.scratch import Rounds
from structura.sources import python_source as P

RESULT = ["project", "rule_id", "rule_type", "source_id", "target_id", "status", "severity", "reason", "detail"]

#: Enumeration bases of the standard library and the decorators that mark abstract and final definitions: fixed values.
ENUMS = ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")
ABSTRACT = ("abstractmethod", "abc.abstractmethod", "abstractproperty", "abc.abstractproperty")
FINAL = ("final", "typing.final", "typing_extensions.final")

#: For each kind its parameters with their types; a missing one takes the default in PARAMETERS' value.
PARAMETERS: dict[str, dict[str, object]] = {
    "import_policy": {"forbidden": [], "allow": [], "mode": "reachable", "ignore_type_checking": True, "ignore_globs": [], "scope": "package", "package": ""},
    "module_cycles": {"ignore_type_checking": True},
    "module_layers": {"layers": [], "closed": [], "ignore_type_checking": True},
    "architecture_static": {"policy": "allow_new_modules", "allow": [], "forbid": [], "require_all": False, "ignore_type_checking": True},
    "nominal_type": {"base": "", "relation": "transitive", "negated": False},
    "enum_type": {},
    "abstract_class": {"negated": False},
    "decorated": {"decorators": "final", "negated": False},
    "method_set": {"names": [], "pattern": "", "declared_only": False, "method_kind": "any", "min_count": 1, "max_count": None},
    "member_absence": {"names": [], "pattern": "", "declared_only": False, "member_kind": "any", "storage": "any", "descriptor_kinds": [], "include_dynamic_attributes": False},
    "attribute_contract": {"name": "", "storage": "any", "annotation": None, "require_writable": False, "declared_only": False, "allow_property": False, "allow_missing": False, "descriptor_kinds": [], "include_dynamic_attributes": False, "interpret_dataclass_fields": False},
    "api_signature": {"mode": "compatible", "allow_extra_params": True, "allow_param_rename": False},
    "protocol_conformance": {"protocol": "", "mode": "compatible", "enforce_method_kind": True},
    "module_interface": {"names": [], "ignore_type_checking": True},
    "private_access": {"allow": []},
}
CHOICES = {
    "mode": ("reachable", "direct", "compatible", "exact", "any"), "policy": edges.POLICIES, "relation": ("exact", "direct", "transitive"), "method_kind": ("any", "instance", "class", "static"),
    "storage": ("any", "class", "instance", "property"), "scope": ("package", "module"), "member_kind": ("any", "method", "attribute", "property"), "decorators": ("final", "abstract"),
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    source_id: str = ""
    severity: str = "error"
    params: dict = field(default_factory=dict)


def compile_rules(rules: Sequence[Rule]) -> tuple[list[Rule], list[tuple[Rule, str]]]:
    """(usable rules with all parameters, unusable rules with what is wrong with them)."""
    good: list[Rule] = []
    bad: list[tuple[Rule, str]] = []
    for r in rules:
        known = PARAMETERS.get(r.rule_type)
        if known is None:
            bad.append((r, f"unknown rule type {r.rule_type!r}"))
            continue
        wrong = [f"unknown parameter {k!r}" for k in r.params if k not in known]
        for k, v in r.params.items():
            default = known.get(k)
            if k in known and default is not None and type(v) is not type(default):
                wrong.append(f"{k} must be {type(default).__name__}")
            elif k in CHOICES and v not in CHOICES[k]:
                wrong.append(f"{k} must be one of {CHOICES[k]}")
        if r.rule_type == "module_layers" and not wrong:
            try:
                graph.parse_layers(r.params.get("layers", []), r.params.get("closed", []))
            except ValueError as e:
                wrong.append(str(e))
        if wrong:
            bad.append((r, "; ".join(wrong)))
        else:
            good.append(Rule(r.rule_id, r.rule_type, r.source_id, r.severity, {**known, **r.params}))
    return good, bad


class Context:
    """Facts, matches and what several rules ask of them, each made once."""

    def __init__(self, facts: DataFrame, matches: DataFrame, events: dict[str, DataFrame] | None = None):
        self.events = events or {}
        self.spark: SparkSession = facts.sparkSession
        self.rounds = Rounds(self.spark, "rules")
        self.facts, self.matches = facts, self.rounds.keep(matches)
        target, source = facts.where("role = 'target'"), facts.where("role = 'source'")
        self.entities, self.reference = P.entities(target), P.entities(source)
        self.imports, self.reference_imports = P.import_edges(target), P.import_edges(source)
        self.modules = target.where("error is null").select("project", "module")
        self.reference_modules = source.where("error is null").select("project", "module")
        self.projects = target.select("project").distinct()
        self._made: dict[tuple, DataFrame] = {}

    def once(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """What several rules ask of the same facts, written once."""
        if key not in self._made:
            self._made[key] = self.rounds.keep(make())
        return self._made[key]

    def module_edges(self, ignore_type_checking: bool) -> DataFrame:
        return self.once(("edges", ignore_type_checking), lambda: module_graph.module_edges(self.imports, self.modules, ignore_type_checking))

    def rules(self, rules: Sequence[Rule]) -> DataFrame:
        return self.spark.createDataFrame([(r.rule_id, r.rule_type, r.source_id, r.severity, json.dumps(r.params)) for r in rules], "rule_id string, rule_type string, source_id string, severity string, params string")

    def matched(self, rules: Sequence[Rule]) -> DataFrame:
        """Rules with the entity of each project that their source is matched with."""
        found = self.matches.where("status = 'MATCHED'").select("project", "source_id", "target_id")
        return self.rules(rules).join(found, "source_id")

    def of_projects(self, rules: Sequence[Rule]) -> DataFrame:
        """Rules that ask about a whole project."""
        return self.projects.crossJoin(F.broadcast(self.rules(rules))).withColumn("target_id", F.lit(None).cast("string"))

    def ordered_bases(self) -> DataFrame:
        """(project, class, place, base): direct bases of classes in order, by canonical identifier where a project's class can be told, else as spelled."""
        return self.once(("ordered_bases",), self._ordered_bases)

    def _ordered_bases(self) -> DataFrame:
        c = self.entities.where("kind = 'class'")
        spelled = c.select("project", F.col("canonical_id").alias("class"), "module", F.posexplode("bases").alias("place", "base")).withColumn("base", F.regexp_replace("base", r"\[.*$", ""))
        here = F.when(F.col("module") != "", F.concat_ws(".", "module", "base")).otherwise(F.col("base"))
        spelled = self.rounds.keep(spelled.withColumn("here", here).drop("module"))
        named = self.rounds.keep(c.select("project", F.col("canonical_id").alias("id"), F.when(F.col("module") != "", F.concat_ws(".", "module", "qualname")).otherwise(F.col("qualname")).alias("dotted")))
        tried = spelled.select("project", "class", "place", F.explode(F.array("base", "here")).alias("dotted")).distinct()
        # What is no class by itself may be a name that another module imports or a package re-exports.
        unknown = tried.join(named, ["project", "dotted"], "left_anti").select("project", F.col("dotted").alias("name")).distinct()
        pointers = P.aliases(self.facts.where("role = 'target'")).select("project", "name", "target")
        passed_on = unknown.select("project", "name", F.explode(C.prefixes("name")).alias("prefix")).join(pointers.select("project", F.col("name").alias("prefix")).distinct(), ["project", "prefix"]).select("project", "name").distinct()
        passed_on = self.rounds.keep(passed_on)
        if not passed_on.isEmpty():
            meant = aliases.rewritten(passed_on, pointers, ["project"]).where("resolved is not null").select("project", F.col("name").alias("dotted"), "resolved")
            tried = tried.unionByName(tried.join(meant, ["project", "dotted"]).select("project", "class", "place", F.col("resolved").alias("dotted")))
        found = tried.join(named, ["project", "dotted"]).where("id <> class").groupBy("project", "class", "place").agg(F.min("id").alias("id"))
        return spelled.join(found, ["project", "class", "place"], "left").select("project", "class", "place", F.coalesce("id", "base").alias("base"), F.col("id").isNotNull().alias("own"))

    def bases(self) -> DataFrame:
        """(project, origin, end): direct bases of classes, by canonical identifier, where a project's class can be told."""
        return self.ordered_bases().where("own").select("project", F.col("class").alias("origin"), F.col("base").alias("end")).distinct()

    def lookup(self) -> DataFrame:
        """(project, owner_id, holder, place): each class with itself (0) and its ancestors in the order in which Python looks members up.

        A class that Python would refuse (its bases contradict each other) has its ancestors in no order, after itself.
        """
        return self.once(("lookup",), self._lookup)

    def _lookup(self) -> DataFrame:
        orders = self.rounds.keep(linearize.linearize(self.ordered_bases(), ["project"]))
        classes = self.entities.where("kind = 'class'").select("project", F.col("canonical_id").alias("owner_id"))
        ordered = linearize.positions(orders, ["project"]).withColumnRenamed("class", "owner_id").join(classes, ["project", "owner_id"], "left_semi").select("project", "owner_id", "holder", "place")
        rest = classes.join(orders.where("mro is not null").select("project", F.col("class").alias("owner_id")), ["project", "owner_id"], "left_anti")
        above = rest.join(self.ancestors().select("project", F.col("start").alias("owner_id"), F.col("node").alias("holder")), ["project", "owner_id"]).withColumn("place", F.lit(1))
        return ordered.unionByName(rest.select("project", "owner_id", F.col("owner_id").alias("holder"), F.lit(0).alias("place"))).unionByName(above)

    def ancestors(self) -> DataFrame:
        """(project, start, node): all ancestors of every class."""
        return self.once(("ancestors",), lambda: graph.reachable(self.bases(), by=["project"]).where("start <> node"))

    def methods(self) -> DataFrame:
        """(project, owner_id, and the method's columns): the methods that a class itself declares."""
        return self.once(("methods",), self._methods)

    def _methods(self) -> DataFrame:
        m = self.entities.where("kind = 'method'").withColumn("owner", F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1))
        c = self.entities.where("kind = 'class'").select("project", "module", F.col("qualname").alias("owner"), F.col("canonical_id").alias("owner_id"))
        return m.join(c, ["project", "module", "owner"])

    def offered(self, declared_only: bool = False) -> DataFrame:
        """methods(), and those of ancestors whose names a class doesn't declare itself."""
        own = self.methods().withColumn("inherited", F.lit(False))
        return own if declared_only else self.once(("offered",), lambda: self._offered(own))

    def _offered(self, own: DataFrame) -> DataFrame:
        reached = self.lookup().withColumnRenamed("owner_id", "heir").join(own.withColumnRenamed("owner_id", "holder"), ["project", "holder"])
        first = Window.partitionBy("project", "heir", "name").orderBy("place", "holder")
        nearest = reached.withColumn("_n", F.dense_rank().over(first)).where("_n = 1")  # a class may define a name more than once
        return nearest.withColumn("inherited", F.col("place") > 0).withColumnRenamed("heir", "owner_id").select(*own.columns)


def _results(rows: DataFrame, ok: Column, reason: Column, detail: Column | None = None) -> DataFrame:
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return rows.select("project", "rule_id", "rule_type", "source_id", "target_id", F.when(ok, "OK").otherwise("FAILED").alias("status"), "severity", F.when(~ok, reason).alias("reason"), F.when(~ok, detail).alias("detail"))


def _by_hits(rows: DataFrame, hits: DataFrame, keys: Sequence[str], reason: str, show: Column) -> DataFrame:
    """A rule fails where it has hits; the detail lists them in order."""
    listed = hits.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(show)), "; ").alias("_hits"))
    return _results(rows.join(listed, list(keys), "left"), F.col("_hits").isNull(), F.lit(reason), F.col("_hits"))


def _p(name: str, kind: str = "string") -> Column:
    return F.from_json("params", f"struct<{name}: {kind}>")[name]


def _one(rules: Sequence[Rule], f: Callable[[Rule], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(r) for r in rules])


def _scope(ctx: Context, r: Rule) -> DataFrame:
    """(project, start): the modules in which a rule about imports looks."""
    own = ctx.modules.select("project", F.col("module").alias("start")).distinct()
    if r.params["scope"] == "module":
        module = ctx.entities.select("project", F.col("canonical_id").alias("target_id"), F.col("module").alias("start"))
        return own.join(ctx.matched([r]).join(module, ["project", "target_id"]).select("project", "start"), ["project", "start"], "left_semi")
    return own.where(C.in_module("start", F.lit(r.params["package"]))) if r.params["package"] else own


#: Paths that a result lists; it counts all.
REPORTED = 25


def import_policy(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """No import under a forbidden prefix, directly or through the project's own modules; allowed prefixes end a path.

    Reachable imports are counted, all of them, and a shortest path is listed for each pair of ends, the shortest REPORTED;
    imports inside functions lead no further. The scope is a package (all modules unless one is named), or the module that is
    matched with the rule's own; it says where a path begins.
    """

    def judge(r: Rule) -> DataFrame:
        p = r.params
        rows = module_graph.without_ignored(ctx.imports, p["ignore_globs"])
        rows = rows.where(~F.col("in_type_checking")) if p["ignore_type_checking"] else rows
        names = ["project", F.col("importer").alias("origin"), F.col("imported").alias("end")]
        starts = _scope(ctx, r)
        if p["mode"] == "direct":
            bad = rows.select(*names).join(starts.select("project", F.col("start").alias("origin")), ["project", "origin"], "left_semi").where(C.first_prefix("end", p["forbidden"]).isNotNull() & C.first_prefix("end", p["allow"]).isNull()).select("project", F.concat_ws(" -> ", "origin", "end").alias("hit"))
            return _by_hits(ctx.of_projects([r]), bad, ["project"], "forbidden_import", F.col("hit"))
        starts = starts.where(C.first_prefix("start", p["allow"]).isNull()) if p["allow"] else starts
        asked = (ctx.rounds.keep(rows.where("is_top_level").select(*names).distinct()), ctx.rounds.keep(starts), p["forbidden"], p["allow"], ctx.modules, ["project"])
        total = paths.path_counts(*asked).groupBy("project").agg(F.sum("paths").alias("n"))
        shown = selection.top_k(paths.shortest_paths(*asked), ["project"], [F.size("path"), F.array_join("path", " ")], REPORTED)
        listed = shown.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: F.array_join(x["path"], " -> ")), "; ").alias("shown"))
        out = ctx.of_projects([r]).join(total, "project", "left").join(listed, "project", "left")
        return _results(out, F.col("n").isNull(), F.lit("forbidden_import"), F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " path: ").otherwise(" paths: "), F.col("shown")))

    return _one(rules, judge)


def module_cycles(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    def judge(r: Rule) -> DataFrame:
        own = ctx.module_edges(r.params["ignore_type_checking"])
        cycles = graph.cycle_paths(own, graph.strongly_connected(own, ["project"]), ["project"])
        if cycles is None:
            cycles = own.select("project", F.array("origin").alias("path")).where("false")
        return _by_hits(ctx.of_projects([r]), cycles, ["project"], "import_cycle", F.array_join("path", " -> "))

    return _one(rules, judge)


def module_layers(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    def judge(r: Rule) -> DataFrame:
        own = ctx.module_edges(r.params["ignore_type_checking"])
        bad = graph.layer_violations(own, r.params["layers"], r.params["closed"], by=["project"])
        return _by_hits(ctx.of_projects([r]), bad, ["project"], "layer_violation", F.concat_ws(": ", "kind", F.array_join("path", " -> ")))

    return _one(rules, judge)


def architecture_static(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """The reference's module edges are the model; divergent edges fail, absent ones only if all are required."""

    def judge(r: Rule) -> DataFrame:
        p = r.params
        model = module_graph.module_edges(ctx.reference_imports, ctx.reference_modules, p["ignore_type_checking"]).select("origin", "end")
        own = ctx.module_edges(p["ignore_type_checking"])
        known = ctx.projects.crossJoin(F.broadcast(ctx.reference_modules.select("module").distinct()))
        pairs = lambda xs: [tuple(s.strip() for s in x.split("->")) for x in xs]
        diff = edges.compare_edges(model, own, p["policy"], known, pairs(p["allow"]), pairs(p["forbid"]), by=["project"])
        bad = diff.where(F.col("kind").isin("divergent", "absent") if p["require_all"] else F.col("kind") == "divergent")
        return _by_hits(ctx.of_projects([r]), bad, ["project"], "architecture_differs", F.concat(F.col("kind"), F.lit(" "), C.format_edge("origin", "end")))

    return _one(rules, judge)


def nominal_type(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """The counterpart of the base is the class itself (exact), among its direct bases, or among all ancestors."""
    base = ctx.matches.where("status = 'MATCHED'").select("project", F.col("source_id").alias("base"), F.col("target_id").alias("base_id"))
    rows = ctx.matched(rules).withColumns({"base": _p("base"), "relation": _p("relation"), "negated": _p("negated", "boolean")}).join(base, ["project", "base"], "left")
    direct = ctx.bases().select("project", F.col("origin").alias("target_id"), F.col("end").alias("base_id"), F.lit(True).alias("direct"))
    every = ctx.ancestors().select("project", F.col("start").alias("target_id"), F.col("node").alias("base_id"), F.lit(True).alias("above"))
    rows = rows.join(direct, ["project", "target_id", "base_id"], "left").join(every, ["project", "target_id", "base_id"], "left")
    itself = F.coalesce(F.col("target_id") == F.col("base_id"), F.lit(False))
    has = F.when(F.col("relation") == "direct", F.coalesce("direct", F.lit(False))).otherwise(F.coalesce("above", F.lit(False)))
    ok = F.when(F.col("base_id").isNull(), F.lit(False)).when(F.col("relation") == "exact", itself).when(itself, F.lit(False)).otherwise(has != F.col("negated"))
    return _results(rows, ok, F.when(F.col("base_id").isNull(), "base_not_matched").otherwise("nominal_relation_differs"))


def enum_type(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    last = F.transform("bases", lambda b: F.substring_index(b, ".", -1))
    direct = ctx.entities.where("kind = 'class'").where(F.arrays_overlap(last, F.array(*map(F.lit, ENUMS)))).select("project", F.col("canonical_id").alias("target_id"))
    heirs = ctx.ancestors().select("project", F.col("start").alias("heir"), F.col("node").alias("target_id")).join(direct, ["project", "target_id"]).select("project", F.col("heir").alias("target_id"))
    hit = direct.union(heirs).distinct().withColumn("hit", F.lit(True))
    return _results(ctx.matched(rules).join(hit, ["project", "target_id"], "left"), F.col("hit").isNotNull(), F.lit("not_an_enum"))


def abstract_class(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """A class is abstract while a method that it or an ancestor marks abstract has no other definition nearer to it."""
    marked = F.arrays_overlap("decorators", F.array(*map(F.lit, ABSTRACT)))
    own = ctx.methods().select("project", "owner_id", "name", marked.alias("abstract"))
    up = ctx.ancestors().select("project", F.col("start").alias("owner_id"), F.col("node").alias("above"))
    inherited = up.join(own.select("project", F.col("owner_id").alias("above"), "name", "abstract"), ["project", "above"])
    open_above = inherited.where("abstract").select("project", "owner_id", "name", "above")
    # Between a class and an abstract method of an ancestor: the class itself, or another ancestor that derives from that one.
    closer = inherited.where("not abstract").select("project", "owner_id", "name", F.col("above").alias("by"))
    derives = ctx.ancestors().select("project", F.col("start").alias("by"), F.col("node").alias("above"))
    closed = open_above.join(closer, ["project", "owner_id", "name"]).join(derives, ["project", "by", "above"]).select("project", "owner_id", "name", "above").distinct()
    left = open_above.join(closed, ["project", "owner_id", "name", "above"], "left_anti").select("project", "owner_id", "name").union(own.where("abstract").select("project", "owner_id", "name"))
    left = left.join(own.where("not abstract").select("project", "owner_id", "name"), ["project", "owner_id", "name"], "left_anti")
    n = left.groupBy("project", F.col("owner_id").alias("target_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    rows = ctx.matched(rules).join(n, ["project", "target_id"], "left")
    return _results(rows, F.col("names").isNotNull() != _p("negated", "boolean"), F.when(F.col("names").isNull(), "class_is_concrete").otherwise("class_is_abstract"), F.col("names"))


def decorated(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    e = ctx.entities.select("project", F.col("canonical_id").alias("target_id"), F.arrays_overlap("decorators", F.array(*map(F.lit, FINAL))).alias("final"), F.arrays_overlap("decorators", F.array(*map(F.lit, ABSTRACT))).alias("abstract"))
    rows = ctx.matched(rules).join(e, ["project", "target_id"])
    has = F.when(_p("decorators") == "final", F.col("final")).otherwise(F.col("abstract"))
    return _results(rows, has != _p("negated", "boolean"), F.when(has, "decorator_present").otherwise("decorator_missing"))


def with_params(rows: DataFrame, fields: str) -> DataFrame:
    """Rules' parameters as a column p, so that one plan judges any number of rules."""
    return rows.withColumn("p", F.from_json("params", f"struct<{fields}>"))


#: How a rule chooses members: by names, else by a pattern, else all.
SELECTION = "names: array<string>, pattern: string, declared_only: boolean"


def chosen() -> Column:
    """Whether a row's rule (p) chooses its member (name, inherited)."""
    named = F.when(F.size("p.names") > 0, F.array_contains("p.names", F.col("name"))).when(F.col("p.pattern") != "", F.rlike("name", F.concat(F.lit("^(?:"), F.col("p.pattern"), F.lit(")$")))).otherwise(True)
    return named & ~(F.col("p.declared_only") & F.col("inherited"))


def is_any(of: str, column: str) -> Column:
    """Whether a rule's choice is any, or what a column says."""
    return (F.col(of) == "any") | F.coalesce(F.col(column) == F.col(of), F.lit(False))


def counted(rows: DataFrame, hits: DataFrame, n: Column) -> DataFrame:
    """rows with n: what a rule's hits in a project come to, 0 without any."""
    key = ["project", "rule_id", "target_id"]
    return rows.join(hits.groupBy(*key).agg(n.alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def between(rows: DataFrame, what: str) -> DataFrame:
    """Results by whether n lies between a rule's least and greatest count."""
    least, n = F.col("p.min_count"), F.col("n")
    reason = F.when((n == 0) & (least > 0), f"no_matching_{what}_found").when(n < least, f"too_few_matching_{what}").otherwise(f"too_many_matching_{what}")
    return _results(rows, (n >= least) & F.coalesce(n <= F.col("p.max_count"), F.lit(True)), reason, n)


def method_set(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """So many methods of a name, pattern and kind, own or inherited, a property's accessors once."""
    rows = with_params(ctx.matched(rules), f"{SELECTION}, method_kind: string, min_count: int, max_count: int")
    m = ctx.offered().select("project", F.col("owner_id").alias("target_id"), "name", "method_kind", "inherited")
    hits = rows.join(m, ["project", "target_id"]).where(chosen() & is_any("p.method_kind", "method_kind"))
    return between(counted(rows, hits, F.countDistinct("name")), "methods")


#: Which attributes a rule looks at besides plain ones.
ORIGINS = "descriptor_kinds: array<string>, include_dynamic_attributes: boolean, interpret_dataclass_fields: boolean"


def class_attributes(ctx: Context) -> DataFrame:
    """(project, target_id, name, storage, annotation, writable, lineno, origin, descriptor, inherited): every class's attributes and its ancestors'."""

    def make() -> DataFrame:
        c = ctx.entities.where("kind = 'class'").select("project", "module", F.col("qualname").alias("owner"), F.col("canonical_id").alias("holder"))
        a = P.attributes(ctx.facts.where("role = 'target'"), P.DESCRIPTORS, True, True).join(c, ["project", "module", "owner"])
        reached = ctx.lookup().join(a, ["project", "holder"])
        return reached.select("project", F.col("owner_id").alias("target_id"), "name", "storage", "annotation", "writable", "lineno", "origin", "descriptor", (F.col("place") > 0).alias("inherited"))

    return ctx.once(("attributes",), make)


def _looked_at() -> Column:
    """Whether a row's rule looks at attributes of that origin."""
    dynamic, data = F.coalesce("p.include_dynamic_attributes", F.lit(False)), F.coalesce("p.interpret_dataclass_fields", F.lit(False))
    return (F.col("origin") == "plain") | ((F.col("origin") == "descriptor") & F.array_contains("p.descriptor_kinds", F.col("descriptor"))) | ((F.col("origin") == "dynamic") & dynamic) | ((F.col("origin") == "dataclass") & data)


def member_absence(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """No member of a name, kind and storage, own or inherited. Methods have no storage, so they count only where any will do."""
    rows = with_params(ctx.matched(rules), f"{SELECTION}, {ORIGINS}, member_kind: string, storage: string")
    kind = F.when(F.col("storage") == "property", "property").otherwise("attribute")
    attributes = class_attributes(ctx).select("project", "target_id", "name", "lineno", "storage", kind.alias("kind_of_member"), "origin", "descriptor", "inherited")
    none = F.lit(None).cast("string")
    methods = ctx.offered().where("not is_property").select("project", F.col("owner_id").alias("target_id"), "name", "lineno", none.alias("storage"), F.lit("method").alias("kind_of_member"), F.lit("plain").alias("origin"), none.alias("descriptor"), "inherited")
    hits = rows.join(attributes.unionByName(methods), ["project", "target_id"]).where(chosen() & _looked_at() & is_any("p.storage", "storage") & is_any("p.member_kind", "kind_of_member"))
    return _by_hits(rows, hits, ["project", "rule_id", "target_id"], "forbidden_member", F.concat(F.col("name"), F.lit(":"), F.col("lineno")))


#: Where the last candidate for an attribute drops out, in order.
_ATTRIBUTE_STEPS = ("missing_attribute", "storage_mismatch", "property_not_allowed", "annotation_mismatch", "not_writable", "ok")


def attribute_contract(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """An attribute with a name, storage, annotation and writability; the reason is the step at which the last one drops out.

    A property counts only where properties are allowed, another descriptor where its kind is named; with allow_missing a
    rule is SKIPPED where there is nothing of the name.
    """
    rows = with_params(ctx.matched(rules), f"{ORIGINS}, name: string, storage: string, annotation: string, require_writable: boolean, declared_only: boolean, allow_property: boolean, allow_missing: boolean")
    rows = rows.withColumn("name", F.col("p.name"))
    stored = F.when(F.col("p.storage") == "any", True).when(F.col("p.storage") == "instance", F.col("storage").isin("instance", "property")).otherwise(F.col("storage") == F.col("p.storage"))
    allowed = F.col("p.allow_property") | (F.col("storage") != "property") | F.col("descriptor").isNotNull()
    typed = F.col("p.annotation").isNull() | F.coalesce(F.col("annotation") == F.col("p.annotation"), F.lit(False))
    writable = ~F.col("p.require_writable") | F.col("writable")
    step = F.when(~stored, 1).when(~allowed, 2).when(~typed, 3).when(~writable, 4).otherwise(5)
    candidates = rows.join(class_attributes(ctx), ["project", "target_id", "name"]).where(_looked_at() & ~(F.col("p.declared_only") & F.col("inherited")))
    out = counted(rows, candidates, F.max(step)).withColumn("reason", F.element_at(F.array(*map(F.lit, _ATTRIBUTE_STEPS)), F.col("n") + 1))
    optional = (F.col("n") == 0) & F.col("p.allow_missing")
    judged = _results(out, F.col("n") == 5, F.when(optional, "optional_attribute_missing").otherwise(F.col("reason")))
    return judged.withColumn("status", F.when(F.col("reason") == "optional_attribute_missing", "SKIPPED").otherwise(F.col("status")))


def _params(entities_: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Parameters with the receiver of methods left out, places counted within positional and keyword-only ones."""
    kept = F.when((F.col("kind") == "method") & (F.coalesce("method_kind", F.lit("instance")) != "static"), F.slice("params", 2, 1000)).otherwise(F.col("params"))
    rows = entities_.select(*keys, F.posexplode(kept).alias("place", "p")).select(*keys, "place", F.col("p.name").alias("name"), F.when(F.col("p.kind") == "kwonly", "kwonly").otherwise("plain").alias("part"), F.col("p.kind").alias("kind"), F.col("p.required").alias("required"), F.regexp_replace("p.annotation", "[\"' ]", "").alias("annotation"))
    return rows.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ("place", "name", "part", "kind", "required", "annotation")])


def compare_parameters(pairs: DataFrame, expected: DataFrame, found: DataFrame, mode: str = "compatible", allow_extra: bool = True, rename: bool = False) -> DataFrame:
    """(pair, error) for pairs (pair, source_id, project, target_id) of callables whose parameters don't stand in for the expected.

    exact: as many, and place by place the same name, kind, need and annotation. compatible: by name, or with rename by place
    within positional and keyword-only ones; optional ones stay optional; extra ones must be allowed and optional.
    """
    e = pairs.join(expected, "source_id").select("pair", *[c for c in expected.columns if c.startswith("e_")])
    f = pairs.join(found, ["project", "target_id"]).select("pair", *[c for c in found.columns if c.startswith("f_")])
    typed = F.when(F.col("e_annotation").isNotNull() & F.col("f_annotation").isNotNull() & (F.col("e_annotation") != F.col("f_annotation")), F.concat(F.lit("annotation of "), "e_name"))
    if mode == "exact":
        e, f = e.withColumnRenamed("pair", "e_pair"), f.withColumnRenamed("pair", "f_pair")
        both = e.join(f, (F.col("e_pair") == F.col("f_pair")) & (F.col("e_place") == F.col("f_place")), "full").select(F.coalesce("e_pair", "f_pair").alias("pair"), "e_name", "f_name", "e_kind", "f_kind", "e_required", "f_required", "e_annotation", "f_annotation")
        counts = both.groupBy("pair").agg(F.count("e_name").alias("n"), F.count("f_name").alias("m")).where("n <> m").select("pair", F.format_string("%d parameters, expected %d", "m", "n").alias("error"))
        checks = F.array(F.when(F.col("e_name") != F.col("f_name"), F.concat(F.lit("name "), "f_name")), F.when(F.col("e_kind") != F.col("f_kind"), F.concat(F.lit("kind of "), "e_name")), F.when(F.col("e_required") != F.col("f_required"), F.concat(F.lit("need of "), "e_name")), F.when(~F.col("e_annotation").eqNullSafe(F.col("f_annotation")), F.concat(F.lit("annotation of "), "e_name")))
        return counts.unionByName(both.join(counts.select("pair"), "pair", "left_anti").select("pair", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("error")))
    if rename:
        from pyspark.sql import Window

        e = e.withColumn("slot", F.row_number().over(Window.partitionBy("pair", "e_part").orderBy("e_place"))).withColumn("key", F.concat("e_part", "slot"))
        f = f.withColumn("slot", F.row_number().over(Window.partitionBy("pair", "f_part").orderBy("f_place"))).withColumn("key", F.concat("f_part", "slot"))
    else:
        e, f = e.withColumn("key", F.col("e_name")), f.withColumn("key", F.col("f_name"))
    both = e.drop("slot").join(f.drop("slot"), ["pair", "key"], "full")
    extra = F.when(F.col("e_name").isNull(), F.when(F.lit(not allow_extra), F.concat(F.lit("extra "), "f_name")).when(F.col("f_required"), F.concat(F.lit("extra required "), "f_name")))
    kinds = F.when((F.col("e_kind") == "kwonly") != (F.col("f_kind") == "kwonly"), F.concat(F.lit("kind of "), "e_name")) if rename else F.when(F.col("e_kind") != F.col("f_kind"), F.concat(F.lit("kind of "), "e_name"))
    checks = F.array(F.when(F.col("f_name").isNull(), F.concat(F.lit("missing "), "e_name")), extra, kinds, F.when(~F.col("e_required") & F.col("f_required"), F.concat(F.lit("optional became required "), "e_name")), typed)
    return both.select("pair", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("error"))


def api_signature(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    def judge(r: Rule) -> DataFrame:
        p = r.params
        rows = ctx.matched([r]).withColumn("pair", F.concat_ws("|", "project", "rule_id", "target_id"))
        e = ctx.reference.withColumnRenamed("canonical_id", "source_id")
        f = ctx.entities.withColumnRenamed("canonical_id", "target_id")
        errors = compare_parameters(rows, _params(e, "e", ["source_id"]), _params(f, "f", ["project", "target_id"]), p["mode"], p["allow_extra_params"], p["allow_param_rename"])
        return _by_hits(rows, errors, ["pair"], "signature_differs", F.col("error"))

    return _one(rules, judge)


def protocol_conformance(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """Every method that the reference's protocol declares is offered with compatible parameters, every attribute is there."""

    def judge(r: Rule) -> DataFrame:
        proto = r.params["protocol"]
        own = ctx.reference.where((F.col("kind") == "method") & (F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1)) == proto))
        need = own.where(~C.is_dunder("name") & ~F.col("is_property")).select(F.col("name"), F.col("canonical_id").alias("source_id"), F.coalesce("method_kind", F.lit("instance")).alias("want_kind"))
        attrs = P.attributes(ctx.facts.where("role = 'source'")).where(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), F.col("owner")) == proto).select("name").distinct()
        rows = ctx.matched([r]).withColumn("pair_rule", F.concat_ws("|", "project", "rule_id", "target_id"))
        offered = ctx.offered().select("project", F.col("owner_id"), "name", F.col("canonical_id").alias("method_id"), F.coalesce("method_kind", F.lit("instance")).alias("kind_found"))
        wanted = rows.select("project", F.col("target_id").alias("owner_id"), "pair_rule").crossJoin(F.broadcast(need))
        have = wanted.join(offered, ["project", "owner_id", "name"], "left")
        missing = have.where("method_id is null").select("pair_rule", F.concat(F.lit("missing method "), "name").alias("error"))
        if r.params["enforce_method_kind"]:
            missing = missing.unionByName(have.where("method_id is not null and kind_found <> want_kind").select("pair_rule", F.concat(F.col("name"), F.lit(": "), F.col("kind_found"), F.lit(" method, not "), F.col("want_kind")).alias("error")))
        pairs = have.where("method_id is not null").select("project", "source_id", F.col("method_id").alias("target_id"), F.concat_ws("#", "pair_rule", "name").alias("pair"))
        e, f = ctx.reference.withColumnRenamed("canonical_id", "source_id"), ctx.entities.withColumnRenamed("canonical_id", "target_id")
        bad = compare_parameters(pairs, _params(e, "e", ["source_id"]), _params(f, "f", ["project", "target_id"]), r.params["mode"]) if r.params["mode"] != "any" else None
        errors = missing if bad is None else missing.unionByName(bad.select(F.substring_index("pair", "#", 1).alias("pair_rule"), F.concat_ws(": ", F.substring_index("pair", "#", -1), "error").alias("error")))
        c = ctx.entities.where("kind = 'class'").select("project", "module", F.col("qualname").alias("owner"), F.col("canonical_id").alias("owner_id"))
        there = P.attributes(ctx.facts.where("role = 'target'")).join(c, ["project", "module", "owner"]).select("project", "owner_id", "name").union(offered.select("project", "owner_id", "name"))
        up = ctx.ancestors().select("project", F.col("start").alias("heir"), F.col("node").alias("owner_id")).join(there, ["project", "owner_id"]).select("project", F.col("heir").alias("owner_id"), "name")
        lost = rows.select("project", F.col("target_id").alias("owner_id"), "pair_rule").crossJoin(F.broadcast(attrs)).join(there.union(up).distinct(), ["project", "owner_id", "name"], "left_anti")
        errors = errors.unionByName(lost.select("pair_rule", F.concat(F.lit("missing attribute "), "name").alias("error")))
        return _by_hits(rows, errors, ["pair_rule"], "protocol_not_met", F.col("error"))

    return _one(rules, judge)


def module_interface(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """Other modules use only the listed names of the matched module, or only public ones if none are listed."""

    def judge(r: Rule) -> DataFrame:
        rows = ctx.matched([r]).join(ctx.entities.where("kind = 'module'").select("project", F.col("canonical_id").alias("target_id"), F.col("module").alias("home")), ["project", "target_id"])
        used = P.uses(ctx.facts.where("role = 'target'"))
        used = used.where(~F.col("in_type_checking")) if r.params["ignore_type_checking"] else used
        spelled = used.select("project", "module", "how", "lineno", F.col("name").alias("dotted"), F.explode(C.prefixes("name")).alias("home"))
        inner = spelled.join(rows.select("project", "home", "target_id"), ["project", "home"]).where("module <> home and dotted <> home").withColumn("name", F.substring_index(F.when(F.col("home") == "", F.col("dotted")).otherwise(F.expr("substring(dotted, length(home) + 2)")), ".", 1))
        deeper = ctx.modules.select("project", F.col("module").alias("below"))
        inner = inner.withColumn("below", F.concat_ws(".", F.when(F.col("home") != "", F.col("home")), "name")).join(deeper, ["project", "below"], "left_anti")
        bad = inner.where(~F.col("name").isin(r.params["names"])) if r.params["names"] else inner.where(C.is_private("name"))
        return _by_hits(rows, bad, ["project", "target_id"], "outside_interface", F.concat(F.col("module"), F.lit(":"), F.col("lineno"), F.lit(" "), F.col("how")))

    return _one(rules, judge)


def private_access(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """No read of a private attribute, but of one that the reader's own class or an ancestor of it declares."""
    reads = P.private_reads(ctx.facts.where("role = 'target'"))
    c = ctx.entities.where("kind = 'class'").select("project", "module", F.col("qualname").alias("owner"), F.col("canonical_id").alias("owner_id"))
    declared = P.attributes(ctx.facts.where("role = 'target'")).select("project", "module", "owner", "name").union(ctx.methods().select("project", "module", "owner", "name")).join(c, ["project", "module", "owner"]).select("project", "owner_id", "name")
    up = ctx.ancestors().select("project", F.col("start").alias("heir"), F.col("node").alias("owner_id")).join(declared, ["project", "owner_id"]).select("project", F.col("heir").alias("owner_id"), "name")
    family = declared.union(up).distinct().join(c, ["project", "owner_id"]).select("project", "module", "owner", "name")
    hits = reads.join(family, ["project", "module", "owner", "name"], "left_anti")

    def judge(r: Rule) -> DataFrame:
        bad = hits.where(~F.col("name").isin(r.params["allow"])) if r.params["allow"] else hits
        return _by_hits(ctx.of_projects([r]), bad, ["project"], "private_read", F.concat(F.col("path"), F.lit(":"), F.col("lineno"), F.lit(" "), F.col("base"), F.lit("."), F.col("name")))

    return _one(rules, judge)


EVALUATORS: dict[str, Callable[[Context, Sequence[Rule]], DataFrame]] = {f.__name__: f for f in (import_policy, module_cycles, module_layers, architecture_static, nominal_type, enum_type, abstract_class, decorated, method_set, member_absence, attribute_contract, api_signature, protocol_conformance, module_interface, private_access)}
PROJECT_WIDE = ("import_policy", "module_cycles", "module_layers", "architecture_static", "private_access")


def register(rule_type: str, evaluator: Callable[[Context, Sequence[Rule]], DataFrame], parameters: dict | None = None) -> None:
    """Add a kind of rule of one's own."""
    EVALUATORS[rule_type] = evaluator
    PARAMETERS[rule_type] = dict(parameters or {})


def evaluate(facts: DataFrame, matches: DataFrame, rules: Sequence[Rule], fail_on_unmatched: bool = False, events: dict[str, DataFrame] | None = None) -> DataFrame:
    """Results of all rules on all projects (columns RESULT).

    A rule whose source isn't matched in a project is SKIPPED there, or FAILED with fail_on_unmatched; one with bad
    parameters is FAILED everywhere. events are tables of what submissions did, for rules that observe.
    """
    ctx = Context(facts, matches, events)
    good, bad = compile_rules(rules)
    parts: list[DataFrame] = []
    for kind in sorted({r.rule_type for r in good}):
        # Written one kind at a time: the union of all would be one plan of hundreds of joins.
        parts.append(ctx.rounds.keep(EVALUATORS[kind](ctx, [r for r in good if r.rule_type == kind]).select(*RESULT)))
    local = [r for r in good if r.rule_type not in PROJECT_WIDE]
    if local:
        open_ = ctx.projects.crossJoin(F.broadcast(ctx.rules(local))).join(ctx.matches.where("status = 'MATCHED'").select("project", "source_id"), ["project", "source_id"], "left_anti")
        if parts:  # some kinds judge a member through its matched class
            open_ = open_.join(reduce(DataFrame.unionByName, parts).select("project", "rule_id").distinct(), ["project", "rule_id"], "left_anti")
        status = ctx.matches.select("project", "source_id", "target_id", F.col("status").alias("match_status"))
        rows = open_.join(status, ["project", "source_id"], "left")
        parts.append(rows.select("project", "rule_id", "rule_type", "source_id", "target_id", F.lit("FAILED" if fail_on_unmatched else "SKIPPED").alias("status"), "severity", F.lit("required_target_missing" if fail_on_unmatched else "match_status").alias("reason"), F.col("match_status").alias("detail")))
    if bad:
        why = ctx.spark.createDataFrame([(r.rule_id, r.rule_type, r.source_id, r.severity, text) for r, text in bad], "rule_id string, rule_type string, source_id string, severity string, detail string")
        parts.append(ctx.projects.crossJoin(F.broadcast(why)).select("project", "rule_id", "rule_type", "source_id", F.lit(None).cast("string").alias("target_id"), F.lit("FAILED").alias("status"), "severity", F.lit("invalid_parameter").alias("reason"), "detail"))
    return reduce(DataFrame.unionByName, parts)
