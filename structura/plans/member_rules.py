"""Rules about members of classes that take more than one selection: sets, required methods, constructors, factories, returns.

They register with structura.plans.rules as further kinds; importing this module makes them known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structura.functions import annotations as A
from structura.functions import columns as C
from structura.plans import rules as R
from structura.sources import python_source as P

MEMBER_KINDS = ("any", "method", "attribute", "property", "constructor")
FACTORY_KINDS = ("constructor", "classmethod", "staticmethod")
_CONSTRUCTORS = ("__init__", "__new__")


def _classes(ctx: R.Context) -> DataFrame:
    return ctx.entities.where("kind = 'class'").select("project", "module", F.col("qualname").alias("owner"), F.col("canonical_id").alias("owner_id"), "decorators")


def _near(ctx: R.Context) -> DataFrame:
    """(project, owner_id, holder, distance): each class with itself (0) and its ancestors in the order in which members are looked up."""
    return ctx.lookup().groupBy("project", "owner_id", "holder").agg(F.min("place").alias("distance"))


def _synthetic(ctx: R.Context) -> DataFrame:
    """(project, owner_id): dataclasses, whose constructor nobody writes."""
    return _classes(ctx).where(F.exists("decorators", lambda d: F.element_at(F.split(d, r"\."), -1) == "dataclass")).select("project", "owner_id")


def members(ctx: R.Context, declared_only: bool = False, dataclass_constructor: bool = True) -> DataFrame:
    """(project, owner_id, name, member_kind, method_kind, storage, inherited): methods, attributes, properties and constructors, each once a class."""

    def make() -> DataFrame:
        none = F.lit(None).cast("string")
        methods = ctx.methods().select("project", F.col("owner_id").alias("holder"), "name", F.when(F.col("name").isin(*_CONSTRUCTORS), "constructor").when(F.col("is_property"), "property").otherwise("method").alias("member_kind"), "method_kind", none.alias("storage"))
        attributes = P.attributes(ctx.facts.where("role = 'target'")).where("storage <> 'property'").join(_classes(ctx), ["project", "module", "owner"])
        attributes = attributes.select("project", F.col("owner_id").alias("holder"), "name", F.lit("attribute").alias("member_kind"), none.alias("method_kind"), "storage")
        made = _synthetic(ctx).select("project", F.col("owner_id").alias("holder"), F.lit("__init__").alias("name"), F.lit("constructor").alias("member_kind"), F.lit("instance").alias("method_kind"), F.lit("dataclass").alias("storage"))
        own = methods.unionByName(attributes).unionByName(made.join(methods.where("name = '__init__'").select("project", "holder"), ["project", "holder"], "left_anti"))
        reached = _near(ctx).join(own, ["project", "holder"])
        first = Window.partitionBy("project", "owner_id", "name").orderBy("distance", "holder", "member_kind", "storage")
        return reached.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("project", "owner_id", "name", "member_kind", "method_kind", "storage", (F.col("distance") > 0).alias("inherited"))

    out = ctx.once(("members",), make)
    out = out if not declared_only else out.where("not inherited")
    return out if dataclass_constructor else out.where("storage is null or storage <> 'dataclass'")


def _selected(p: dict) -> Column:
    return F.col("name").isin(p["names"]) if p["names"] else F.rlike("name", F.lit(f"^(?:{p['pattern']})$")) if p["pattern"] else F.lit(True)


def member_set(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
    """So many members of some kinds, a name, a storage and a method kind."""
    rows = R.with_params(ctx.matched(rules), f"{R.SELECTION}, member_kinds: array<string>, method_kind: string, storage: string, allow_property: boolean, min_count: int, max_count: int")
    own = members(ctx).withColumnRenamed("owner_id", "target_id")
    kinds = F.array_contains("p.member_kinds", F.lit("any")) | F.array_contains("p.member_kinds", F.col("member_kind"))
    fits = [F.col(f"{c}").isNull() | R.is_any(f"p.{c}", c) for c in ("method_kind", "storage")]
    hits = rows.join(own, ["project", "target_id"]).where(R.chosen() & kinds & fits[0] & fits[1] & (F.col("p.allow_property") | (F.col("member_kind") != "property")))
    return R.between(R.counted(rows, hits, F.count("*")), "members")


def _verdict_of_candidates(ctx: R.Context, r: R.Rule, rows: DataFrame, found: DataFrame, missing: str) -> DataFrame:
    """A result a project from its candidates (project, target_id of the class or rule, method_id): exactly one must be compatible.

    rows: matched rules (with source_id of the callable that is required).
    """
    p = r.params
    pairs = rows.select("project", "rule_id", "source_id", F.col("target_id").alias("class_id")).join(found.withColumnRenamed("target_id", "class_id"), ["project", "class_id"])
    pairs = pairs.select("project", "source_id", F.col("method_id").alias("target_id"), F.concat_ws("|", "project", "method_id").alias("pair"), "class_id", "kind_fits")
    pairs = ctx.rounds.keep(pairs)  # read twice, and joined with what comes of it
    e, f = ctx.reference.withColumnRenamed("canonical_id", "source_id"), ctx.entities.withColumnRenamed("canonical_id", "target_id")
    if p["mode"] == "any":
        bad = pairs.select("pair").where("false").withColumn("error", F.lit(""))
    else:
        bad = R.compare_parameters(pairs, R._params(e, "e", ["source_id"]), R._params(f, "f", ["project", "target_id"]), p["mode"])
    errors = bad.groupBy("pair").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"))
    judged = pairs.join(errors, "pair", "left").withColumn("good", F.col("errors").isNull() & F.col("kind_fits"))
    n = judged.groupBy("project", F.col("class_id").alias("target_id")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.min("errors").alias("why"))
    out = rows.join(n, ["project", "target_id"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "good": F.coalesce("good", F.lit(0))})
    reason = F.when(F.col("good") > 1, "multiple_compatible_candidates").when(F.col("n") == 0, missing).otherwise("no_compatible_candidate")
    results = R._results(out, F.col("good") == 1, reason, F.col("why"))
    if p["allow_missing"]:
        gone = F.col("reason") == missing
        results = results.withColumns({"status": F.when(gone, "SKIPPED").otherwise(F.col("status"))})
    return results


def _home_of(ctx: R.Context, rules: Sequence[R.Rule], on_class: bool) -> DataFrame:
    """The rules with the target class that their method's class (or their class itself) is matched with."""
    rows = ctx.rules(rules)
    if on_class:
        return ctx.matched(rules)
    owner = ctx.reference.where("kind = 'method'").select(F.col("canonical_id").alias("source_id"), "module", F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1).alias("owner"))
    home = ctx.reference.where("kind = 'class'").select("module", F.col("qualname").alias("owner"), F.col("canonical_id").alias("class_source"))
    found = ctx.matches.where("status = 'MATCHED'").select("project", F.col("source_id").alias("class_source"), "target_id")
    return rows.join(owner.join(home, ["module", "owner"]).select("source_id", "class_source"), "source_id").join(found, "class_source").drop("class_source")


def required_method(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
    """The counterpart of a method's class has exactly one compatible method among those that the name selects."""

    def judge(r: R.Rule) -> DataFrame:
        p = r.params
        rows = _home_of(ctx, [r], False)
        kind = ctx.reference.where(F.col("canonical_id") == r.source_id).select(F.col("method_kind").alias("want"), F.col("is_async").alias("want_async"))
        offered = ctx.offered(p["declared_only"]).where(_selected(p)).crossJoin(F.broadcast(kind))  # one row
        fits = (F.coalesce("method_kind", F.lit("instance")) == F.coalesce("want", F.lit("instance"))) if p["enforce_method_kind"] else F.lit(True)
        found = offered.select("project", F.col("owner_id").alias("target_id"), F.col("canonical_id").alias("method_id"), (fits & (F.col("is_async") == F.col("want_async"))).alias("kind_fits"))
        return _verdict_of_candidates(ctx, r, rows, found.distinct(), "missing_method")

    return R._one(rules, judge)


def required_constructor(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
    """The counterpart of a class has a constructor that takes what the reference's takes: declared, or inherited if allowed."""

    def judge(r: R.Rule) -> DataFrame:
        p = r.params
        names = list(_CONSTRUCTORS) if p["constructor_kind"] == "auto" else [p["constructor_kind"]]
        ref = ctx.reference.where((F.col("kind") == "method") & F.col("name").isin(names))
        owner = ctx.reference.where(F.col("canonical_id") == r.source_id).select(F.col("canonical_id").alias("class_source"), "module", F.col("qualname").alias("owner"))
        wanted = ref.withColumn("owner", F.regexp_extract("qualname", r"^(.*)\.[^.]*$", 1)).join(owner, ["module", "owner"]).select("class_source", F.col("canonical_id").alias("needed"))
        rows = ctx.matched([r])
        own = ctx.methods().where(F.col("name").isin(names)).select("project", F.col("owner_id").alias("holder"), F.col("canonical_id").alias("method_id"))
        reached = _near(ctx).join(own, ["project", "holder"])
        reached = reached if p["allow_inherited"] else reached.where("distance = 0")
        first = Window.partitionBy("project", "owner_id").orderBy("distance", "holder", "method_id")
        nearest = reached.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("project", F.col("owner_id").alias("target_id"), "method_id")
        both = rows.join(nearest, ["project", "target_id"], "left").join(wanted.withColumnRenamed("class_source", "source_id"), "source_id", "left").join(_synthetic(ctx).select("project", F.col("owner_id").alias("target_id"), F.lit(True).alias("made")), ["project", "target_id"], "left")
        pairs = both.where("method_id is not null and needed is not null").select("project", F.col("needed").alias("source_id"), F.col("method_id").alias("target_id"), F.concat_ws("|", "project", "rule_id").alias("pair"))
        pairs = ctx.rounds.keep(pairs)
        e, f = ctx.reference.withColumnRenamed("canonical_id", "source_id"), ctx.entities.withColumnRenamed("canonical_id", "target_id")
        bad = R.compare_parameters(pairs, R._params(e, "e", ["source_id"]), R._params(f, "f", ["project", "target_id"]), p["mode"]) if p["mode"] != "any" else pairs.select("pair", F.lit("").alias("error")).where("false")
        errors = bad.groupBy("pair").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"))
        out = both.withColumn("pair", F.concat_ws("|", "project", "rule_id")).join(errors, "pair", "left")
        gone = F.col("method_id").isNull() & F.col("made").isNull() & F.col("needed").isNotNull()
        results = R._results(out, F.col("errors").isNull() & ~gone, F.when(gone, "missing_constructor").otherwise("constructor_differs"), F.col("errors"))
        return results.withColumn("status", F.when(F.col("reason") == "missing_constructor", "SKIPPED").otherwise(F.col("status"))) if p["allow_missing"] else results

    return R._one(rules, judge)


def required_factory(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
    """Exactly one constructor, class method or static method of the counterpart makes an instance as the reference's callable does."""

    def judge(r: R.Rule) -> DataFrame:
        p = r.params
        rows = _home_of(ctx, [r], False)
        kind = F.when(F.col("name").isin(*_CONSTRUCTORS), "constructor").when(F.col("method_kind") == "class", "classmethod").when(F.col("method_kind") == "static", "staticmethod")
        offered = ctx.offered(not p["allow_inherited"]).withColumn("how", kind).where(F.col("how").isin(list(p["satisfy_with"])) & ((F.col("how") == "constructor") | _selected(p)))
        own = ctx.entities.where("kind = 'class'").select("project", F.col("canonical_id").alias("owner_id"), F.col("name").alias("made"))
        said = F.regexp_replace(F.coalesce("returns", F.lit("")), "[\"' ]", "")
        fits = (F.col("how") == "constructor") | (said == "") | said.isin("Self", "typing.Self") | (F.substring_index(said, ".", -1) == F.col("made"))
        found = offered.join(own, ["project", "owner_id"]).select("project", F.col("owner_id").alias("target_id"), F.col("canonical_id").alias("method_id"), fits.alias("kind_fits"))
        return _verdict_of_candidates(ctx, r, rows, found.distinct(), "missing_factory")

    return R._one(rules, judge)


def return_annotation(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
    """The matched callable returns the reference's type or one below it; a missing annotation is a difference of its own."""
    want = ctx.reference.select(F.col("canonical_id").alias("source_id"), F.col("returns").alias("expected"))
    have = ctx.entities.select("project", F.col("canonical_id").alias("target_id"), F.col("returns").alias("found"))
    rows = ctx.matched(rules).join(want, "source_id").join(have, ["project", "target_id"])
    names = ctx.entities.where("kind = 'class'").select("project", F.col("canonical_id").alias("id"), "name")
    up = ctx.ancestors().join(names.select("project", F.col("id").alias("start"), F.col("name").alias("a")), ["project", "start"]).join(names.select("project", F.col("id").alias("node"), F.col("name").alias("b")), ["project", "node"])
    family = up.groupBy("project").agg(F.collect_set(F.concat_ws("<", "a", "b")).alias("bases"))  # pairs of one submission's classes

    def check(expected, found, bases):
        import pandas as pd

        return pd.Series([A.fits(a, b, "covariant", {tuple(x.split("<")) for x in (c if c is not None else [])}) for a, b, c in zip(expected, found, bases)])

    rows = rows.join(family, "project", "left").withColumn("fits", F.pandas_udf(check, "boolean")("expected", "found", F.coalesce("bases", F.array().cast("array<string>"))))
    return R._results(rows, F.col("fits"), F.when(F.col("found").isNull(), "return_annotation_missing").otherwise("return_annotation_differs"), F.concat_ws(" / ", "expected", "found"))


def invalid_parameter(ctx: R.Context, rules: Sequence[R.Rule]) -> DataFrame:
    """Markers that couldn't be read fail on every project."""
    return R._results(ctx.of_projects(rules), F.lit(False), F.lit("invalid_parameter"), F.get_json_object("params", "$.issues"))


_SELECTION = {"names": [], "pattern": ""}
R.CHOICES["constructor_kind"] = ("auto", *_CONSTRUCTORS)
R.register("member_set", member_set, _SELECTION | {"member_kinds": ["any"], "declared_only": False, "method_kind": "any", "storage": "any", "allow_property": True, "min_count": 1, "max_count": None})
R.register("required_method", required_method, _SELECTION | {"mode": "compatible", "enforce_method_kind": True, "allow_missing": False, "declared_only": False})
R.register("required_constructor", required_constructor, {"mode": "compatible", "constructor_kind": "auto", "allow_inherited": True, "allow_missing": False})
R.register("required_factory", required_factory, _SELECTION | {"mode": "compatible", "satisfy_with": list(FACTORY_KINDS), "allow_inherited": True, "allow_missing": False})
R.register("return_annotation", return_annotation, {})
R.register("compiler_invalid_param", invalid_parameter, {"issues": []})
R.PROJECT_WIDE = (*R.PROJECT_WIDE, "compiler_invalid_param")
