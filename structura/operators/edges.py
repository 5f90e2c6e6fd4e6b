"""Comparing sets of edges: a target's with a reference's under a policy, and what reports show of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators.graph import longest_prefix, reachable
from structura.plans.scratch import Rounds

POLICIES = ("strict", "allow_new_modules", "layered")
Exceptions = Sequence[tuple[str, str]]
#: From the least to the most pressing.
KINDS = ("convergent", "allowed", "absent", "undecided", "divergent")


def fold_new_modules(edges: DataFrame, known: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Contract every module outside known (by, module) into its users: (folded edges, dropped edges).

    Folded edges join known modules that a path through unknown ones connects; edges of unknown modules that no known one
    reaches are dropped and come back separately. `cause`, if there is one, is the last step's; the least of several.
    """
    by = list(by)
    rounds = Rounds(edges.sparkSession, "fold")
    if "cause" not in edges.columns:
        edges = edges.withColumn("cause", F.lit(None).cast("string"))
    mark = known.select(*by, "module").distinct()
    own = edges.select(*by, "origin", "end", "cause")
    own = own.join(mark.select(*by, F.col("module").alias("origin"), F.lit(True).alias("from_known")), [*by, "origin"], "left")
    own = rounds.keep(own.join(mark.select(*by, F.col("module").alias("end"), F.lit(True).alias("to_known")), [*by, "end"], "left").fillna(False, ["from_known", "to_known"]))
    done = own.where("from_known and to_known").select(*by, "origin", "end", "cause")
    frontier = rounds.keep(own.where("from_known and not to_known").select(*by, "origin", F.col("end").alias("via")).distinct())
    seen = frontier
    inner = own.where("not from_known").select(*by, F.col("origin").alias("via"), "end", "cause", "to_known")
    while not frontier.isEmpty():
        step = rounds.keep(frontier.join(inner, [*by, "via"]))
        done = done.unionByName(step.where("to_known").select(*by, "origin", "end", "cause"))
        after = step.where("not to_known").select(*by, "origin", F.col("end").alias("via")).distinct()
        frontier = rounds.keep(after.join(seen, [*by, "origin", "via"], "left_anti"))
        seen = rounds.keep(seen.unionByName(frontier))
    folded = done.where("origin <> end").groupBy(*by, "origin", "end").agg(F.min("cause").alias("cause"))
    dropped = own.where("not from_known").join(seen.select(*by, F.col("via").alias("origin")).distinct(), [*by, "origin"], "left_anti").select(*by, "origin", "end", "cause")
    return folded, dropped


def compare_edges(
    reference: DataFrame, target: DataFrame, policy: str = "strict", known: DataFrame | None = None, allow: Exceptions = (), forbid: Exceptions = (), permitted: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by, origin, end, kind) of every edge of either side.

    An edge of the target is divergent if forbidden, allowed if excepted, convergent if the reference has or permits it;
    under `layered` it is undecided if its origin isn't reached from its end in what is accepted; else divergent. What only
    the reference has is absent. Unless strict, modules outside known fold into their users first, and edges that can't are
    undecided. `by` columns that the reference lacks (one model, many targets) make it serve every group of the target.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")
    by = list(by)
    groups = target.select(*by).distinct() if by else None
    model = reference.select(*[c for c in by if c in reference.columns], "origin", "end").distinct()
    missing = [c for c in by if c not in reference.columns]
    if missing:
        model = model.crossJoin(F.broadcast(groups)) if len(missing) == len(by) else model.join(groups, [c for c in by if c not in missing])
    own, dropped = target.select(*by, "origin", "end").distinct(), None
    if policy != "strict":
        own, dropped = fold_new_modules(own, known if known is not None else model.select(*by, F.col("origin").alias("module")).union(model.select(*by, "end")), by)
        own, dropped = own.select(*by, "origin", "end"), dropped.select(*by, "origin", "end")
    more = permitted.select(*by, "origin", "end").distinct() if permitted is not None else model.where("false")
    both = own.withColumn("here", F.lit(True)).join(model.withColumn("there", F.lit(True)), [*by, "origin", "end"], "full").join(more.withColumn("may", F.lit(True)), [*by, "origin", "end"], "left")
    kind = F.when(F.col("here").isNull(), F.lit("absent")).when(C.covered("origin", "end", list(forbid)), F.lit("divergent")).when(C.covered("origin", "end", list(allow)), F.lit("allowed")).when(F.col("there") | F.col("may"), F.lit("convergent"))
    if policy == "layered":
        accepted = model.unionByName(more).distinct()
        back = reachable(accepted, own.select(*by, F.col("end").alias("start")), by, include_start=True).select(*by, F.col("start").alias("end"), F.col("node").alias("origin"), F.lit(True).alias("back"))
        both = both.join(back, [*by, "origin", "end"], "left")
        kind = kind.when(F.col("back").isNull(), F.lit("undecided"))
    out = both.select(*by, "origin", "end", kind.otherwise(F.lit("divergent")).alias("kind"))
    return out if dropped is None else out.unionByName(dropped.distinct().withColumn("kind", F.lit("undecided")))


def compare_packages(reference: DataFrame, target: DataFrame, ignore: Sequence[str] = (), allow: Exceptions = (), forbid: Exceptions = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, origin, end, kind) of the libraries (end) that a target's modules use; the reference's (package) may be used anywhere.

    Forbidden ones diverge even if ignored; ignored ones go; nothing is absent.
    """
    used = reference.select(F.col("package").alias("end"), F.lit(True).alias("used")).distinct()
    rows = target.select(*by, "origin", "end").distinct().join(used, "end", "left")
    ban = C.covered("origin", "end", list(forbid))
    kept = rows.where(ban | ~F.col("end").isin(list(ignore))) if ignore else rows
    kind = F.when(ban, "divergent").when(C.covered("origin", "end", list(allow)), "allowed").when(F.col("used"), "convergent").otherwise("divergent")
    return kept.select(*by, "origin", "end", kind.alias("kind"))


def compare_instances(
    reference: DataFrame, target: DataFrame, reference_calls: DataFrame, modules: DataFrame, policy: str = "strict", allow: Exceptions = (), forbid: Exceptions = (), by: Sequence[str] = ()
) -> DataFrame:
    """(by, origin, end, kind) of who creates which class (`module.Class`); exceptions name the class or its module."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")
    by = list(by)
    placed = longest_prefix(target.select(F.col("end").alias("name")).distinct(), modules.select("module"))
    home = F.coalesce(F.when(F.col("module") != F.col("name"), F.col("module")), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1))
    own = target.select(*by, "origin", "end").distinct().join(placed.select(F.col("name").alias("end"), home.alias("home")), "end")
    model = reference.select("origin", "end").distinct().withColumn("there", F.lit(True))
    both = own.join(model, ["origin", "end"], "full")
    exact = lambda pairs: F.coalesce(F.concat_ws(" -> ", "origin", "end").isin([f"{a} -> {b}" for a, b in pairs]), F.lit(False)) if pairs else F.lit(False)
    kind = F.when(F.col("home").isNull(), "absent").when(exact(forbid) | C.covered("origin", "home", list(forbid)), "divergent").when(exact(allow) | C.covered("origin", "home", list(allow)), "allowed").when(F.col("there"), "convergent")
    if policy == "layered":
        back = reachable(reference_calls, own.select(F.col("home").alias("start")), include_start=True).select(F.col("start").alias("home"), F.col("node").alias("origin"), F.lit(True).alias("back"))
        both = both.join(back, ["home", "origin"], "left")
        kind = kind.when(F.col("back").isNull(), "undecided")
    return both.select(*by, "origin", "end", kind.otherwise("divergent").alias("kind"))


def rename_edges(edges: DataFrame, names: DataFrame, by: Sequence[str] = (), ends: bool = True) -> DataFrame:
    """Both ends (or only origins) by names (by, name, new_name); edges that become loops go, the least cause stays."""
    by = list(by)
    has = "cause" in edges.columns
    out = edges if has else edges.withColumn("cause", F.lit(None).cast("string"))
    for side in ("origin", "end") if ends else ("origin",):
        own = names.select(*by, F.col("name").alias(side), F.col("new_name").alias("_new"))
        out = out.join(own, [*by, side], "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
    out = out.where("origin <> end").groupBy(*by, "origin", "end").agg(F.min("cause").alias("cause"))
    return out if has else out.drop("cause")


def fan_metrics(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, module, fan_in, fan_out, instability): distinct users and uses, loops left out; null instability if isolated."""
    own = edges.where("origin <> end").select(*by, "origin", "end").distinct()
    sides = own.select(*by, F.col("origin").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(own.select(*by, F.col("end").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = sides.groupBy(*by, "module").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return n.withColumn("instability", F.try_divide(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")))


def shared_edges(diffs: DataFrame, target: str = "target", rule: Sequence[str] = ("rule",)) -> DataFrame:
    """(rule, kind, origin, end, targets, of, share): how many targets that carry the rule share an edge of a kind."""
    rule = list(rule)
    of = diffs.groupBy(*rule).agg(F.countDistinct(target).alias("of"))
    n = diffs.groupBy(*rule, "kind", "origin", "end").agg(F.countDistinct(target).alias("targets"))
    return n.join(of, rule).withColumn("share", F.col("targets") / F.col("of"))


def dependency_matrix(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, origin, end, kind): of several findings on a cell, the kind that most needs a reader."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return diffs.groupBy(*by, "origin", "end").agg(F.max_by("kind", rank).alias("kind"))


def static_runtime(static: DataFrame, runtime: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, origin, end, seen): `static_only`, `runtime_only` or `both`."""
    a, b = (x.select(*by, "origin", "end").distinct().withColumn(c, F.lit(True)) for x, c in ((static, "s"), (runtime, "r")))
    seen = F.when(F.col("s") & F.col("r"), "both").when(F.col("s"), "static_only").otherwise("runtime_only")
    return a.join(b, [*by, "origin", "end"], "full").select(*by, "origin", "end", seen.alias("seen"))


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
