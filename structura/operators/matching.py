"""Pairing a reference's entities with those of many targets.

Sources are entities of the one reference, targets those of every project. Candidates come from equality joins on blocks
(kind and signature, or kind and name), are scored by columns, and ranked by windows. What depends on the order of its own
decisions, giving taken targets' losers and unmatched names another one, runs per project.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import selection


@dataclass(frozen=True)
class Config:
    threshold: float = 0.80
    delta: float = 0.03
    min_candidate: float = 0.50
    top_n: int = 5
    max_fuzzy: int = 5
    stage2_cap: int = 0
    stage3_cap: int = 0
    name_fallback: bool = True


@dataclass(frozen=True)
class Similarities:
    """How alike two entities are, each a function of two columns that gives one from 0 to 1: of their bags, modules, names and documentation.

    Any of them can be exchanged; scores stay expressions, so a likeness of one's own is planned like those here.
    """

    structure: Callable[[str, str], Column] = C.bag_jaccard
    module: Callable[[str, str], Column] = C.module_similarity
    name: Callable[[str, str], Column] = C.name_similarity
    documentation: Callable[[str, str], Column] = lambda a, b: C.set_jaccard(C.word_set(a), C.word_set(b))


_SIDE = ["canonical_id", "kind", "module", "qualname", "name", "signature_key", "bag", "docstring"]


def _rank() -> list:
    return [F.desc("confidence"), F.desc("mod"), "distance", "target_id"]

SCHEMA = "project string, source_id string, target_id string, status string, confidence double, stage string"


def _sides(sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in _SIDE])
    t = targets.select("project", *[F.col(c).alias(f"t_{c}") for c in _SIDE])
    return s, t


def _features(pairs: DataFrame, alike: Similarities) -> DataFrame:
    return pairs.withColumns(
        {"ast": alike.structure("s_bag", "t_bag"), "mod": alike.module("s_module", "t_module"), "distance": C.module_distance("s_module", "t_module"), "same": F.col("s_name") == F.col("t_name"), "source_id": F.col("s_canonical_id"), "target_id": F.col("t_canonical_id")}
    )


def _capped(pairs: DataFrame, cap: int) -> DataFrame:
    return selection.top_k(pairs, ["project", "source_id"], [F.desc("same"), "distance", "target_id"], cap).drop("rank") if cap > 0 else pairs


def exact_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(project, source_id, target_id) where module, name, kind and signature agree with exactly one target."""
    s, t = _sides(sources, targets)
    hit = s.join(t, (F.col("s_module") == F.col("t_module")) & (F.col("s_qualname") == F.col("t_qualname")) & (F.col("s_kind") == F.col("t_kind")) & (F.col("s_signature_key") == F.col("t_signature_key")))
    one = hit.groupBy("project", F.col("s_canonical_id").alias("source_id")).agg(F.count("*").alias("n"), F.min("t_canonical_id").alias("target_id"))
    return one.where("n = 1").drop("n")


def explicit_pairs(sources: DataFrame, targets: DataFrame, explicit: DataFrame) -> DataFrame:
    """As exact_pairs, for sources whose target is named: explicit (source_id, module, qualname, kind, signature_key)."""
    t = targets.select("project", "module", "qualname", "kind", "signature_key", F.col("canonical_id").alias("target_id"))
    one = explicit.join(t, ["module", "qualname", "kind", "signature_key"]).groupBy("project", "source_id").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))
    return one.where("n = 1").drop("n").join(sources.select(F.col("canonical_id").alias("source_id")), "source_id", "left_semi")


def structural_candidates(sources: DataFrame, targets: DataFrame, cap: int = 0, alike: Similarities = Similarities()) -> DataFrame:
    """Targets of the same kind and signature, or kind and name for entities without one, by structure and module."""
    s, t = _sides(sources, targets)
    by_signature = s.where("s_signature_key <> '-'").join(t, (F.col("s_kind") == F.col("t_kind")) & (F.col("s_signature_key") == F.col("t_signature_key")))
    by_name = s.where("s_signature_key = '-'").join(t, (F.col("s_kind") == F.col("t_kind")) & (F.col("s_name") == F.col("t_name")))
    scored = _features(by_signature.unionByName(by_name), alike).withColumn("confidence", F.round(0.70 * F.col("ast") + 0.30 * F.col("mod"), 6))
    return _capped(scored, cap)


def fuzzy_candidates(sources: DataFrame, targets: DataFrame, seeds: DataFrame, cap: int = 0, alike: Similarities = Similarities()) -> DataFrame:
    """Seeds and all targets of the same kind and name, by structure, name and documentation, less penalties."""
    s, t = _sides(sources, targets)
    named = s.join(t, (F.col("s_kind") == F.col("t_kind")) & (F.col("s_name") == F.col("t_name"))).select("project", F.col("s_canonical_id").alias("source_id"), F.col("t_canonical_id").alias("target_id"))
    ids = named.unionByName(seeds.select("project", "source_id", "target_id")).distinct()
    s, t = s.withColumn("source_id", F.col("s_canonical_id")), t.withColumn("target_id", F.col("t_canonical_id"))
    pairs = _features(ids.join(s, "source_id").join(t, ["project", "target_id"]), alike)
    pairs = _capped(pairs, cap)
    s_class, t_class = C.class_of("s_qualname"), C.class_of("t_qualname")
    method = F.col("s_kind") == "method"
    penalty = (
        F.when(F.col("mod") < 0.30, 0.10).otherwise(0.0) + F.when(method & (s_class != "") & (t_class != "") & (s_class != t_class), 0.05).otherwise(0.0)
        + F.when(method & (F.col("t_kind") == "method") & C.first_parameter_differs("s_signature_key", "t_signature_key"), 0.03).otherwise(0.0)
    )
    both_documented = (F.col("s_docstring") != "") & (F.col("t_docstring") != "")
    doc = F.when(both_documented, alike.documentation("s_docstring", "t_docstring")).otherwise(0.0)
    structural = F.round(0.70 * F.col("ast") + 0.30 * F.col("mod"), 6)
    score = F.round(0.55 * structural + 0.30 * alike.name("s_name", "t_name") + 0.15 * doc - penalty, 6)
    return pairs.withColumn("confidence", F.greatest(score, F.lit(0.0)))


def candidates(sources: DataFrame, targets: DataFrame, config: Config = Config(), done: DataFrame | None = None, alike: Similarities = Similarities()) -> DataFrame:
    """(project, source_id, target_id, confidence, mod, distance, name_score, stage) of the pairs not in done.

    A source whose best structural candidate is poor, or has rivals it can't be told from, is ranked by the fuzzy score.
    """
    projects = targets.select("project").distinct()
    second = structural_candidates(sources, targets, config.stage2_cap, alike)
    if done is not None:
        second = second.join(done.select("project", "source_id").distinct(), ["project", "source_id"], "left_anti")
    top = selection.top_k(second, ["project", "source_id"], _rank(), max(config.max_fuzzy, config.top_n, 2))
    per = second.groupBy("project", "source_id").agg(F.count("*").alias("n")).join(top.groupBy("project", "source_id").agg(F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("next")), ["project", "source_id"])
    everyone = sources.select(F.col("canonical_id").alias("source_id")).crossJoin(projects)  # one reference for each project: that is what is asked for
    if done is not None:
        everyone = everyone.join(done.select("project", "source_id").distinct(), ["project", "source_id"], "left_anti")
    state = everyone.join(per, ["project", "source_id"], "left")
    rival = (F.col("best") >= config.threshold) & F.coalesce(F.col("next") >= F.col("best") - config.delta, F.lit(False)) & (F.col("n") <= config.max_fuzzy)
    fuzzy = state.where((F.coalesce("best", F.lit(0.0)) < config.min_candidate) | rival).select("project", "source_id")
    seeds = top.where(F.col("rank") <= config.max_fuzzy).join(fuzzy, ["project", "source_id"], "left_semi")
    third = fuzzy_candidates(sources, targets, seeds, config.stage3_cap, alike).join(fuzzy, ["project", "source_id"], "left_semi")
    if done is not None:
        third = third.join(done.select("project", "source_id").distinct(), ["project", "source_id"], "left_anti")
    columns = ["project", "source_id", "target_id", "confidence", "mod", "distance", alike.name("s_name", "t_name").alias("name_score")]
    third = third.select(*columns, F.lit("fuzzy").alias("stage"))
    other = second.join(third.select("project", "source_id").distinct(), ["project", "source_id"], "left_anti").select(*columns, F.lit("structural").alias("stage"))
    return selection.top_k(other.unionByName(third), ["project", "source_id"], _rank(), max(config.top_n, 2))


def required_names(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Of pairs (project, source_id, target_id) those whose qualified names agree: for rules that a renamed entity can't meet."""
    s = sources.select(F.col("canonical_id").alias("source_id"), F.col("qualname").alias("_s"))
    t = targets.select("project", F.col("canonical_id").alias("target_id"), F.col("qualname").alias("_t"))
    return pairs.join(s, "source_id").join(t, ["project", "target_id"]).where("_s = _t").select(*pairs.columns)


def match(sources: DataFrame, targets: DataFrame, config: Config = Config(), mapping: DataFrame | None = None, explicit: DataFrame | None = None, same_names: bool = False, alike: Similarities = Similarities()) -> DataFrame:
    """A row for each project and source: (project, source_id, target_id, status, confidence, stage).

    explicit names targets of some sources, which go before all stages; with same_names only equal qualified names are candidates.
    """
    exact = exact_pairs(sources, targets).withColumn("stage", F.lit("exact"))
    if explicit is not None:
        named = explicit_pairs(sources, targets, explicit).withColumn("stage", F.lit("explicit"))
        exact = named.unionByName(exact.join(named, ["project", "source_id"], "left_anti").join(named, ["project", "target_id"], "left_anti"))
    found = candidates(sources, targets, config, exact, alike)
    if same_names:
        found = required_names(found, sources, targets)
        found = selection.top_k(found.drop("rank"), ["project", "source_id"], _rank(), max(config.top_n, 2))
    best, then = F.max(F.when(F.col("rank") == 1, F.col("confidence"))), F.max(F.when(F.col("rank") == 2, F.col("confidence")))
    scored = found.groupBy("project", "source_id").agg(F.max(F.when(F.col("rank") == 1, F.col("target_id"))).alias("target_id"), best.alias("confidence"), then.alias("second"), F.first("stage").alias("stage"))
    status = selection.match_status(F.col("confidence"), F.col("second"), config.threshold, config.delta, config.min_candidate)
    scored = scored.select("project", "source_id", "target_id", status.alias("status"), "confidence", "stage")
    sure = exact.select("project", "source_id", "target_id", F.lit("MATCHED").alias("status"), F.lit(1.0).alias("confidence"), "stage")
    everyone = sources.select(F.col("canonical_id").alias("source_id")).crossJoin(targets.select("project").distinct())
    rows = everyone.join(sure.unionByName(scored), ["project", "source_id"], "left").select("project", "source_id", "target_id", F.coalesce("status", F.lit("UNMATCHED")).alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "stage")
    return settle(rows, found, sources, targets, config, mapping)


def settle(rows: DataFrame, found: DataFrame, sources: DataFrame, targets: DataFrame, config: Config = Config(), mapping: DataFrame | None = None) -> DataFrame:
    """One target for one source, then a mapping's pairs, then pairs by unique name and by paired class, per project."""
    ranked = found.groupBy("project", "source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id", "confidence", "name_score"))), lambda c: F.struct(c["target_id"].alias("t"), c["confidence"].alias("c"), c["name_score"].alias("n"))).alias("candidates"))
    slim = ["canonical_id", "kind", "module", "qualname", "name", "signature_key", "lineno", "path"]
    match_rows = rows.join(ranked, ["project", "source_id"], "left").select("project", F.to_json(F.struct("source_id", "target_id", "status", "confidence", "stage", "candidates")).alias("row"), F.lit("match").alias("what"))
    target_rows = targets.select("project", F.to_json(F.struct(*slim)).alias("row"), F.lit("target").alias("what"))
    everything = match_rows.unionByName(target_rows)
    if mapping is not None:
        own = mapping.withColumnRenamed("target", "m")
        projects = targets.select("project").distinct()
        pairs = projects.join(own, (F.col("m") == "*") | (F.col("m") == F.col("project"))).withColumn("w", (F.col("m") != "*").cast("int"))
        pairs = selection.top_k(pairs, ["project", "reference"], [F.desc("w"), "to"], 1)
        everything = everything.unionByName(pairs.select("project", F.to_json(F.struct("reference", "to")).alias("row"), F.lit("pair").alias("what")))
    reference = [r.asDict() for r in sources.select(*slim).collect()]  # one reference, whatever the number of targets

    def settle_project(key, pdf):
        import pandas as pd

        from structura.operators.assignment import settle_rows

        return pd.DataFrame([{"project": key[0]} | r for r in settle_rows(pdf["what"].tolist(), pdf["row"].tolist(), reference, config)], columns=["project", "source_id", "target_id", "status", "confidence", "stage"])

    return everything.groupBy("project").applyInPandas(settle_project, SCHEMA)


def claims(found: DataFrame) -> DataFrame:
    """(project, target_id, source_id): of unpaired sources whose best candidate a target is, the best; ties to the larger identifier."""
    order = Window.partitionBy("project", "target_id").orderBy(F.desc("confidence"), F.desc("source_id"))
    return found.where("rank = 1").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("project", "target_id", "source_id")
