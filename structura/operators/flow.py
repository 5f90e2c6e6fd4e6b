"""Whether every path through a graph meets stages in order: a search over (node, progress), for all functions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.plans.scratch import Rounds


def stage_paths(edges: DataFrame, stages_at: DataFrame, starts: DataFrame, stages: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, node, progress, reason): where paths from the starts break the order of stages, or end before the last one.

    edges: by, node, next; stages_at: by, node, stage (nodes without one are missing); starts: by, node. progress counts the
    stages met so far, in order; meeting one before those that precede it is `out_of_order`, and such a path is followed no
    further; meeting one again changes nothing. A node without edges is an exit, and reaching it early is `stage_missing`.
    The frontier only holds states that are new, so loops end.
    """
    by = list(by)
    wanted = F.array(*[F.lit(s) for s in stages])
    rounds = Rounds(edges.sparkSession, "flow")
    at = stages_at.where(F.col("stage").isin(list(stages))).select(*by, "node", (F.array_position(wanted, F.col("stage")) - 1).cast("int").alias("ordinal"))
    # Every node with its stage and where it leads, once; the search joins nothing else.
    nodes = edges.select(*by, "node").union(edges.select(*by, F.col("next"))).union(starts.select(*by, "node")).distinct()
    nodes = nodes.join(edges.groupBy(*by, "node").agg(F.collect_set("next").alias("next")), [*by, "node"], "left").join(at, [*by, "node"], "left")
    nodes = rounds.keep(nodes)

    def arrive(states: DataFrame) -> DataFrame:
        """States (by, node, progress) after the node's own stage."""
        early = F.col("ordinal") > F.col("progress")
        here = states.join(nodes, [*by, "node"])
        return here.select(*by, "node", "next", F.when(F.col("ordinal") == F.col("progress"), F.col("progress") + 1).otherwise(F.col("progress")).alias("progress"), F.coalesce(early, F.lit(False)).alias("bad"))

    frontier = rounds.keep(arrive(starts.select(*by, "node").distinct().withColumn("progress", F.lit(0))))
    seen = [frontier]
    while True:
        on = frontier.where("not bad and next is not null").select(*by, F.explode("next").alias("node"), "progress").distinct()
        after = arrive(on)
        for old in seen:
            after = after.join(old.select(*by, "node", "progress", "bad"), [*by, "node", "progress", "bad"], "left_anti")
        frontier = rounds.keep(after.dropDuplicates([*by, "node", "progress", "bad"]))
        if frontier.isEmpty():
            break
        seen.append(frontier)
        if len(seen) > 8:  # one table again, before the anti-joins grow
            whole = seen[0]
            for s in seen[1:]:
                whole = whole.unionByName(s)
            seen = [rounds.keep(whole)]
    whole = seen[0]
    for s in seen[1:]:
        whole = whole.unionByName(s)
    ended = F.col("next").isNull() & (F.col("progress") < len(stages))
    reason = F.when(F.col("bad"), "out_of_order").when(ended, "stage_missing")
    return whole.withColumn("reason", reason).where("reason is not null").select(*by, "node", "progress", "reason").distinct()


def variable_flow(cfg: DataFrame, stages: Sequence[str], variable: str | None = None) -> DataFrame:
    """(project, module, qualname, node, progress, reason) of functions that mark stages; paths that raise aren't exits."""
    by = ["project", "module", "qualname"]
    marked = cfg.where(F.col("stage").isNotNull() & (F.lit(variable is None) | (F.col("variable") == F.lit(variable))))
    own = cfg.join(marked.select(*by).distinct(), by, "left_semi")
    edges = own.select(*by, "node", F.explode("next").alias("next")).where("next <> -2")
    starts = own.where("node = 0").select(*by, "node")
    raised = own.where(F.array_contains("next", -2) & (F.size("next") == 1)).select(*by, "node")
    found = stage_paths(edges, marked.select(*by, "node", "stage"), starts, stages, by)
    return found.join(raised, [*by, "node"], "left_anti")
