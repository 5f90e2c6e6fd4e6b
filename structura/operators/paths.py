"""How many import paths lead to forbidden names, without listing them, and a shortest one for each pair of ends.

A path has no node twice, so one that leaves a strongly connected component never comes back. What can't lie on a path goes
first (pruned from both ends). Within a component the ways from where it is entered to where it is left are searched; between
components counts are only added and multiplied, one round for each step of the condensed graph, however many paths there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import graph
from structura.plans.scratch import Rounds

COUNT = "decimal(38,0)"


def _pruned(edges: DataFrame, roots: DataFrame, forbidden: Sequence[str], allowed: Sequence[str], internal: DataFrame | None, by: list[str], rounds: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, inner edges, last edges with their prefix) that lie on a way from a root to a forbidden name."""
    own = edges.select(*by, "origin", "end").where("origin is not null and end is not null and origin <> end").distinct()
    own = own.withColumn("prefix", C.first_prefix("end", list(forbidden)))
    if allowed:
        own = own.where(C.first_prefix("end", list(allowed)).isNull())
    last = rounds.keep(own.where("prefix is not null"))
    inner = own.where("prefix is null").drop("prefix")
    if internal is not None:
        inner = inner.join(internal.select(*by, F.col("module").alias("end")).distinct(), [*by, "end"], "left_semi")
    inner = rounds.keep(inner)
    begin = rounds.keep(roots.select(*by, "start").where("start is not null").distinct())

    def spread(nodes: DataFrame, name: str, a: str, b: str) -> DataFrame:
        new = rounds.append(name, nodes.distinct())
        step = inner.select(*by, F.col(a).alias("node"), F.col(b).alias("_next"))
        while not new.isEmpty():
            new = rounds.append(name, new.join(step, [*by, "node"]).select(*by, F.col("_next").alias("node")).distinct().join(rounds.all(name), [*by, "node"], "left_anti"))
        return rounds.all(name)

    ahead = spread(begin.select(*by, F.col("start").alias("node")), "ahead", "origin", "end")
    back = spread(last.select(*by, F.col("origin").alias("node")), "back", "end", "origin")
    live = rounds.keep(ahead.join(back, [*by, "node"], "left_semi"))
    at = lambda c: live.withColumnRenamed("node", c)
    return begin.join(at("start"), [*by, "start"], "left_semi"), rounds.keep(inner.join(at("origin"), [*by, "origin"], "left_semi").join(at("end"), [*by, "end"], "left_semi")), last.join(at("origin"), [*by, "origin"], "left_semi")


def _ways(inside: DataFrame, entries: DataFrame, by: list[str], rounds: Rounds) -> DataFrame:
    """(by, entry, exit, ways): paths without repeated nodes within components, that of no step included. entries (by, node)."""
    frontier = entries.select(*by, F.col("node").alias("entry"), "node", F.array("node").alias("path"))
    rounds.append("ways", frontier.select(*by, "entry", F.col("node").alias("exit"), F.lit(1).cast(COUNT).alias("ways")))
    step = inside.select(*by, F.col("origin").alias("node"), "end")
    while True:
        frontier = rounds.keep(frontier.join(step, [*by, "node"]).where(~F.array_contains("path", F.col("end"))).select(*by, "entry", F.col("end").alias("node"), F.concat("path", F.array("end")).alias("path")))
        if frontier.isEmpty():
            return rounds.all("ways")
        rounds.append("ways", frontier.groupBy(*by, "entry", F.col("node").alias("exit")).agg(F.count("*").cast(COUNT).alias("ways")))


def path_counts(edges: DataFrame, roots: DataFrame, forbidden: Sequence[str], allowed: Sequence[str] = (), internal: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, start, target, prefix, paths): the number of paths without repeated nodes from each root (by, start) to each forbidden name.

    As graph.simple_paths lists them: a path ends at the first forbidden name and enters neither allowed names nor ones that
    aren't internal (by, module). Only the search within components can grow faster than the graph.
    """
    by = list(by)
    rounds = Rounds(edges.sparkSession, "counts")
    begin, inner, last = _pruned(edges, roots, forbidden, allowed, internal, by, rounds)
    component = rounds.keep(graph.strongly_connected(inner, by).select(*by, "node", "component"))
    placed = inner
    for c in ("origin", "end"):
        placed = placed.join(component.select(*by, F.col("node").alias(c), F.col("component").alias(f"_{c}")), [*by, c], "left")
    placed = rounds.keep(placed)
    same = F.coalesce(F.col("_origin") == F.col("_end"), F.lit(False))
    inside, between = placed.where(same).select(*by, "origin", "end"), placed.where(~same).select(*by, "origin", "end")
    entries = begin.select(*by, F.col("start").alias("node")).union(between.select(*by, "end")).distinct()
    ways = rounds.keep(_ways(inside, rounds.keep(entries), by, rounds).groupBy(*by, "entry", "exit").agg(F.sum("ways").cast(COUNT).alias("ways")))
    frontier = begin.select(*by, "start", F.col("start").alias("entry"), F.lit(1).cast(COUNT).alias("n"))
    while True:
        left = rounds.keep(frontier.join(ways, [*by, "entry"]).groupBy(*by, "start", "exit").agg(F.sum((F.col("n") * F.col("ways")).cast(COUNT)).cast(COUNT).alias("n")))
        rounds.append("ended", left.join(last.select(*by, F.col("origin").alias("exit"), F.col("end").alias("target"), "prefix"), [*by, "exit"]).groupBy(*by, "start", "target", "prefix").agg(F.sum("n").cast(COUNT).alias("n")))
        frontier = rounds.keep(left.join(between.select(*by, F.col("origin").alias("exit"), F.col("end").alias("entry")), [*by, "exit"]).groupBy(*by, "start", "entry").agg(F.sum("n").cast(COUNT).alias("n")))
        if frontier.isEmpty():
            return rounds.all("ended").groupBy(*by, "start", "target", "prefix").agg(F.sum("n").cast(COUNT).alias("paths"))


def shortest_paths(edges: DataFrame, roots: DataFrame, forbidden: Sequence[str], allowed: Sequence[str] = (), internal: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, start, target, prefix, path): of the paths that path_counts counts, a shortest one for each root and forbidden name.

    Of several it is the one that breadth-first search over sorted successors finds.
    """
    by = list(by)
    rounds = Rounds(edges.sparkSession, "shortest")
    begin, inner, last = _pruned(edges, roots, forbidden, allowed, internal, by, rounds)
    key, order = [*by, "start"], Window.partitionBy(*by, "start").orderBy("_from", "node")
    frontier = rounds.keep(begin.select(*by, "start", F.col("start").alias("node"), F.lit(1).alias("place"), F.array("start").alias("path")))
    rounds.append("seen", frontier.select(*key, "node"))
    while not frontier.isEmpty():
        hit = frontier.join(last.select(*by, F.col("origin").alias("node"), F.col("end").alias("target"), "prefix"), [*by, "node"]).groupBy(*key, "target", "prefix").agg(F.min_by("path", "place").alias("path"))
        hit = hit.join(rounds.all("hits"), [*key, "target"], "left_anti") if rounds.has("hits") else hit
        rounds.append("hits", hit.select(*key, "target", "prefix", F.concat("path", F.array("target")).alias("path")))
        step = frontier.join(inner.select(*by, F.col("origin").alias("node"), "end"), [*by, "node"]).groupBy(*key, F.col("end").alias("node")).agg(F.min("place").alias("_from"), F.min_by("path", "place").alias("path"))
        step = step.join(rounds.all("seen"), [*key, "node"], "left_anti")
        frontier = rounds.keep(step.select(*key, "node", F.row_number().over(order).alias("place"), F.concat("path", F.array("node")).alias("path")))
        rounds.append("seen", frontier.select(*key, "node"))
    return rounds.all("hits") if rounds.has("hits") else begin.select(*key, F.col("start").alias("target"), F.col("start").alias("prefix"), F.array("start").alias("path")).where("false")
