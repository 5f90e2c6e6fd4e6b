"""Recursive questions about edge tables (origin, end), per group of key columns such as a project.

Every search is a loop of joins over a frontier, written out each round, so that plans stay small and lost executors cost
one round. Frontiers carry the group's keys, so one loop serves any number of projects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.plans.scratch import Rounds

LIMIT = 10_000


def _distinct_edges(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    return edges.select(*by, "origin", "end").where("origin is not null and end is not null").distinct()


def longest_prefix(names: DataFrame, modules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """names (by, name) with `module`: the longest of modules (by, module) that the name is or lies in, null if none.

    Prefixes of distinct names are exploded and meet modules by equality, so no row is compared with every module.
    """
    spelled = names.select(*by, "name").distinct().select(*by, "name", F.explode(C.prefixes("name")).alias("module"))
    hit = spelled.join(modules.select(*by, "module").distinct(), [*by, "module"])
    best = hit.groupBy(*by, "name").agg(F.max_by("module", F.length("module")).alias("module"))
    return names.join(best, [*by, "name"], "left")


def reachable(edges: DataFrame, starts: DataFrame | None = None, by: Sequence[str] = (), include_start: bool = False, limit: int = LIMIT) -> DataFrame:
    """(by, start, node): what each start reaches; starts (by, start), or every origin. A start on a cycle reaches itself."""
    by = list(by)
    spark, own = edges.sparkSession, _distinct_edges(edges, by)
    begin = (own.select(*by, F.col("origin").alias("start")) if starts is None else starts.select(*by, "start")).distinct()
    rounds = Rounds(spark, "reach")
    own = rounds.keep(own)
    step = own.withColumnRenamed("origin", "node")
    frontier = begin.withColumn("node", F.col("start"))
    seen = None
    for _ in range(limit):
        after = frontier.join(step, [*by, "node"]).select(*by, "start", F.col("end").alias("node")).distinct()
        if seen is not None:
            after = after.join(seen, [*by, "start", "node"], "left_anti")
        frontier = rounds.keep(after)
        if frontier.isEmpty():
            break
        seen = frontier if seen is None else rounds.step(seen.unionByName(frontier))
    else:
        raise RuntimeError("reachability did not end")
    found = seen if seen is not None else frontier
    return found.unionByName(begin.withColumn("node", F.col("start"))).distinct() if include_start else found


def strongly_connected(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, component, node) of components of two or more nodes; a component is named by its smallest node.

    Rounds of colouring: each node takes the largest node that reaches it; a node that keeps its own name is a root, and
    what reaches the root within its colour is its component. Found components and what is left without edges go.
    """
    by = list(by)
    spark = edges.sparkSession
    rounds = Rounds(spark, "scc")
    left = rounds.keep(_distinct_edges(edges, by).where("origin <> end"))
    out = None
    while not left.isEmpty():
        # Only nodes with edges both ways can lie on a cycle.
        while True:
            n = left.count()
            left = rounds.step(left.join(left.select(*by, F.col("end").alias("origin")).distinct(), [*by, "origin"], "left_semi").join(left.select(*by, F.col("origin").alias("end")).distinct(), [*by, "end"], "left_semi"))
            if left.count() == n:
                break
        if n == 0:
            break
        nodes = left.select(*by, F.col("origin").alias("node")).union(left.select(*by, "end")).distinct()
        color = rounds.keep(nodes.withColumn("color", F.col("node")))
        while True:
            pushed = left.join(color.withColumnRenamed("node", "origin"), [*by, "origin"]).select(*by, F.col("end").alias("node"), "color")
            after = rounds.keep(color.unionByName(pushed).groupBy(*by, "node").agg(F.max("color").alias("color")))
            if after.join(color, [*by, "node", "color"], "left_anti").isEmpty():
                break
            color = after
        within = left.join(color.select(*by, F.col("node").alias("origin"), "color"), [*by, "origin"]).join(color.select(*by, F.col("node").alias("end"), F.col("color").alias("other")), [*by, "end"]).where("color = other").select(*by, "origin", "end", "color")
        within = rounds.keep(within)
        found = rounds.keep(color.where("node = color").select(*by, "node", "color"))
        frontier = found
        while not frontier.isEmpty():
            back = frontier.join(within.select(*by, F.col("end").alias("node"), "origin", "color"), [*by, "node", "color"]).select(*by, F.col("origin").alias("node"), "color").distinct()
            frontier = rounds.keep(back.join(found, [*by, "node", "color"], "left_anti"))
            found = rounds.keep(found.unionByName(frontier))
        big = Window.partitionBy(*by, "color")
        own = found.select(*by, F.min("node").over(big).alias("component"), "node", F.count("*").over(big).alias("n")).where("n > 1").drop("n")
        out = own if out is None else out.unionByName(own)
        gone = found.select(*by, "node")
        left = rounds.keep(left.join(gone.withColumnRenamed("node", "origin"), [*by, "origin"], "left_anti").join(gone.withColumnRenamed("node", "end"), [*by, "end"], "left_anti"))
    return out if out is not None else left.select(*by, F.col("origin").alias("component"), F.col("origin").alias("node"))


def cycle_paths(edges: DataFrame, components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, component, path): a shortest cycle through each component's first node, closed.

    Of several, the one that a breadth-first search over sorted successors finds: frontiers keep their nodes' order.
    """
    by = list(by)
    rounds = Rounds(edges.sparkSession, "cycle")
    member = components.select(*by, "component", "node")
    inner = _distinct_edges(edges, by).where("origin <> end").join(member.withColumnRenamed("node", "origin"), [*by, "origin"]).join(member.withColumnRenamed("node", "end"), [*by, "component", "end"])
    inner = rounds.keep(inner)
    frontier = member.select(*by, "component", F.col("component").alias("node"), F.lit(1).alias("place"), F.array("component").alias("path")).distinct()
    seen, out = frontier.select(*by, "component", "node"), None
    seen = rounds.keep(seen)
    order = Window.partitionBy(*by, "component").orderBy("from_place", "node")
    while not frontier.isEmpty():
        step = frontier.join(inner.withColumnRenamed("origin", "node"), [*by, "component", "node"])
        closing = step.where(F.col("end") == F.col("component")).groupBy(*by, "component").agg(F.min_by("path", "place").alias("path"))
        done = rounds.keep(closing.select(*by, "component", F.concat("path", F.array("component")).alias("path")))
        out = done if out is None else out.unionByName(done)
        first = step.groupBy(*by, "component", F.col("end").alias("node")).agg(F.min("place").alias("from_place"), F.min_by("path", "place").alias("path"))
        first = first.join(seen, [*by, "component", "node"], "left_anti").join(done, [*by, "component"], "left_anti")
        frontier = rounds.keep(first.select(*by, "component", "node", F.row_number().over(order).alias("place"), F.concat("path", F.array("node")).alias("path")))
        seen = rounds.keep(seen.unionByName(frontier.select(*by, "component", "node")))
    return out


def parse_layers(raw: Sequence[str], closed: Sequence[str] = ()) -> list[dict]:
    """Layers, highest first, as rows (member, position, independent, closed, title).

    `a | b` are siblings that may not use each other, `a : b` ones that may. ValueError for a mix, an empty or repeated
    module, a closed module that is in no layer, or a closed lowest layer.
    """
    rows: list[dict] = []
    for position, entry in enumerate(raw):
        if "|" in entry and ":" in entry:
            raise ValueError(f"layer {entry!r} mixes '|' and ':'")
        members = [m.strip() for m in entry.split(":" if ":" in entry else "|")]
        if not all(members):
            raise ValueError(f"layer {entry!r} names an empty module")
        shut = any(m in closed for m in members)
        rows += [{"member": m, "position": position, "independent": ":" not in entry, "closed": shut, "title": " | ".join(members)} for m in members]
    names = [r["member"] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError(f"modules named in more than one layer: {sorted({n for n in names if names.count(n) > 1})}")
    if set(closed) - set(names):
        raise ValueError(f"closed names modules that are in no layer: {sorted(set(closed) - set(names))}")
    if rows and rows[-1]["closed"]:
        raise ValueError("the lowest layer cannot be closed")
    return rows


def layer_verdict(layers: list[dict]) -> DataFrame | tuple:
    """Columns (kind, closed_layer) of an edge between layer members `from_member` and `to_member`, as expressions."""
    kind, shut = F.lit(None).cast("string"), F.lit("")
    place = {r["member"]: r for r in layers}
    titles = {r["position"]: r["title"] for r in layers if r["closed"]}
    for a, x in place.items():
        for b, y in place.items():
            if y["position"] < x["position"]:
                verdict, between = "upward", ""
            elif y["position"] == x["position"]:
                verdict, between = ("sibling" if x["independent"] else None), ""
            else:
                over = [titles[p] for p in range(x["position"] + 1, y["position"]) if p in titles]
                verdict, between = ("skip", over[0]) if over else (None, "")
            if verdict and a != b:
                hit = (F.col("from_member") == a) & (F.col("to_member") == b)
                kind, shut = F.when(hit, F.lit(verdict)).otherwise(kind), F.when(hit, F.lit(between)).otherwise(shut)
    return kind, shut


def layer_violations(edges: DataFrame, raw_layers: Sequence[str], closed: Sequence[str] = (), chains: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, origin_layer, target_layer, path, closed_layer): shortest paths that break the order of layers.

    A path leads from a module of a layer to one of another, through modules of no layer or of its own one (with chains),
    never through a third layer. One path for each pair of modules, the one breadth-first search over sorted successors finds.
    """
    by = list(by)
    spark = edges.sparkSession
    rounds = Rounds(spark, "layers")
    layers = parse_layers(raw_layers, closed)
    own = rounds.keep(_distinct_edges(edges, by))
    members = spark.createDataFrame([(r["member"],) for r in layers], "module string")
    nodes = own.select(*by, F.col("origin").alias("name")).union(own.select(*by, "end")).distinct()
    placed = rounds.keep(longest_prefix(nodes.select("name").distinct(), members).withColumnRenamed("module", "member"))
    kind, shut = layer_verdict(layers)
    starts = own.select(*by, F.col("origin").alias("start")).distinct().join(placed.withColumnRenamed("name", "start"), "start").where("member is not null")
    frontier = rounds.keep(starts.select(*by, "start", F.col("member").alias("from_member"), F.col("start").alias("node"), F.lit(1).alias("place"), F.array("start").alias("path")))
    seen, out = rounds.keep(frontier.select(*by, "start", "node")), None
    order = Window.partitionBy(*by, "start").orderBy("from_place", "node")
    while not frontier.isEmpty():
        step = frontier.join(own.withColumnRenamed("origin", "node"), [*by, "node"])
        first = step.groupBy(*by, "start", "from_member", F.col("end").alias("node")).agg(F.min("place").alias("from_place"), F.min_by("path", "place").alias("path"))
        first = first.join(seen, [*by, "start", "node"], "left_anti").join(placed.select(F.col("name").alias("node"), F.col("member").alias("to_member")), "node", "left")
        first = rounds.keep(first.select(*by, "start", "from_member", "to_member", "node", "from_place", F.concat("path", F.array("node")).alias("path")))
        hit = first.where("to_member is not null and to_member <> from_member").select(*by, kind.alias("kind"), F.col("from_member").alias("origin_layer"), F.col("to_member").alias("target_layer"), "path", shut.alias("closed_layer")).where("kind is not null")
        out = hit if out is None else out.unionByName(hit)
        seen = rounds.keep(seen.unionByName(first.select(*by, "start", "node")))
        on = first.where("to_member is null or to_member = from_member") if chains else first.where("false")
        frontier = rounds.keep(on.select(*by, "start", "from_member", "node", F.row_number().over(order).alias("place"), "path"))
    return out if out is not None else frontier.select(*by, F.lit("").alias("kind"), F.col("from_member").alias("origin_layer"), F.col("from_member").alias("target_layer"), "path", F.lit("").alias("closed_layer"))


def simple_paths(
    edges: DataFrame, roots: DataFrame, forbidden: Sequence[str], allowed: Sequence[str] = (), internal: DataFrame | None = None, by: Sequence[str] = (), longest: int = 64
) -> DataFrame:
    """(by, start, target, prefix, path): every path without repeated nodes from a root (by, start) to a forbidden name.

    A path ends at the first forbidden name and never enters an allowed one or one that isn't internal (by, module). The
    number of such paths can grow exponentially; a search beyond `longest` steps raises instead of dropping any.
    """
    by = list(by)
    rounds = Rounds(edges.sparkSession, "paths")
    own = _distinct_edges(edges, by).withColumn("prefix", C.first_prefix("end", list(forbidden))).where(C.first_prefix("end", list(allowed)).isNull())
    if internal is not None:
        own = own.join(internal.select(*by, F.col("module").alias("end"), F.lit(True).alias("inside")).distinct(), [*by, "end"], "left")
    else:
        own = own.withColumn("inside", F.lit(True))
    own = rounds.keep(own)
    frontier, out = rounds.keep(roots.select(*by, "start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()), None
    for _ in range(longest):
        step = frontier.join(own.withColumnRenamed("origin", "node"), [*by, "node"])
        step = rounds.keep(step.select(*by, "start", "end", "prefix", "inside", "path"))
        hit = step.where("prefix is not null").select(*by, "start", F.col("end").alias("target"), "prefix", F.concat("path", F.array("end")).alias("path"))
        out = hit if out is None else out.unionByName(hit)
        frontier = step.where("prefix is null and inside").where(~F.array_contains("path", F.col("end"))).select(*by, "start", F.col("end").alias("node"), F.concat("path", F.array("end")).alias("path"))
        frontier = rounds.keep(frontier)
        if frontier.isEmpty():
            return out
    raise RuntimeError(f"simple paths of more than {longest} steps are left")
