"""Which values reach which places of a program: reaching definitions over control-flow edges, and type tests that decide something.

The fixed point is per group of key columns (a function of a project): a definition moves on along every edge, past nodes that
don't set its variable again. Groups of up to SMALL rows meet in blocks of about BLOCK rows, each settled in its task, so their
rows are shuffled once and not once a round. Larger groups go through a loop of joins over a frontier, in which only what is new in a
round moves in the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.plans.scratch import Rounds

SMALL = 1_000
BLOCK = 16_384
_EDGE, _SET, _TRACED = 0, 1, 2


def reaching(edges: DataFrame, definitions: DataFrame, by: Sequence[str] = (), traced: DataFrame | None = None) -> DataFrame:
    """(by, node, variable, definition): the definitions that may hold where a node begins.

    edges (by, origin, end); definitions (by, node, variable): a node that sets a variable. A definition may reach its own
    node again through a loop. With traced (by, node, variable) only those definitions are followed; all of them hide others.
    """
    by = list(by)
    rounds = Rounds(edges.sparkSession, "reaching")
    kind, none = dict(edges.dtypes)["end"], F.lit(None)
    own = edges.select(*by, F.lit(_EDGE).alias("kind"), F.col("origin").alias("node"), "end", none.cast(dict(definitions.dtypes)["variable"]).alias("variable")).where("node is not null and end is not null")
    for k, rows in ((_SET, definitions), (_TRACED, traced)):
        if rows is not None:
            own = own.unionByName(rows.select(*by, F.lit(k).alias("kind"), "node", none.cast(kind).alias("end"), "variable").where("node is not null and variable is not null"))
    own = rounds.keep(own.dropna(subset=by) if by else own)
    whole, small, large = own.count(), own, None
    if by:
        crowded = rounds.keep(own.groupBy(*by).count().where(F.col("count") > SMALL).select(*by))
        if not crowded.isEmpty():  # at most a thousandth as many as there are rows
            small, large = own.join(F.broadcast(crowded), by, "left_anti"), own.join(F.broadcast(crowded), by, "left_semi")
    elif whole > SMALL:
        small, large = None, own
    parts = []
    if small is not None:
        block = F.pmod(F.xxhash64(*by), F.lit(max(1, whole // BLOCK))) if by else F.lit(0)
        key = own.select(*by, "node", "variable", F.col("node").alias("definition"))
        rows = small.withColumn("end", F.col("end").cast(dict(own.dtypes)["node"])).withColumn("_block", block)
        parts.append(rows.groupBy("_block").applyInArrow(_settled(by, traced is not None), key.schema))
    if large is not None:
        parts.append(_followed(large, by, traced is not None, rounds))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _followed(rows: DataFrame, by: list[str], only_traced: bool, rounds: Rounds) -> DataFrame:
    """reaching() by joins, for groups of any size."""
    step = rounds.keep(rows.where(F.col("kind") == _EDGE).select(*by, "node", "end").distinct())
    sets = rounds.keep(rows.where(F.col("kind") == _SET).select(*by, "node", "variable").distinct())
    leaving = sets.join(rows.where(F.col("kind") == _TRACED).select(*by, "node", "variable"), [*by, "node", "variable"], "left_semi") if only_traced else sets
    leaving = leaving.select(*by, "node", "variable", F.col("node").alias("definition"))
    key = [*by, "node", "variable", "definition"]
    while True:
        moved = leaving.join(step, [*by, "node"]).select(*by, F.col("end").alias("node"), "variable", "definition").distinct()
        if rounds.has("reached"):
            moved = moved.join(rounds.all("reached"), key, "left_anti")
        new = rounds.append("reached", moved)
        if new.isEmpty():
            return rounds.all("reached")
        leaving = new.join(sets, [*by, "node", "variable"], "left_anti")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for a column's values, and the value of each."""
    coded = pa.concat_arrays(column.chunks).dictionary_encode() if column.num_chunks else pa.array([], column.type).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _settled(by: list[str], only_traced: bool) -> Callable[[pa.Table], pa.Table]:
    """reaching() for a block of groups: rounds over numbered places (a group's node) and definitions."""

    def settle(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        group = np.zeros(len(kind), np.int64)
        for c in by:
            code, values = _codes(rows[c])
            group = np.unique(group * len(values) + code, return_inverse=True)[1]
        shown = np.unique(group, return_index=True)[1]  # a row of each group
        edge, other = kind == _EDGE, kind != _EDGE
        node, nodes = _codes(pa.chunked_array([*rows["node"].chunks, *rows["end"].filter(pa.array(edge)).chunks], rows["node"].type))
        places, at = np.unique(np.concatenate([group, group[edge]]) * max(1, len(nodes)) + node, return_inverse=True)
        lines = np.unique(at[: len(kind)][edge] * len(places) + at[len(kind) :])
        ends, starts = lines % len(places), np.searchsorted(lines // len(places), np.arange(len(places) + 1))
        variable, variables = _codes(rows["variable"].filter(pa.array(other)))
        named = at[: len(kind)][other] * max(1, len(variables)) + variable
        sets = np.unique(named[kind[other] == _SET])
        if not len(sets):
            return pa.table({c: rows[c].slice(0, 0) for c in (*by, "node", "variable")} | {"definition": rows["node"].slice(0, 0)})
        set_at, set_variable = sets // len(variables), sets % len(variables)
        what = np.flatnonzero(np.isin(sets, named[kind[other] == _TRACED])) if only_traced else np.arange(len(sets))
        where, seen = set_at[what], np.zeros(0, np.int64)
        while len(where):
            ways = starts[where + 1] - starts[where]
            first = np.repeat(starts[where] - (np.cumsum(ways) - ways), ways)
            new = np.unique(ends[first + np.arange(len(first))] * len(sets) + np.repeat(what, ways))
            new = new[~np.isin(new, seen, assume_unique=True)]
            seen = np.concatenate([seen, new])
            where, what = new // len(sets), new % len(sets)
            on = ~np.isin(where * len(variables) + set_variable[what], sets)
            where, what = where[on], what[on]
        where, what = seen // len(sets), seen % len(sets)
        place, of = places[where], places[set_at[what]]
        out = {c: rows[c].take(shown[place // len(nodes)]) for c in by}
        return pa.table(out | {"node": nodes.take(place % len(nodes)), "variable": variables.take(set_variable[what]), "definition": nodes.take(of % len(nodes))})

    return settle


def deciding(edges: DataFrame, tests: DataFrame, definitions: DataFrame, branches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tests (by, node, ...) with branches: whether the outcome of a type test at that node decides which way the program goes.

    tests.variable is what keeps the outcome, null where the node uses it at once; branches (by, node, variable) are nodes
    that go one of several ways by a variable, or with a null variable by what they evaluate themselves. A kept outcome
    decides where the definition reaches a branch on its variable.
    """
    by = list(by)
    own = branches.select(*by, "node", "variable").distinct()
    at_once = tests.where("variable is null").join(own.where("variable is null").select(*by, "node").distinct().withColumn("_at_once", F.lit(True)), [*by, "node"], "left")
    kept = tests.where("variable is not null")
    arrived = reaching(edges, definitions, by, kept.select(*by, "node", "variable")).join(own.where("variable is not null"), [*by, "node", "variable"])
    hit = arrived.select(*by, F.col("definition").alias("node"), "variable").distinct().withColumn("_later", F.lit(True))
    later = kept.join(hit, [*by, "node", "variable"], "left")
    out = at_once.withColumn("branches", F.coalesce("_at_once", F.lit(False))).drop("_at_once")
    return out.unionByName(later.withColumn("branches", F.coalesce("_later", F.lit(False))).drop("_later"))
