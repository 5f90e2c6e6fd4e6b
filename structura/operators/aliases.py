"""Names that stand for other names: imports under another name, re-exports of packages, chains of them.

A pointer says that a name stands for another one. Few names are followed by pointer doubling: each round joins every open name
with what its target has come to, so a chain of n names takes about log2(n) rounds, and one that never ends is a cycle. As
each of these rounds moves every open name, many are contracted first: a round takes out a quarter of them, no two in a
row, and those before them point past them. What was taken out is settled afterwards, the last first, by one join with its target.
All rounds together move a few times the names, however long their chains are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.plans.scratch import Rounds


#: So many open names are followed by doubling, more are contracted before.
FEW = 1 << 16


def _taken(k: int) -> Column:
    """Whether a name is taken out in round k: its coin shows one side and its target's the other, so its target stays."""
    coin = lambda c: F.xxhash64(F.lit(k), c).bitwiseAND(1) == 1
    return ~F.col("ended") & coin("name") & ~coin("at")


def _as_targets(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.select(*by, F.col("name").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))


def _contracted(level: DataFrame, by: list[str], k: int) -> DataFrame:
    """The open names that stay in round k, pointing past those taken out. One that now points to itself is on a cycle and ends.

    Whether a target has ended need not be known: such names are taken out like others.
    """
    past = level.where(_taken(k)).select(*by, F.col("name").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"))
    met = level.where(~F.col("ended") & ~_taken(k)).join(past, [*by, "at"], "left")
    at = F.coalesce("_at", "at")
    loop = at == F.col("name")
    return met.select(*by, "name", F.when(~loop, at).alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), loop.alias("ended"))


def _doubled(open_: DataFrame, ended: DataFrame, by: list[str], rounds: Rounds, most: int) -> DataFrame:
    """What the open names, at most `most`, come to."""
    near = ended.join(open_.select(*by, F.col("at").alias("name")).distinct(), [*by, "name"], "left_semi")
    state = rounds.keep(open_.withColumn("asked", F.lit(True)).unionByName(near.withColumn("asked", F.lit(False))))
    reach = 1  # steps that open names have taken
    while reach <= most and not state.where("not ended").isEmpty():
        met = state.where("not ended").join(_as_targets(state, by), [*by, "at"])
        moved = met.select(*by, "name", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"), "asked")
        state = rounds.step(state.where("ended").unionByName(moved))
        reach *= 2
    # What has not ended after so many steps leads into a cycle.
    return state.where("asked").select(*by, "name", F.when(F.col("ended"), F.col("at")).alias("at"), "hops", F.lit(True).alias("ended"))


def follow(pointers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, name, final, hops, cyclic): what each name of pointers (by, name, target) stands for in the end.

    final is the first name on the way that has no pointer, hops how far it is; both are null for a name whose way leads
    into a cycle (cyclic). Of several targets of a name the first in order counts, as a later import would hide it.
    """
    by = list(by)
    rounds = Rounds(pointers.sparkSession, "aliases")
    own = rounds.keep(pointers.where("name is not null and target is not null").groupBy(*by, "name").agg(F.min("target").alias("at")))
    known = own.select(*by, F.col("name").alias("at"), F.lit(True).alias("_known"))
    loop = F.col("name") == F.col("at")
    # at is what a name has come to so far, for good where ended; null there for a cycle.
    first = own.join(known, [*by, "at"], "left").select(*by, "name", F.when(~loop, F.col("at")).alias("at"), F.lit(1).cast("long").alias("hops"), (F.col("_known").isNull() | loop).alias("ended"))
    levels = [rounds.keep(first)]
    while (most := levels[-1].where("not ended").count()) > FEW:
        levels.append(rounds.keep(_contracted(levels[-1], by, len(levels))))
    found = reduce(DataFrame.unionByName, [level.where("ended") for level in levels])
    found = found.unionByName(_doubled(levels.pop().where("not ended"), found, by, rounds, most))
    for k, level in reversed(list(enumerate(levels, 1))):
        back = level.where(_taken(k)).join(_as_targets(found, by), [*by, "at"])
        found = found.unionByName(rounds.keep(back.select(*by, "name", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.lit(True).alias("ended"))))
    return found.select(*by, "name", F.col("at").alias("final"), F.when(F.col("at").isNotNull(), F.col("hops")).alias("hops"), F.col("at").isNull().alias("cyclic"))


def rewritten(names: DataFrame, pointers: DataFrame, by: Sequence[str] = (), most: int = 32) -> DataFrame:
    """names (by, name, ...) with resolved: the longest prefix that is an alias replaced by what it stands for, until none is left.

    `pkg.Shape.area` where `pkg.Shape` is imported from `pkg.shapes` gives `pkg.shapes.Shape.area`, and an alias of a package
    in front of that is replaced next. Names that run into a cycle, or aren't settled after `most` rounds, are null.
    """
    by = list(by)
    rounds = Rounds(names.sparkSession, "names")
    final = rounds.keep(follow(pointers, by).select(*by, F.col("name").alias("prefix"), "final", "cyclic"))
    state = rounds.keep(names.select(*by, "name").where("name is not null").distinct().select(*by, "name", F.col("name").alias("at"), F.lit(True).alias("open")))
    for _ in range(most):
        hit = state.where("open").select(*by, "name", "at", F.explode(C.prefixes("at")).alias("prefix")).join(final, [*by, "prefix"])
        best = hit.groupBy(*by, "name").agg(F.max_by(F.struct("prefix", "final", "cyclic", "at"), F.length("prefix")).alias("b"))
        turned = F.when(F.col("b.cyclic"), F.lit(None)).otherwise(F.concat("b.final", F.expr("substring(b.at, length(b.prefix) + 1)")))
        moved = best.select(*by, "name", turned.alias("at"), (~F.col("b.cyclic") & (turned != F.col("b.at"))).alias("open"))
        still = state.where("open").join(best.select(*by, "name"), [*by, "name"], "left_anti").withColumn("open", F.lit(False))
        state = rounds.step(state.where("not open").unionByName(moved).unionByName(still))
        if state.where("open").isEmpty():
            break
    settled = state.select(*by, "name", F.when(~F.col("open"), F.col("at")).alias("resolved"))
    return names.join(settled, [*by, "name"], "left")
