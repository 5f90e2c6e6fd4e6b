"""Rank-like choices: top-k, status by the gap to a rival, one-to-one winners, turns, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structura.plans.scratch import Rounds

Order = Sequence[str | Column]


def top_k(rows: DataFrame, by: Sequence[str], order: Order, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in order. Spark keeps k rows a group in each task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def match_status(best: Column, second: Column, threshold: float = 0.80, delta: float = 0.03, least: float = 0.50) -> Column:
    """UNMATCHED, LOW_CONFIDENCE, AMBIGUOUS (a rival within delta) or MATCHED."""
    return (
        F.when(best.isNull() | (best < least), "UNMATCHED").when(best < threshold, "LOW_CONFIDENCE").when(second.isNotNull() & (second >= best - delta), "AMBIGUOUS").otherwise("MATCHED")
    )


def best_two(candidates: DataFrame, by: Sequence[str], target: str, score: str, order: Order) -> DataFrame:
    """(by, target, best, second): the first candidate in order and its runner-up's score, null if alone."""
    two = top_k(candidates, by, order, 2)
    first, then = F.col("rank") == 1, F.col("rank") == 2
    return two.groupBy(*by).agg(F.max(F.when(first, F.col(target))).alias(target), F.max(F.when(first, F.col(score))).alias("best"), F.max(F.when(then, F.col(score))).alias("second"))


def winners(pairs: DataFrame, target: str, order: Order) -> DataFrame:
    """Of the rows that claim a target, the first in order."""
    return top_k(pairs, [target], order, 1).drop("rank")


def in_turn(rows: DataFrame, group: str, order: Order, limit: int) -> DataFrame:
    """Up to limit rows, taken in turn from each group: the first of each, then the second of each, ...

    A group gives limit rows at most, so ranks beyond it never leave their task. Ties between groups go by name.
    """
    ranked = top_k(rows, [group], order, limit, "turn")
    return ranked.orderBy("turn", group).limit(limit)


def in_turn_once(rows: DataFrame, group: str, order: Order, identity: str, limit: int) -> DataFrame:
    """As in_turn, but a row that is in several groups is taken once, and its other groups go on with their next.

    The groups' turns, in order, take rows one after another, each the first of its group that none before it took. That is
    found in rounds of claims: every group claims its rows in order, leaving out those that a turn before its own holds; a
    claimed row is held by the earliest turn; and so on until nothing changes. After k rounds the first k turns are right for
    good, and mostly all of them are after a few. At most limit rows are taken, so the first limit rows of a group are enough.
    """
    rounds = Rounds(rows.sparkSession, "turns")
    listed = rows.where(F.col(group).isNotNull() & F.col(identity).isNotNull()).dropDuplicates([group, identity])
    ranked = rounds.keep(top_k(listed, [group], order, limit, "_rank"))
    # Of each group its rows in order with the turn that holds each; a scan over at most limit rows gives its next claims.
    scan = f"""aggregate(_rows, named_struct('n', 0, 'out', cast(array() as array<struct<id: {dict(rows.dtypes)[identity]}, turn: int>>)),
        (s, r) -> if(r.held is not null and r.held.owner <> `{group}` and (r.held.turn < s.n + 1 or (r.held.turn = s.n + 1 and r.held.owner < `{group}`)), s,
                     named_struct('n', s.n + 1, 'out', concat(s.out, array(named_struct('id', r.id, 'turn', s.n + 1))))), s -> s.out)"""
    held = rounds.keep(ranked.select(F.col(identity).alias("_id"), F.struct(F.lit(0).alias("turn"), F.col(group).alias("owner")).alias("_held")).where("false"))
    while True:
        with_held = ranked.select(group, "_rank", F.col(identity).alias("_id")).join(held, "_id", "left")
        lists = with_held.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col("_id").alias("id"), F.col("_held").alias("held")))), lambda x: F.struct(x["id"].alias("id"), x["held"].alias("held"))).alias("_rows"))
        claims = lists.select(group, F.explode(F.expr(scan)).alias("c")).select(F.col("c.id").alias("_id"), F.struct(F.col("c.turn").alias("turn"), F.col(group).alias("owner")).alias("_held"))
        after = rounds.keep(claims.groupBy("_id").agg(F.min("_held").alias("_held")))
        changed = not after.join(held, ["_id", "_held"], "left_anti").isEmpty() or not held.join(after, ["_id", "_held"], "left_anti").isEmpty()
        held = after
        if not changed:
            break
    chosen = held.orderBy("_held").limit(limit).select("_id", F.col("_held.owner").alias("_owner"), F.row_number().over(Window.orderBy("_held")).alias("turn"))
    return ranked.drop("_rank").join(F.broadcast(chosen), (F.col(identity) == F.col("_id")) & (F.col(group) == F.col("_owner"))).drop("_id", "_owner")  # limit rows


def page(rows: DataFrame, order: Order, offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """One page in order; offset and limit are clamped."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


#: Total orders in which entities, matches, results, targets and evidence are listed.
ORDERS = {
    "entities": ("role", "root", "module", "lineno", "qualname", "kind", "canonical_id"),
    "matches": ("source_id", "target_id", "status"),
    "results": ("target", "rule_id", "source_id", "target_id", "status", "message"),
    "targets": ("target",),
    "evidence": ("target", "kind", "module", "lineno", "evidence_id"),
}


def in_order(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in their kind's total order, by those of its columns that there are; nulls first."""
    return rows.orderBy(*[F.asc_nulls_first(c) for c in ORDERS[kind] if c in rows.columns])


def first_in_order(rows: DataFrame, order: Order, limit: int) -> DataFrame:
    """The first rows of a total order, as of the mutants that a run tries: a top-k, no global sort."""
    return rows.orderBy(*order).limit(limit)
