"""Likest names without comparing all rows with all: equal names are compared once, so work grows with the different names of a block.

Pairs of names are never rows: a name meets lists of up to LIST others of its block and keeps the best of each list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structura.operators.selection import top_k


#: Names in a list that a name is compared with at once.
LIST = 512


def likest_names(rows: DataFrame, by: Sequence[str], identity: str, name: str, score: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """(source_id, target_id, score, rank): for each row the k others of its block (columns by; none: of all rows) with the likest names, ties by identity.

    Rows of a block with equal names are a class: scores are of pairs of classes, each class shows its first k + 1 identities
    and keeps the k + 1 best of what it meets, its own among them; a row then leaves itself out. The best k + 1 classes, ties by
    their first identity, hold the best k + 1 identities. A score is 1 for equal names and rounds to less for others, if one has less
    than a million characters; so a class of more than k rows has its best in itself, and only smaller ones are compared with
    all. Identities are unique; rows with a null in a block's columns, name or identity have no partners. An empty table gives no rows.
    """
    by = list(by)
    blocks = rows.select(*by, F.col(identity).alias("source_id"), F.col(name).alias("name")).dropna(subset=[*by, "source_id", "name"])
    shown = top_k(blocks, [*by, "name"], ["source_id"], k + 1).groupBy(*by, "name").agg(F.array_sort(F.collect_list("source_id")).alias("ids"))
    # Names of a block are dealt to as many lists as it needs, and those that ask to as many parts, so a list and a part that meet are
    # of about LIST names each. Comparing takes long for the few bytes it reads, so its partitions are fixed on both sides, not merged
    # by their sizes.
    full = (F.size("ids") > k) & (F.length("name") < 10**6)
    spread = lambda d: d.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_list", "_part")
    sizes = shown.groupBy(*by).agg(F.ceil(F.count("*") / LIST).alias("_lists"), F.greatest(F.ceil(F.count_if(~full) / LIST), F.lit(1)).alias("_parts"))
    dealt = shown.join(sizes, by) if by else shown.crossJoin(F.broadcast(sizes))  # one row
    place = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lists = spread(dealt.select(*by, "name", "ids", place("_lists").alias("_list"), each("_parts").alias("_part"))).groupBy(*by, "_list", "_part").agg(F.collect_list(F.struct(F.col("name").alias("other"), "ids")).alias("others"))
    asked = spread(dealt.where(~full).select(*by, "name", place("_parts").alias("_part"), each("_lists").alias("_list")))
    scored = F.transform("others", lambda o: F.struct((-F.round(score(F.col("name"), o["other"]), 6)).alias("less"), o["ids"].alias("ids")))
    met = asked.join(lists, [*by, "_list", "_part"]).select(*by, "name", F.slice(F.sort_array(scored), 1, k + 1).alias("some"))
    best = met.select(*by, "name", F.explode("some").alias("b")).select(*by, "name", (-F.col("b.less")).alias("score"), F.explode("b.ids").alias("target_id"))
    best = best.union(dealt.where(full).select(*by, "name", F.lit(1.0).alias("score"), F.explode("ids").alias("target_id")))
    best = top_k(best, [*by, "name"], [F.desc("score"), "target_id"], k + 1)
    lists = best.groupBy(*by, "name").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id", "score"))).alias("best"))
    own = blocks.join(lists, [*by, "name"]).select("source_id", F.slice(F.filter("best", lambda x: x["target_id"] != F.col("source_id")), 1, k).alias("best"))
    return own.select("source_id", F.posexplode("best").alias("at", "b")).select("source_id", "b.target_id", "b.score", (F.col("at") + 1).alias("rank"))


def nameless_pairs(rows: DataFrame, identity: str, name: str, k: int) -> DataFrame:
    """What likest_names without blocks leaves out where a pair with a null name has a null score and comes after all others, ties by identity.

    The first k others of a row without a name, and those of a row with one where fewer than k others have any. At most k + 1
    identities are gathered at a time.
    """
    ids = rows.select(F.col(identity).alias("source_id"), F.col(name).alias("name")).dropna(subset=["source_id"])
    named, nameless = ids.where("name is not null"), ids.where("name is null")
    first = lambda d, c: d.select("source_id").orderBy("source_id").limit(k + 1).agg(F.array_sort(F.collect_list("source_id")).alias(c))
    of_nameless = nameless.crossJoin(F.broadcast(first(ids, "some"))).select("source_id", F.lit(0).alias("before"), F.slice(F.filter("some", lambda x: x != F.col("source_id")), 1, k).alias("some"))
    few = first(named, "few").where(F.size("few") <= k).crossJoin(F.broadcast(first(nameless, "some")))
    of_few = few.select(F.explode("few").alias("source_id"), (F.size("few") - 1).alias("before"), F.slice("some", 1, F.lit(k + 1) - F.size("few")).alias("some"))
    both = of_nameless.union(of_few).select("source_id", "before", F.posexplode("some").alias("at", "target_id"))
    return both.select("source_id", "target_id", F.lit(None).cast("double").alias("score"), (F.col("before") + F.col("at") + 1).alias("rank"))
