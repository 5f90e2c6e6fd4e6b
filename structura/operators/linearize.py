"""Method resolution orders: C3 linearisation of classes with several bases, and members taken in that order.

Classes are settled in rounds from the roots down: a round takes every class whose bases are settled, whatever its project.
The merge of a class's lists is an expression, so a round is joins and one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structura.plans.scratch import Rounds

OK, INCONSISTENT, CYCLE = "ok", "inconsistent", "cycle"


def merged(lists: str) -> Column:
    """The C3 merge of an array of lists of names: again and again the first head that is in no list's tail. Null where there is none."""
    head = "get(filter(transform(s.rest, x -> x[0]), h -> not exists(s.rest, x -> array_position(x, h) > 1)), 0)"
    step = f"""transform(array({head}), h -> named_struct(
        'done', if(h is null, s.done, concat(s.done, array(h))),
        'rest', if(h is null, s.rest, filter(transform(s.rest, x -> if(x[0] = h, slice(x, 2, size(x)), x)), x -> size(x) > 0)),
        'ok', s.ok and h is not null))[0]"""
    start = f"named_struct('done', cast(array() as array<string>), 'rest', filter({lists}, x -> size(x) > 0), 'ok', true)"
    return F.expr(f"aggregate(array_distinct(flatten({lists})), {start}, (s, i) -> {step}, s -> if(s.ok, s.done, null))")


def linearize(bases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, status, mro): bases (by, class, place, base) with a row for each direct base, in the order of place.

    A name that is only a base is a class without bases. status is ok; inconsistent where no order keeps those of the bases
    (or a base is named twice, or is inconsistent itself); cycle where a class is its own ancestor, or has such an ancestor.
    mro (the class first) is null unless ok. Rows without class or base count for nothing.
    """
    by = list(by)
    rounds = Rounds(bases.sparkSession, "mro")
    own = bases.where("class is not null and base is not null").select(*by, "class", "place", "base").distinct()
    listed = rounds.keep(own.groupBy(*by, "class").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "base"))), lambda x: x["base"]).alias("bases")))
    waits = rounds.keep(own.select(*by, "class", "base").distinct())
    names = own.select(*by, F.col("base").alias("class")).distinct()
    frontier = rounds.append("settled", names.join(listed, [*by, "class"], "left_anti").select(*by, "class", F.lit(OK).alias("status"), F.array("class").alias("mro")))
    left = listed
    while not frontier.isEmpty():
        waits = rounds.keep(waits.join(frontier.select(*by, F.col("class").alias("base")), [*by, "base"], "left_anti"))
        ready = left.join(waits.select(*by, "class").distinct(), [*by, "class"], "left_anti")
        left = rounds.keep(left.join(waits.select(*by, "class").distinct(), [*by, "class"], "left_semi"))
        settled = rounds.all("settled").select(*by, F.col("class").alias("base"), F.col("status").alias("_status"), F.col("mro").alias("_mro"))
        each = ready.select(*by, "class", "bases", F.posexplode("bases").alias("place", "base")).join(settled, [*by, "base"])
        gathered = each.groupBy(*by, "class").agg(F.first("bases").alias("bases"), F.min(F.col("_status") == OK).alias("fine"), F.transform(F.array_sort(F.collect_list(F.struct("place", "_mro"))), lambda x: x["_mro"]).alias("orders"))
        fine = F.col("fine") & (F.size(F.array_distinct("bases")) == F.size("bases"))
        lists = gathered.withColumn("lists", F.when(fine, F.concat("orders", F.array("bases"))))
        done = lists.withColumn("mro", F.when(fine, F.concat(F.array("class"), merged("lists"))))
        frontier = rounds.append("settled", done.select(*by, "class", F.when(F.col("mro").isNotNull(), OK).otherwise(INCONSISTENT).alias("status"), "mro"))
    return rounds.all("settled").unionByName(left.select(*by, "class", F.lit(CYCLE).alias("status"), F.lit(None).cast("array<string>").alias("mro")))


def positions(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, holder, place): each class with itself (0) and its ancestors in the order in which members are looked up."""
    return orders.where("mro is not null").select(*by, "class", F.posexplode("mro").alias("place", "holder"))


def found_first(orders: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """members (by, holder, name, ...) as every class (column class, place) finds them: of each name the first in its order."""
    by = list(by)
    reached = positions(orders, by).join(members, [*by, "holder"])
    first = Window.partitionBy(*by, "class", "name").orderBy("place")
    return reached.withColumn("_n", F.rank().over(first)).where("_n = 1").drop("_n")
