"""Required and forbidden members: division, absence, closures over class bases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lacks(rows: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a hit."""
    return rows.join(hits.select(*keys).distinct(), list(keys), "left_anti")


def divides(rows: DataFrame, offered: DataFrame, needed: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """Rows that offer every needed item: distinct offers that are needed are counted, nothing is paired with every need."""
    need = needed.select(item).distinct()
    n = need.count()
    if not n:
        return rows.select(*keys).distinct()
    have = offered.select(*keys, item).distinct().join(need, item, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    return rows.select(*keys).distinct().join(have.where(F.col("_n") == n), list(keys), "left_semi")


def missing_items(needs: DataFrame, offered: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """(keys, item) of needs that their own key doesn't offer."""
    return needs.join(offered.select(*keys, item).distinct(), [*keys, item], "left_anti")
