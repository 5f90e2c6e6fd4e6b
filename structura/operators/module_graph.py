"""Module graphs from import statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.functions import globs
from structura.operators.graph import longest_prefix


def module_edges(imports: DataFrame, modules: DataFrame, ignore_type_checking: bool = True, by: Sequence[str] = ("project",)) -> DataFrame:
    """(by, origin, end, cause): edges between a project's modules (by, module); the cause is the first statement's place.

    An imported name lies in its most specific module; loops and other names go. Where one statement names a package and a
    module in it, as `from pkg import sub` does, only the module counts.
    """
    by = list(by)
    place = [*by, "importer", "path", "lineno"]
    counted = F.coalesce(~F.col("in_type_checking"), F.lit(False)) if ignore_type_checking else F.lit(True)
    # Equal statements are one, counted if any of them is: what follows grows with the different ones.
    statements = imports.groupBy(*place, "imported").agg(F.max(counted).alias("counted"))
    spelled = statements.select(*place, "imported", "counted", F.explode(C.prefixes("imported")).alias("module"))
    hit = spelled.join(modules.select(*by, "module").distinct(), [*by, "module"])
    own = hit.groupBy(*place, "imported", "counted").agg(F.max_by("module", F.length("module")).alias("module"))
    # A package goes where its statement reaches into a module below it: each module also shows its own packages, to meet by equality.
    shown = own.select(*place, "imported", "counted", F.col("module").alias("_module"), F.explode(C.prefixes("module")).alias("module"))
    itself, whole = F.col("_module") == F.col("module"), F.col("imported") == F.col("_module")
    reached = shown.groupBy(*place, "module").agg(
        F.max(F.col("counted") & itself & ~whole).alias("into"), F.max(F.col("counted") & itself & whole).alias("package"),
        F.max(~itself & (F.col("imported") != "") & F.col("path").isNotNull() & F.col("lineno").isNotNull()).alias("below"),
    )
    kept = reached.where((F.col("module") != F.col("importer")) & (F.col("into") | (F.col("package") & ~F.col("below"))))
    first = kept.groupBy(*by, "importer", "module").agg(F.min(F.struct("path", "lineno")).alias("at"))
    return first.select(*by, F.col("importer").alias("origin"), F.col("module").alias("end"), F.concat_ws(":", "at.path", F.col("at.lineno").cast("string")).alias("cause"))


def library_edges(imports: DataFrame, modules: DataFrame, ignore_type_checking: bool = True, by: Sequence[str] = ("project",)) -> DataFrame:
    """(by, origin, end): top-level packages from outside the project that its modules import."""
    by = list(by)
    rows = imports.where("not own")
    rows = rows.where(~F.col("in_type_checking")) if ignore_type_checking else rows
    placed = longest_prefix(rows.select(*by, F.col("imported").alias("name")).distinct(), modules, by).where("module is null").select(*by, F.col("name").alias("imported"))
    return rows.join(placed, [*by, "imported"]).select(*by, F.col("importer").alias("origin"), F.substring_index("imported", ".", 1).alias("end")).distinct()


def without_ignored(imports: DataFrame, ignore_globs: Sequence[str] | None) -> DataFrame:
    """Statements of files that no ignore glob matches."""
    return imports.where(~globs.matches_any("path", ignore_globs)) if ignore_globs else imports
