"""Grouped summaries of result tables (target, rule_id, status, severity, category, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIOLATIONS = ("FAILED", "ERROR")
RUN_POLICIES = ("any_fail", "all_fail", "threshold")


def count_by(results: DataFrame, *columns: str, missing: str = "") -> DataFrame:
    """Counts per value of the columns; a null counts under `missing`."""
    return results.groupBy(*[F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in columns]).agg(F.count("*").alias("n"))


def top_counts(rows: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The most frequent values, ties by name: (name, n). Ranked after counting, so only distinct values move."""
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def timings(results: DataFrame, seconds: str = "timing_seconds") -> DataFrame:
    """Count, sum, maximum and mean of the timings there are, to six digits; no row if there are none."""
    s = F.col(seconds)
    out = results.where(s.isNotNull()).agg(F.count("*").alias("n"), F.round(F.sum(s), 6).alias("total"), F.round(F.max(s), 6).alias("longest"), F.round(F.avg(s), 6).alias("mean"))
    return out.where("n > 0")


def exit_flag(status: Column, severity: Column, warnings_as_fail: bool = False) -> Column:
    """1 for a row that makes its target fail: a violation, or a warning if those count. SKIPPED and OK rows never do."""
    failed = status.isin(*VIOLATIONS)
    if warnings_as_fail:
        failed = failed | (~status.isin("SKIPPED", "OK") & ((severity == "warning") | (status == "WARNING")))
    return F.coalesce(failed, F.lit(False)).cast("int")


def target_exit_codes(results: DataFrame, target: str = "target", warnings_as_fail: bool = False) -> DataFrame:
    """(target, exit_code): a maximum, combined before the shuffle."""
    return results.groupBy(target).agg(F.max(exit_flag(F.col("status"), F.col("severity"), warnings_as_fail)).alias("exit_code"))


def run_exit_codes(codes: DataFrame, threshold: int = 1) -> DataFrame:
    """(policy, exit_code) of a run under each policy; without targets no policy fails, but a threshold of 0 does."""
    n = codes.agg(F.count("*").alias("total"), F.coalesce(F.sum("exit_code"), F.lit(0)).alias("failed"))
    failed, total = F.col("failed"), F.col("total")
    code = {"any_fail": failed >= 1, "all_fail": (total > 0) & (failed == total), "threshold": failed >= threshold}
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), code[p].cast("int").alias("exit_code")) for p in RUN_POLICIES])
    return n.select(F.explode(pairs).alias("x")).select("x.*")


def failing_targets(results: DataFrame, rule: str, target: str, limit: int | None = 20) -> DataFrame:
    """(rule, failing_targets): distinct targets with a problem per rule, most first, ties by rule."""
    out = results.groupBy(F.col(rule).alias("rule")).agg(F.countDistinct(target).alias("failing_targets")).orderBy(F.desc("failing_targets"), "rule")
    return out if limit is None else out.limit(limit)


def verdicts(findings: DataFrame, target: str, violation: Column, unjudged: Column) -> DataFrame:
    """(target, verdict): failed with any violation, else not_judged with any row that is unjudged, else passed."""
    rank = F.max(F.when(violation, 2).when(unjudged, 1).otherwise(0))
    word = F.element_at(F.array(F.lit("passed"), F.lit("not_judged"), F.lit("failed")), rank + 1)
    return findings.groupBy(target).agg(word.alias("verdict"))


def bounded_count(n: Column, least: int | None, most: int | None) -> Column:
    """none, too_few, too_many or within."""
    out = F.when(n == 0, "none") if (least or 0) > 0 else F.when(F.lit(False), "none")
    if least is not None:
        out = out.when(n < least, "too_few")
    if most is not None:
        out = out.when(n > most, "too_many")
    return out.otherwise("within")


def mutant_outcomes(results: DataFrame, by: Sequence[str] = ("mutant",)) -> DataFrame:
    """(by, outcome): killed with a failure that observed something; else not_run with one that didn't; else survived.

    SKIPPED rows count only where nothing else ran. Columns: status, reason.
    """
    reason = F.coalesce("reason", F.lit(""))
    blind = (F.col("status") == "ERROR") | ((F.col("status") == "FAILED") & (F.startswith(reason, F.lit("probe_")) | reason.isin("case_setup_failed", "reference_failed", "target_kind_mismatch")))
    killed = F.max(((F.col("status") == "FAILED") & ~blind).cast("int"))
    broken = F.max(blind.cast("int"))
    ran = F.max((F.col("status") != "SKIPPED").cast("int"))
    return results.groupBy(*by).agg(F.when(killed == 1, "killed").when((broken == 1) | (ran == 0), "not_run").otherwise("survived").alias("outcome"))


def min_max(rows: DataFrame, column: str, mode: str = "minmax", by: Sequence[str] = ()) -> DataFrame:
    """rows with `<column>_norm`: as it is (direct), 1 where all are equal (constant), or within least and most (minmax)."""
    w = Window.partitionBy(*by) if by else None
    x = F.col(column)
    if mode == "none":
        return rows.withColumn(f"{column}_norm", F.lit(None).cast("double"))
    if mode == "direct":
        return rows.withColumn(f"{column}_norm", x.cast("double"))
    if w is None:
        ends = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        rows = rows.crossJoin(F.broadcast(ends))  # one row
    else:
        rows = rows.withColumns({"_lo": F.min(x).over(w), "_hi": F.max(x).over(w)})
    norm = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return rows.withColumn(f"{column}_norm", norm).drop("_lo", "_hi")


def case_coverage(expected: DataFrame, executed: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """(by, lines, run, ratio): how many of the expected lines (by, line) were executed."""
    hit = executed.select(*by, "line").distinct().withColumn("hit", F.lit(1))
    n = expected.select(*by, "line").distinct().join(hit, [*by, "line"], "left").groupBy(*by).agg(F.count("*").alias("lines"), F.coalesce(F.sum("hit"), F.lit(0)).alias("run"))
    return n.withColumn("ratio", F.col("run") / F.col("lines"))


#: Statuses of a project without a reference, first match first.
GLOBAL_STATUSES = ("not_applied", "violated", "unverified", "ok")
VERDICTS = ("passed", "failed", "not_judged")


def count_where(rows: DataFrame, condition: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n): rows for which a condition holds; a null doesn't."""
    return rows.groupBy(*by).agg(F.count_if(condition).alias("n"))


def status_pivot(matches: DataFrame, statuses: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column for each status): counts in one pass, zero where there is none."""
    return matches.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses])


def verdict_counts(verdicts_: DataFrame) -> DataFrame:
    """(verdict, n, ordinal) in the fixed order of verdicts, those that don't occur too."""
    every = verdicts_.sparkSession.createDataFrame([(v, k) for k, v in enumerate(VERDICTS)], "verdict string, ordinal int")
    n = verdicts_.groupBy("verdict").agg(F.count("*").alias("n"))
    return every.join(n, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"), "ordinal")


def first_names(rows: DataFrame, by: Sequence[str], name: str, order: Sequence[str], limit: int) -> DataFrame:
    """(by, names, total): distinct names in the order in which they are first seen, at most limit of them listed."""
    seen = rows.groupBy(*by, name).agg(F.min(F.struct(*order)).alias("at"))
    ranked = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("at", name)))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= limit, F.struct(F.col("_n").alias("k"), F.col(name).alias("v"))))), lambda x: x["v"])
    return ranked.groupBy(*by).agg(listed.alias("names"), F.count("*").alias("total"))


def global_status(applied: Column, violations: Column, unjudged: Column, covered: Column, mutants_survived: Column, dropped: Column, disputed: Column) -> Column:
    """struct(status, reason) of a principle on a project without a reference: what stands first in this order decides."""

    def own(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    return (
        F.when(~applied, own("not_applied", "no_role"))
        .when(violations > 0, own("violated", "findings"))
        .when(unjudged > 0, own("unverified", "not_judged"))
        .when(~covered, own("unverified", "coverage"))
        .when(mutants_survived > 0, own("unverified", "mutants"))
        .when(dropped > 0, own("unverified", "dropped"))
        .when(disputed > 0, own("unverified", "disputed"))
        .otherwise(own("ok", ""))
    )


def most_specific(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the catalogue errors that fit a fact, the one whose signature has most keys, then the first in the catalogue.

    hits: by, error, keys (how many), ordinal.
    """
    best = F.min(F.struct((-F.col("keys")).alias("k"), "ordinal", "error"))
    return hits.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.error").alias("error"))


def not_judged_reason(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, reason): why a target has no verdict: an error, a failure without facts, or nothing that was judged."""
    n = results.groupBy(*by).agg(
        F.count_if(F.col("status") == "ERROR").alias("errors"), F.count_if((F.col("status") == "FAILED") & (F.coalesce(F.size("facts"), F.lit(0)) <= 0)).alias("bare"), F.count_if(F.col("status") != "SKIPPED").alias("judged")
    )
    reason = F.when(F.col("errors") > 0, "error").when(F.col("bare") > 0, "failed_without_facts").when(F.col("judged") == 0, "nothing_judged")
    return n.select(*by, reason.alias("reason")).where("reason is not null")
