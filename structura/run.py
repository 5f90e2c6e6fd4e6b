"""A whole run: scan a reference and its submissions, extract facts, match, judge the reference's markers, report.

    python -m structura run --reference ref --targets 'submissions/*' --report out
    python -m structura run --config run.ini --events recorded
    python -m structura markers
    python -m structura explain --report out --target a
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.operators import matching
from structura.plans import member_rules, runtime_rules  # noqa: F401  their kinds of rules register
from structura.plans import rules as R
from structura.sinks import report
from structura.sources import config as cfg
from structura.sources import event_log, markers, python_source


def files_of(spark: SparkSession, config: cfg.RunConfig) -> DataFrame:
    """(project, role, path, text) of the reference and every target."""
    targets = cfg.resolve_targets(config.targets, config.exclude)
    if not targets:
        raise cfg.ConfigError("no targets")
    parts = [python_source.scan(spark, config.reference, "source", "reference", config.pattern)]
    parts += [python_source.scan(spark, folder, "target", name, config.pattern) for name, folder in targets]
    return reduce(DataFrame.unionByName, parts)


def evaluate(files: DataFrame, config: cfg.RunConfig = cfg.RunConfig(), mapping: DataFrame | None = None, keep: Callable[[R.Rule], bool] | None = None, progress: Callable[[str], None] = lambda _: None, log: event_log.EventLog | None = None, alike: matching.Similarities = matching.Similarities()) -> DataFrame:
    """Results of the reference's markers on every target, files that don't parse and events that can't be used as results of their own.

    keep filters rules; progress hears of each step; log has the events that decide observing rules; alike
    exchanges the likenesses that matching scores by.
    """
    progress("facts")
    facts = python_source.extract(files).persist()
    sources, targets = (python_source.entities(facts.where(F.col("role") == r), config.include_nested_functions) for r in ("source", "target"))
    progress("markers")
    declared = markers.read_markers(files.where("role = 'source'"))
    rules = [r for r in markers.rules_of(declared, sources) if keep is None or keep(r)]
    progress("matching")
    if mapping is not None:
        unknown_names(mapping, sources, targets)
    found = matching.match(sources, targets, config.matching, mapping, alike=alike)
    progress("rules")
    errors = problems(python_source.syntax_errors(facts.where("role = 'target'")), F.concat(F.lit("syntax@"), "path"), "syntax", F.lit("syntax_error"), F.col("error"))
    events = None
    if log is not None:
        events = event_log.rule_events(log)
        lost = log.rejected.groupBy("project", "kind", "reason").agg(F.count("*").alias("n"), F.min(F.substring("record", 1, 200)).alias("record"))
        errors = errors.unionByName(problems(lost, F.concat(F.lit("events@"), "kind", F.lit("#"), "reason"), "event_log", F.col("reason"), F.concat_ws(" ", "n", F.lit("of"), "record")))
    return errors.unionByName(R.evaluate(facts, found, rules, config.fail_on_unmatched, events)) if rules else errors


def problems(rows: DataFrame, rule_id: Column, kind: str, reason: Column, detail: Column) -> DataFrame:
    """Results (ERROR) about what couldn't be read of a project."""
    none = F.lit(None).cast("string")
    return rows.select("project", rule_id.alias("rule_id"), F.lit(kind).alias("rule_type"), none.alias("source_id"), none.alias("target_id"), F.lit("ERROR").alias("status"), F.lit("error").alias("severity"), reason.alias("reason"), detail.alias("detail"))


def unknown_names(mapping: DataFrame, sources: DataFrame, targets: DataFrame) -> None:
    """ConfigError where a mapping names what neither the reference nor the run has."""
    named = sources.select(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), F.when(F.col("kind") != "module", F.col("qualname"))).alias("reference")).distinct()
    bad = [f"reference {r[0]}" for r in mapping.select("reference").distinct().join(named, "reference", "left_anti").orderBy("reference").limit(20).collect()]
    bad += [f"target {r[0]}" for r in mapping.where("target <> '*'").select(F.col("target").alias("project")).distinct().join(targets.select("project").distinct(), "project", "left_anti").orderBy("project").limit(20).collect()]
    if bad:
        raise cfg.ConfigError(f"a mapping names unknown {', '.join(bad)}")


def run(spark: SparkSession, config: cfg.RunConfig, **options) -> dict:
    """Evaluate and, if there is a folder for it, write the report; the run's summary."""
    if config.events:
        names = [name for name, _ in cfg.resolve_targets(config.targets, config.exclude)]
        options["log"] = event_log.read_log(spark, config.events, ["reference", *names])
    results = evaluate(files_of(spark, config), config, **options).withColumnRenamed("project", "target").withColumn("message", F.concat_ws(": ", "reason", "detail"))
    if config.report:
        return report.write_reports(results, config.report, config.policy)
    return report.run_summary(results, config.policy, config.threshold)


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="structura")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("run")
    p.add_argument("--config")
    p.add_argument("--reference")
    p.add_argument("--targets", nargs="*")
    p.add_argument("--report")
    p.add_argument("--events")
    commands.add_parser("markers")
    p = commands.add_parser("explain")
    p.add_argument("--report", required=True)
    p.add_argument("--target")
    p.add_argument("--rule")
    a = parser.parse_args(arguments)
    if a.command == "markers":
        print("\n".join(f"{k}({', '.join(v.split())})" for k, v in markers.MARKERS.items()))
        return 0
    spark = SparkSession.builder.appName("structura").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "explain":
        reports = report.read_reports(spark, a.report)
        (report.explain_target(reports, a.target) if a.target else report.explain_rule(reports, a.rule) if a.rule else report.failing_rules(reports)).show(50, False)
        return 0
    config = cfg.load_config(a.config) if a.config else cfg.RunConfig()
    config = replace(config, **{k: v for k, v in {"reference": a.reference, "targets": tuple(a.targets) if a.targets else None, "report": a.report, "events": a.events}.items() if v})
    document = run(spark, config)
    print(report.to_json(document), end="")
    return document["exit_code"]
