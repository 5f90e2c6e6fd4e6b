"""Reports: a JSON document a target, a summary of the run, Markdown, and what is asked of written reports.

Targets are rendered where their rows are, as rows of (target, text); only the run's summary, which is as large as the
numbers of statuses, rules and categories, comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.operators import selection, summary

SCHEMA_VERSION = "1"
RESULT = "target string, rule_id string, rule_type string, category string, status string, severity string, message string, source_id string, target_id string, confidence double, seconds double"
REPORT = f"target string, display_name string, exit_code int, counts map<string, bigint>, results array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in RESULT.split(', ')[1:])}>>"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def normalise(results: DataFrame) -> DataFrame:
    """Results with all columns of RESULT: missing ones are null, texts without a value empty, categories `unknown`."""
    have = set(results.columns)
    kinds = dict(c.split() for c in RESULT.split(", "))
    rename = {"target": "project", "message": "reason"}

    def column(c: str) -> Column:
        source = c if c in have else rename.get(c)
        value = F.col(source).cast(kinds[c]) if source in have else F.lit(None).cast(kinds[c])
        return F.coalesce(value, F.lit("unknown" if c == "category" else "")).alias(c) if kinds[c] == "string" and c not in ("source_id", "target_id") else value.alias(c)

    return results.select(*[column(c) for c in _COLUMNS])


def enrich(results: DataFrame, rules: DataFrame, entities: DataFrame) -> DataFrame:
    """Results with what is known of their rules (rule_id, category, message) and of target entities (canonical_id, path, lineno): left joins.

    What a result says itself goes before what its rule says.
    """
    own = results.join(rules.select("rule_id", F.col("category").alias("_category"), F.col("message").alias("_message")), "rule_id", "left")
    own = own.join(entities.select(F.col("canonical_id").alias("target_id"), "path", "lineno"), "target_id", "left")
    said = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}"), F.lit(""))
    return own.withColumns({"category": said("category"), "message": said("message")}).drop("_category", "_message")


def target_reports(results: DataFrame, warnings_as_fail: bool = False) -> DataFrame:
    """(target, display_name, exit_code, counts, results): one row a target, its results in their total order."""
    own = normalise(results)
    order = ["rule_id", "source_id", "target_id", "status", "message"]
    rest = [c for c in _COLUMNS if c != "target"]
    flag = summary.exit_flag(F.col("status"), F.col("severity"), warnings_as_fail)
    counts = own.groupBy("target", "status").agg(F.count("*").alias("n")).groupBy("target").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("r"))))
    rows = own.groupBy("target").agg(F.max(flag).alias("exit_code"), F.transform(listed, lambda x: x["r"]).alias("results"))
    return rows.join(counts, "target").select("target", F.col("target").alias("display_name"), "exit_code", "counts", "results")


def run_summary(results: DataFrame, policy: str = "any_fail", threshold: int = 1, top: int = 5) -> dict:
    """The summary of a run, from a few small aggregates."""
    own = normalise(results)
    codes = summary.target_exit_codes(own)
    total = codes.agg(F.count("*").alias("n"), F.coalesce(F.sum("exit_code"), F.lit(0)).alias("failed")).first()
    run = {r.policy: r.exit_code for r in summary.run_exit_codes(codes, threshold).collect()}

    def counts(column: str, rows: DataFrame = own) -> dict[str, int]:
        return {r[0]: r.n for r in sorted(summary.count_by(rows, column).collect())}

    bad = own.where(F.col("status").isin(*summary.VIOLATIONS))
    times = summary.timings(own, "seconds").first()
    return {
        "schema_version": SCHEMA_VERSION,
        "exit_code": run[policy],
        "summary": {
            "results": {
                "results_total": sum(counts("status").values()), "unverified_total": own.where(F.col("status").isin("SKIPPED", "ERROR")).count(), "status_counts": counts("status"), "severity_counts": counts("severity"),
                "category_counts": counts("category"), "timings": times.asDict() if times else None, "top_rules": [{"name": r.name, "count": r.n} for r in summary.top_counts(bad, "rule_id", top).collect()],
            },
            "targets_total": total.n, "targets_failed": total.failed, "targets_passed": total.n - total.failed,
        },
    }


def to_json(document: dict) -> str:
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_reports(results: DataFrame, path: str, policy: str = "any_fail") -> dict:
    """Write a target a line as JSON under path/targets and the run's summary as path/run.json; the summary is returned."""
    target_reports(results).write.mode("overwrite").json(f"{path}/targets")
    document = run_summary(results, policy)
    spark = results.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run.json")
    out = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs, True)
    try:
        out.write(bytearray(to_json(document).encode()))
    finally:
        out.close()
    return document


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a written run, by the schema that they were written with; ValueError for another run's version."""
    text = "".join(r.value for r in spark.read.text(f"{path}/run.json", wholetext=True).collect())
    if json.loads(text).get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"{path} has another schema version than {SCHEMA_VERSION}")
    return spark.read.schema(REPORT).json(f"{path}/targets")


def results_of(reports: DataFrame) -> DataFrame:
    return reports.select("target", F.explode("results").alias("r")).select("target", "r.*")


# ---- Markdown


def _table(header: Sequence[str], rows: Column) -> Column:
    head = f"| {' | '.join(header)} |\n|{'---|' * len(header)}\n"
    return F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit("\n"))


def markdown(reports: DataFrame) -> DataFrame:
    """(target, text): a Markdown document for each target; problems first, in their total order."""
    cell = lambda c: C.escape_markdown(F.coalesce(c, F.lit("")))
    bad = F.filter("results", lambda r: C.is_problem(r["status"]))
    lines = F.transform(bad, lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", cell(r["status"]), cell(r["rule_id"]), cell(r["message"])), F.lit(" |")))
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string")))
    text = F.concat(F.lit("# "), cell(F.col("display_name")), F.lit("\n\nExit code "), F.col("exit_code").cast("string"), F.lit("\n\n"), F.array_join(entries, "\n"), F.lit("\n\n"), F.when(F.size(bad) > 0, _table(["Status", "Rule", "Message"], lines)).otherwise(F.lit("No problems.\n")))
    return reports.select("target", text.alias("text"))


def bundle(reports: DataFrame, document: dict) -> DataFrame:
    """(path, text): an index with the run's summary and a page for each target, as a bundle of files."""
    pages = markdown(reports).select(F.concat(F.lit("targets/"), C.unique_slug("target", "target", F.lit(True)), F.lit(".md")).alias("path"), "text")
    results = document["summary"]["results"]
    lines = ["# Run", "", f"Exit code {document['exit_code']}: {document['summary']['targets_failed']} of {document['summary']['targets_total']} targets failed.", "", *(f"- {k}: {v}" for k, v in results["status_counts"].items()), "", "## Rules", "", *(f"- {r['name']}: {r['count']}" for r in results["top_rules"])]
    index = reports.sparkSession.createDataFrame([("index.md", "\n".join(lines) + "\n")], "path string, text string")
    return index.unionByName(pages)


def edge_section(diffs: DataFrame, limit: int = 50) -> DataFrame:
    """(target, text): each target's edges that aren't convergent as a Markdown list, most pressing kinds first, so many at most and a count of the rest."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ("divergent", "undecided", "absent", "allowed")]), F.col("kind"))
    rows = diffs.where("kind <> 'convergent'").withColumn("rank", rank)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("rank", "origin", "end")))
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(": `"), C.format_edge("origin", "end"), F.lit("`"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct(F.col("n").alias("k"), line.alias("v"))))), lambda x: x["v"])
    more = F.when(F.max("n") > limit, F.concat(F.lit("\n- and "), (F.max("n") - limit).cast("string"), F.lit(" more"))).otherwise("")
    return ranked.groupBy("target").agg(F.concat(F.array_join(listed, "\n"), more).alias("text"))


def matching_debug(candidates: DataFrame, top: int = 3) -> DataFrame:
    """(project, source_id, text): the best candidates of each source with their scores, one a line."""
    best = selection.top_k(candidates.drop("rank") if "rank" in candidates.columns else candidates, ["project", "source_id"], [F.desc("confidence"), F.desc("mod"), "distance", "target_id"], top)
    line = F.concat(F.col("rank").cast("string"), F.lit(". `"), F.col("target_id"), F.lit("` "), F.format_number("confidence", 6), F.lit(" ("), F.col("stage"), F.lit(")"))
    return best.groupBy("project", "source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def declaration_report(declared: DataFrame) -> DataFrame:
    """(path, qualname, markers, issues): what each entity of a reference declares, in order."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda x: x[c])
    own = declared.groupBy("path", "qualname").agg(listed("marker").alias("markers"), F.filter(listed("issues"), lambda x: x != "").alias("issues"))
    return own.select("path", "qualname", F.array_join("markers", ", ").alias("markers"), F.array_join("issues", "; ").alias("issues"))


def model(edges: DataFrame) -> DataFrame:
    """(module, model): a reference's module graph as JSON, a line a module with what it uses, in order."""
    uses = edges.groupBy(F.col("origin").alias("module")).agg(F.array_sort(F.collect_set("end")).alias("uses"))
    return uses.select("module", F.to_json(F.struct("module", "uses")).alias("model"))


# ---- questions about written reports


def explain_target(reports: DataFrame, target: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one target's problems."""
    rows = results_of(reports.where(F.col("target") == target)).where(C.is_problem("status"))
    return selection.page(rows, ["rule_id", "source_id", "target_id", "message"], offset, limit)


def explain_rule(reports: DataFrame, rule_id: str, limit: int = 20) -> DataFrame:
    """(message, targets, examples): what a rule's problems say, on how many targets, with some of their names."""
    rows = results_of(reports).where(C.is_problem("status") & C.rule_matches("rule_id", [rule_id])).select("message", "target").distinct()
    named = summary.first_names(rows, ["message"], "target", ["target"], limit)
    return named.select("message", F.col("total").alias("targets"), F.array_join("names", ", ").alias("examples"))


def failing_rules(reports: DataFrame, limit: int = 20) -> DataFrame:
    return summary.failing_targets(results_of(reports).where(C.is_problem("status")), "rule_id", "target", limit)


def class_overview(findings: DataFrame, limit: int = 10) -> DataFrame:
    """(error, targets, names): how many targets made each error of a catalogue, with some of their names, most first.

    findings: target, error (null for findings that no error describes, listed as `other`).
    """
    rows = findings.select(F.coalesce("error", F.lit("other")).alias("error"), "target").distinct()
    named = summary.first_names(rows, ["error"], "target", ["target"], limit)
    return named.select("error", F.col("total").alias("targets"), F.array_join("names", ", ").alias("names"))
