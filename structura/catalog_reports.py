"""Queries over principles, roles and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.catalog import _EDGES_SQL, _nation_edges, query, table
from structura.catalog_events import _CALLS_SQL, _calls
from structura.operators import edges
from structura.plans import principles
from structura.sinks import report
from structura.sources.config import parse_principle

#: A small entry of a catalogue, as its file would have it.
PRINCIPLE = parse_principle(
    {
        "id": "trade", "name": "Trade", "roles": {"logic": "computes", "io": "talks"}, "checks": [{"marker": "forbid_runtime_calls", "role": "logic", "target_role": "io"}],
        "errors": [
            {"id": "returned", "detected_by": "forbid_runtime_calls", "signature": {"flag": "R"}, "operator": "r"}, {"id": "returned_open", "detected_by": "forbid_runtime_calls", "signature": {"flag": "R", "line": "O"}, "operator": "a"},
            {"id": "kept", "detected_by": "forbid_foreign_writes", "signature": {"flag": "N"}}, {"id": "unseen", "gap": "not observed"},
        ],
    },
    "trade",
)

_LINES_SQL = """
    WITH x AS (SELECT l_suppkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'forbid_runtime_calls' ELSE 'forbid_foreign_writes' END AS marker, l_linenumber, CASE WHEN l_quantity >= 25 THEN 'FAILED' WHEN l_quantity > 20 THEN 'ERROR' WHEN l_quantity > 10 THEN 'SKIPPED' ELSE 'OK' END AS status,
                      l_returnflag AS flag, l_linestatus AS line, l_quantity FROM lineitem),
         f AS (SELECT target, marker || '@f' || l_linenumber AS rule_id, CASE WHEN marker = 'forbid_runtime_calls' AND flag = 'R' AND line = 'O' THEN 'returned_open' WHEN marker = 'forbid_runtime_calls' AND flag = 'R' THEN 'returned'
                      WHEN marker = 'forbid_foreign_writes' AND flag = 'N' THEN 'kept' ELSE 'other' END AS error FROM x WHERE status = 'FAILED')
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as results of two rules on suppliers, each with one fact."""
    q = F.col("l_quantity")
    marker = F.when(F.col("l_linenumber") % 2 == 0, "forbid_runtime_calls").otherwise("forbid_foreign_writes")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("target"), F.concat(marker, F.lit("@f"), "l_linenumber").alias("rule_id"), F.when(q >= 25, "FAILED").when(q > 20, "ERROR").when(q > 10, "SKIPPED").otherwise("OK").alias("status"),
        F.array(F.create_map(F.lit("flag"), "l_returnflag", F.lit("line"), "l_linestatus")).alias("facts"), F.when(F.col("l_linenumber") == 7, "warning").otherwise("error").alias("severity"), F.concat(F.lit("flag "), "l_returnflag").alias("message"),
    )


@query("classify_findings", _LINES_SQL + "SELECT target, rule_id, error, count(*) AS n FROM f GROUP BY ALL")
def classify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return principles.classify(_lines(spark, sf_dir), PRINCIPLE).groupBy("target", "rule_id", "error").agg(F.count("*").alias("n"))


@query(
    "classify_targets",
    _LINES_SQL
    + """, b AS (SELECT DISTINCT s_suppkey AS target FROM supplier WHERE s_acctbal < 0)
    SELECT target, 'syntax_error' AS error, 'broken.py' AS rule_id FROM b UNION ALL
    SELECT * FROM (SELECT s_suppkey AS target, 'missing_entity' AS error, 'n' || s_nationkey AS rule_id FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT DISTINCT target, error, rule_id FROM f) WHERE target NOT IN (SELECT target FROM b)""",
)
def classify_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    broken = supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("target"), F.lit("broken.py").alias("path"))
    missing = supplier.where("s_acctbal > 9000").select(F.col("s_suppkey").alias("target"), F.concat(F.lit("n"), "s_nationkey").alias("source_id"))
    return principles.classify_targets(_lines(spark, sf_dir), PRINCIPLE, missing, broken)


@query(
    "judge_submissions",
    _LINES_SQL
    + """, y AS (SELECT target, rule_id, error FROM f WHERE error = 'returned_open' AND target % 2 = target % 4), w AS (SELECT target, count(*) FILTER (status = 'ERROR') AS e, count(*) FILTER (status <> 'SKIPPED') AS j FROM x GROUP BY 1),
         v AS (SELECT target, target IN (SELECT target FROM y) AS bad, CASE WHEN e > 0 THEN 'error' WHEN j = 0 THEN 'nothing_judged' END AS reason FROM w)
    SELECT target, CASE WHEN bad THEN 'failed' WHEN reason IS NOT NULL THEN 'not_judged' ELSE 'passed' END AS verdict, CASE WHEN NOT bad AND reason IS NOT NULL THEN reason ELSE '' END AS reason FROM v""",
)
def judge_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only one error counts, and only for some suppliers, so that all verdicts occur."""
    rows = _lines(spark, sf_dir)
    findings = principles.classify(rows, PRINCIPLE).where("error = 'returned_open' and target % 2 = target % 4")
    return principles.judge_submissions(findings.select("target", "error"), rows)


@query(
    "verify_task",
    _LINES_SQL
    + """, m AS (SELECT DISTINCT s_suppkey AS mutant, CASE WHEN s_nationkey < 12 THEN 'r' ELSE 'a' END AS operator FROM supplier), w AS (SELECT * FROM (VALUES ('returned', 'r'), ('returned_open', 'a')) v(error, operator)),
         h AS (SELECT DISTINCT target AS mutant, error FROM f)
    SELECT w.error, count(m.mutant) AS seeded, count(h.mutant) AS killed FROM w LEFT JOIN m USING (operator) LEFT JOIN h ON h.mutant = m.mutant AND h.error = w.error GROUP BY 1""",
)
def verify_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    mutants = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mutant"), F.when(F.col("s_nationkey") < 12, "r").otherwise("a").alias("operator"))
    return principles.verify_task(PRINCIPLE, mutants, principles.classify(_lines(spark, sf_dir), PRINCIPLE))


@query(
    "io_roles",
    _CALLS_SQL
    + """, k AS (SELECT DISTINCT project, caller, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND function = 'f1' AND starts_with(callee, 'r1.') THEN 'input' WHEN l_returnflag = 'A' AND function = 'f2' AND starts_with(callee, 'r2.') THEN 'print' ELSE callee END AS callee FROM c WHERE function IN ('f1', 'f2')),
         r AS (SELECT DISTINCT project, caller AS function FROM k WHERE callee = 'input'),
         i AS (SELECT * FROM r UNION SELECT k.project, k.caller FROM k JOIN r ON r.project = k.project AND r.function = k.callee WHERE k.caller = 'r0.n0' UNION SELECT DISTINCT project, 'r0.n0' FROM k),
         j AS (SELECT * FROM r UNION SELECT k.project, k.caller FROM k JOIN r ON r.project = k.project AND r.function = k.callee UNION SELECT DISTINCT project, 'r0.n0' FROM k),
         l AS (SELECT DISTINCT k.project, k.callee AS function FROM k JOIN j ON j.project = k.project AND j.function = k.caller WHERE k.callee NOT IN ('input', 'print', 'open')),
         t AS (SELECT DISTINCT project, caller AS function FROM k WHERE callee IN ('input', 'print', 'open'))
    SELECT project, function, 'io' AS role FROM j UNION ALL
    SELECT project, function, CASE WHEN (project, function) IN (SELECT project, function FROM t) THEN 'disputed' ELSE 'logic' END FROM l WHERE (project, function) NOT IN (SELECT project, function FROM j)""",
)
def io_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as functions; some lines read the keyboard, some print."""
    rows = _calls(spark, sf_dir).where(F.col("function").isin("f1", "f2"))
    reads = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R") & (F.col("function") == "f1") & F.startswith("callee", F.lit("r1."))
    prints = (F.col("l_returnflag") == "A") & (F.col("function") == "f2") & F.startswith("callee", F.lit("r2."))
    calls = rows.select("project", "caller", F.when(reads, "input").when(prints, "print").otherwise(F.col("callee")).alias("callee")).distinct()
    return principles.io_roles(calls, calls.select("project", F.lit("r0.n0").alias("function")).distinct())


@query(
    "encapsulation_roles",
    """WITH p AS (SELECT p_type AS project, replace(p_brand, '#', '') AS class, replace(p_name, ' ', '_') AS name, p_size FROM part), o AS (SELECT DISTINCT project, class AS name FROM p WHERE p_size > 46)
    SELECT *, 'owner' AS role FROM o UNION ALL SELECT *, 'client' AS role FROM (SELECT DISTINCT project, name FROM p WHERE p_size < 5 UNION SELECT project, class FROM p WHERE (project, class) NOT IN (SELECT project, name FROM o))""",
)
def encapsulation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("project"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("class"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), "p_size")
    return principles.encapsulation_roles(part.select("project", "class", F.col("name").alias("attribute"), (F.col("p_size") > 46).alias("changed")), part, part.where("p_size < 5"))


@query(
    "polymorphism_roles",
    """WITH c AS (SELECT 'p' || (n_nationkey % 3) AS project, 'n' || n_nationkey AS class, n_nationkey < 12 AS abstract, n_name AS method FROM nation),
         b AS (SELECT x.project, x.class, y.class AS base FROM (SELECT *, n_nationkey, n_regionkey FROM nation JOIN c ON class = 'n' || n_nationkey) x JOIN (SELECT *, n_nationkey, n_regionkey FROM nation JOIN c ON class = 'n' || n_nationkey) y ON x.project = y.project AND x.n_regionkey = y.n_regionkey AND y.n_nationkey < x.n_nationkey),
         t AS (SELECT project, class FROM c WHERE abstract AND (project, class) NOT IN (SELECT b.project, b.class FROM b JOIN c ON c.project = b.project AND c.class = b.base AND c.abstract)),
         d AS (SELECT DISTINCT b.project, b.class AS name, b.base FROM b JOIN t ON t.project = b.project AND t.class = b.base), u AS (SELECT DISTINCT project, base AS name FROM d),
         k AS (SELECT DISTINCT 'p' || (c_custkey % 3) AS project, c_mktsegment AS caller, n_name AS method FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT *, 'base' AS role FROM u UNION ALL SELECT DISTINCT project, name, 'variant' FROM d UNION ALL SELECT DISTINCT k.project, k.caller, 'client' FROM k JOIN c ON c.project = k.project AND c.method = k.method JOIN u ON u.project = c.project AND u.name = c.class""",
)
def polymorphism_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as classes, those of a region derive from the ones before them, and customers call them."""
    nation = table(spark, sf_dir, "nation")
    own = nation.select(F.concat(F.lit("p"), F.col("n_nationkey") % 3).alias("project"), F.concat(F.lit("n"), "n_nationkey").alias("class"), (F.col("n_nationkey") < 12).alias("abstract"), F.array("n_name").alias("methods"), "n_nationkey", "n_regionkey")
    other = own.select("project", "n_regionkey", F.col("class").alias("base"), F.col("n_nationkey").alias("k"))
    bases = own.join(other, ["project", "n_regionkey"]).where("k < n_nationkey").select("project", "class", "base")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).join(nation.select("n_nationkey", "n_name"), "n_nationkey")
    calls = customer.select(F.concat(F.lit("p"), F.col("c_custkey") % 3).alias("project"), F.col("c_mktsegment").alias("caller"), F.col("n_name").alias("method")).distinct()
    return principles.polymorphism_roles(own, bases, calls)


# ---- reports


@query(
    "report_targets",
    _LINES_SQL
    + """SELECT CAST(target AS VARCHAR) AS target, CAST(max(status IN ('FAILED', 'ERROR')) AS INT) AS exit_code, count(*) AS results, count(*) FILTER (status = 'FAILED') AS failed, min(marker || '@f' || l_linenumber) AS first_rule FROM x GROUP BY 1""",
)
def report_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.target_reports(_lines(spark, sf_dir))
    return rows.select("target", "exit_code", F.size("results").cast("long").alias("results"), F.coalesce(F.try_element_at("counts", F.lit("FAILED")), F.lit(0)).alias("failed"), F.col("results")[0]["rule_id"].alias("first_rule"))


@query(
    "explain_rule",
    _LINES_SQL
    + """, y AS (SELECT DISTINCT 'flag ' || flag AS message, CAST(target AS VARCHAR) AS target FROM x WHERE status NOT IN ('OK', 'SKIPPED') AND marker = 'forbid_runtime_calls'), k AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY target) AS n FROM y)
    SELECT message, count(*) AS targets, array_to_string(list(target ORDER BY n) FILTER (n <= 20), ', ') AS examples FROM k GROUP BY 1""",
)
def explain_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.explain_rule(report.target_reports(_lines(spark, sf_dir)), "forbid_runtime_calls")


@query(
    "class_overview",
    _LINES_SQL
    + """, y AS (SELECT DISTINCT error, CAST(target AS VARCHAR) AS target FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY error ORDER BY target) AS n FROM y)
    SELECT error, count(*) AS targets, array_to_string(list(target ORDER BY n) FILTER (n <= 10), ', ') AS names FROM k GROUP BY 1""",
)
def class_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.class_overview(principles.classify(_lines(spark, sf_dir), PRINCIPLE).select(F.col("target").cast("string").alias("target"), "error"))


@query(
    "edge_sections",
    _EDGES_SQL
    + """, a AS (SELECT origin, "end" FROM g WHERE year = 1996 AND NOT starts_with(origin, 'r3.')), d AS (SELECT CAST(year AS VARCHAR) AS target, origin, "end", row_number() OVER (PARTITION BY year ORDER BY origin, "end") AS n FROM g ANTI JOIN a USING (origin, "end") WHERE year <> 1996)
    SELECT target, array_to_string(list('- divergent: `' || origin || ' -> ' || "end" || '`' ORDER BY n) FILTER (n <= 5), chr(10)) || CASE WHEN max(n) > 5 THEN chr(10) || '- and ' || (max(n) - 5) || ' more' ELSE '' END AS text FROM d GROUP BY 1""",
)
def edge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir).withColumn("target", F.col("year").cast("string"))
    model = rows.where((F.col("year") == 1996) & ~F.startswith("origin", F.lit("r3."))).select("origin", "end")
    diffs = edges.compare_edges(model, rows.where("year <> 1996"), "strict", by=["target"]).where("kind <> 'absent'")
    return report.edge_section(diffs, 5)


@query("module_model", _EDGES_SQL + """SELECT origin AS module, '{"module":"' || origin || '","uses":["' || string_agg(DISTINCT "end", '","' ORDER BY "end") || '"]}' AS model FROM g WHERE year = 1999 GROUP BY 1""")
def module_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.model(_nation_edges(spark, sf_dir).where("year = 1999"))


@query("markdown_reports")
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown(report.target_reports(_lines(spark, sf_dir)))
