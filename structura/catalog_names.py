"""Queries over names, signatures, matching and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.catalog import _EDGES_SQL, _nation_edges, query, table
from structura.functions import columns as C
from structura.operators import edges, matching, module_graph, selection, summary

# ---- names


@query(
    "module_relations",
    _EDGES_SQL
    + """SELECT year, origin, "end", CASE WHEN origin = "end" THEN 1.0 WHEN split_part(origin, '.', 1) = split_part("end", '.', 1) THEN 0.5 ELSE 0.0 END AS similarity,
           CASE WHEN origin = "end" THEN 0 WHEN split_part(origin, '.', 1) = split_part("end", '.', 1) THEN 2 ELSE 4 END AS distance, origin = 'r1' OR starts_with(origin, 'r1.') AS inside,
           CASE WHEN starts_with("end", 'r2.') THEN substr("end", 4) END AS below, CASE WHEN ends_with(origin, '.n1') THEN left(origin, length(origin) - 3) END AS before, split_part(origin, '.', 1) AS owner,
           CASE WHEN starts_with("end", 'r3.') THEN substr("end", 4) ELSE "end" END AS stripped FROM g""",
)
def module_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_edges(spark, sf_dir).select(
        "year", "origin", "end", C.module_similarity("origin", "end").alias("similarity"), C.module_distance("origin", "end").alias("distance"), C.in_module("origin", F.lit("r1")).alias("inside"),
        C.under_package("end", "r2").alias("below"), C.by_suffix("origin", F.lit("n1")).alias("before"), C.class_of("origin").alias("owner"), C.strip_package("end", "r3").alias("stripped"),
    )


_KEY_SQL = "SELECT p_partkey, p_size % 3 AS sp, p_size % 4 AS sa, p_size % 2 AS sv, p_size % 5 AS sk, least(p_size % 2, p_size % 3 + p_size % 4) AS sd, (p_size + p_partkey % 2) % 4 AS ta, p_size % 5 + p_partkey % 2 AS tk FROM part"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, odd = F.col("p_size"), F.col("p_partkey") % 2
    none = F.lit(0)
    d = F.least(size % 2, size % 3 + size % 4)
    source = C.signature_key(size % 3, size % 4, size % 2, size % 5, none, d, none)
    target = C.signature_key(size % 3, ((size + odd) % 4).cast("int"), size % 2, (size % 5 + odd).cast("int"), none, d, odd.cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", source.alias("source"), target.alias("target"))


@query(
    "signature_relations",
    f"""WITH k AS ({_KEY_SQL}), o AS (SELECT *, p_partkey % 2 AS tkd FROM k)
    SELECT p_partkey, 'p' || sp || '-a' || sa || '-v' || sv || '-k' || sk || '-w0-d' || sd || '-kd0' AS source, sa = ta AND sk = tk AND tkd = 0 AS same_counts,
           abs(sa - ta) = 1 AND sk = tk AND tkd = 0 AS first_differs, sp + sa - sd = sp + ta - sd AND sk = tk - tkd AND sp + sa <= sp + ta AND sk <= tk AS extras_only FROM o""",
)
def signature_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("p_partkey", "source", C.same_counts("source", "target").alias("same_counts"), C.first_parameter_differs("source", "target").alias("first_differs"), C.extras_only("source", "target").alias("extras_only"))


@query(
    "name_predicates",
    """WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '_' || replace(p_name, ' ', '_') WHEN 1 THEN '__' || replace(p_name, ' ', '_') || '__' WHEN 2 THEN '__' || replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') END AS name,
                      replace(p_brand, '#', '') AS owner FROM part)
    SELECT p_partkey, starts_with(name, '_') AND NOT (starts_with(name, '__') AND ends_with(name, '__')) AS private, starts_with(name, '__') AND ends_with(name, '__') AS dunder, regexp_full_match(name, '_?[rs].*') AS by_regex, name IN ('red_widget', 'small_ring') AS by_names,
           CASE WHEN starts_with(name, '__') AND NOT ends_with(name, '__') THEN '_' || owner || name ELSE name END AS mangled,
           'no member ' || name || ' of ' || owner || ' (?)' AS message FROM n""",
)
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, kind = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size") % 4
    name = F.when(kind == 0, F.concat(F.lit("_"), plain)).when(kind == 1, F.concat(F.lit("__"), plain, F.lit("__"))).when(kind == 2, F.concat(F.lit("__"), plain)).otherwise(plain)
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("owner"))
    return rows.select(
        "p_partkey", C.is_private("name").alias("private"), C.is_dunder("name").alias("dunder"), C.name_matches("name", "regex", pattern="_?[rs].*").alias("by_regex"),
        C.name_matches("name", "names", names=["red_widget", "small_ring"]).alias("by_names"), C.mangled("owner", "name").alias("mangled"), C.fill_template("no member {name} of {owner} ({line})", {"name": "name", "owner": "owner"}).alias("message"),
    )


@query(
    "text_functions",
    r"""WITH t AS (SELECT item_id, text FROM benchmark)
    SELECT item_id, sha256(regexp_replace(trim(text, ' '), '\s+', ' ', 'g')) AS doc_hash, length(regexp_replace(trim(text, ' '), '\s+', ' ', 'g')) AS doc_length,
           CASE WHEN trim(regexp_replace(lower(left(text, 40)), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'target' ELSE trim(regexp_replace(lower(left(text, 40)), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
           regexp_replace(left(text, 80), '([\\`*_{}\[\]()#+\-.!|<>])', '\\\1', 'g') AS escaped, left(sha1('rule|' || item_id || '|' || text), 16) AS result_id FROM t""",
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, short = C.normal_docstring("text"), F.substring("text", 1, 40)
    return table(spark, sf_dir, "benchmark").select(
        "item_id", C.hash_text(doc).alias("doc_hash"), F.length(doc).cast("long").alias("doc_length"), C.slug(short).alias("slug"), C.escape_markdown(F.substring("text", 1, 80)).alias("escaped"), C.result_id(F.lit("rule"), "item_id", "text").alias("result_id")
    )


@query(
    "target_ids",
    """WITH t AS (SELECT c_custkey, lower(c_mktsegment) AS base, c_name AS path, count(*) OVER (PARTITION BY c_mktsegment) > 1 AS clash FROM customer)
    SELECT c_custkey, CASE WHEN clash THEN base || '-' || left(sha1(path), 8) ELSE base END AS target_id, 'target:' || base || ':' || path || ':f:function:-' AS canonical_id FROM t""",
)
def target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    clashing = rows.groupBy("c_mktsegment").agg((F.count("*") > 1).alias("clash"))
    return rows.join(clashing, "c_mktsegment").select("c_custkey", C.unique_slug("c_mktsegment", "c_name", F.col("clash")).alias("target_id"), C.canonical_id(F.lit("target"), C.slug("c_mktsegment"), "c_name", F.lit("f"), F.lit("function"), F.lit("-")).alias("canonical_id"))


@query(
    "edge_texts",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS origin, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS "end", o_orderstatus || ' -> ' || o_orderpriority AS formatted,
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, o_orderstatus NOT IN ('OK', 'SKIPPED') AS problem, starts_with('rule@' || o_orderpriority, 'rule@1') AS wanted FROM orders""",
)
def edge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("o_orderstatus", F.when(F.col("o_orderstatus") == "P", " ").otherwise(" -> "), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").withColumn("edge", C.parse_edge(text))
    return rows.select("o_orderkey", F.col("edge.origin").alias("origin"), F.col("edge.end").alias("end"), C.format_edge("o_orderstatus", "o_orderpriority").alias("formatted"), C.utc_text("o_orderdate").alias("at"), C.is_problem("o_orderstatus").alias("problem"), C.rule_matches(F.concat(F.lit("rule@"), "o_orderpriority"), ["rule@1", "marker"]).alias("wanted"))


# ---- edges


@query(
    "rename_edges",
    _EDGES_SQL + """SELECT DISTINCT year, a AS origin, b AS "end" FROM (SELECT year, CASE WHEN starts_with(origin, 'r0.') THEN 'shop' ELSE origin END AS a, CASE WHEN starts_with("end", 'r0.') THEN 'shop' ELSE "end" END AS b FROM g) WHERE a <> b""",
)
def rename_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir)
    names = rows.select("year", F.col("origin").alias("name")).distinct().where(F.startswith("name", F.lit("r0."))).withColumn("new_name", F.lit("shop"))
    return edges.rename_edges(rows, names, ["year"]).select("year", "origin", "end")


@query(
    "compare_packages",
    _EDGES_SQL
    + """, t AS (SELECT DISTINCT year, origin, split_part("end", '.', 2) AS "end" FROM g), u AS (SELECT DISTINCT split_part("end", '.', 2) AS package FROM g WHERE year = 1995 AND starts_with(origin, 'r1.'))
    SELECT year, origin, "end", CASE WHEN starts_with(origin, 'r2.') AND "end" = 'n3' THEN 'divergent' WHEN starts_with(origin, 'r4.') AND "end" = 'n7' THEN 'allowed' WHEN "end" IN (SELECT package FROM u) THEN 'convergent' ELSE 'divergent' END AS kind
    FROM t WHERE (starts_with(origin, 'r2.') AND "end" = 'n3') OR "end" NOT IN ('n3', 'n5')""",
)
def compare_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir)
    package = F.element_at(F.split("end", r"\."), 2)
    used = rows.where((F.col("year") == 1995) & F.startswith("origin", F.lit("r1."))).select(package.alias("package"))
    return edges.compare_packages(used, rows.withColumn("end", package), ignore=["n3", "n5"], allow=[("r4", "n7")], forbid=[("r2", "n3")], by=["year"])


@query(
    "compare_instances",
    _EDGES_SQL
    + """, t AS (SELECT DISTINCT origin, "end" || '.C' AS "end", "end" AS home FROM g WHERE year = 1996), r AS (SELECT DISTINCT origin, "end" || '.C' AS "end" FROM g WHERE year = 1999)
    SELECT origin, "end", CASE WHEN t.home IS NULL THEN 'absent' WHEN starts_with(origin, 'r0.') AND starts_with(t.home, 'r1.') THEN 'divergent' WHEN starts_with(origin, 'r2.') AND "end" = 'r3.n7.C' THEN 'allowed' WHEN r.origin IS NOT NULL THEN 'convergent' ELSE 'divergent' END AS kind
    FROM t FULL JOIN r USING (origin, "end")""",
)
def compare_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir)
    made = rows.select("year", "origin", F.concat("end", F.lit(".C")).alias("end"))
    year = lambda df, y: df.where(F.col("year") == y).select("origin", "end")
    modules = rows.select(F.col("end").alias("module")).union(rows.select("origin")).distinct()
    return edges.compare_instances(year(made, 1999), year(made, 1996), year(rows, 1999), modules, allow=[("r2", "r3.n7")], forbid=[("r0", "r1")])


@query(
    "module_edges",
    """WITH m AS (SELECT n_nationkey AS k, 'r' || n_regionkey AS region, 'r' || n_regionkey || '.n' || n_nationkey AS name FROM nation),
         i AS (SELECT o_orderpriority AS project, a.name AS importer, CASE WHEN l_linenumber % 2 = 0 THEN b.region ELSE b.name || '.thing' END AS imported, CASE WHEN l_linenumber % 2 = 0 THEN b.region ELSE b.name END AS module,
                      c_mktsegment AS path, l_linenumber AS lineno, l_linestatus = 'O' AS tc
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN m a ON a.k = c_nationkey JOIN m b ON b.k = s_nationkey),
         k AS (SELECT * FROM i WHERE NOT tc AND module <> importer AND NOT (module = imported AND EXISTS (SELECT 1 FROM i j WHERE j.project = i.project AND j.importer = i.importer AND j.path = i.path AND j.lineno = i.lineno AND starts_with(j.module, i.module || '.'))))
    SELECT project, importer AS origin, module AS "end", min_by(path || ':' || lineno, (path, lineno, imported)) AS cause FROM k GROUP BY ALL""",
)
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as import statements: even lines import a region, odd ones a thing of a nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("region"), F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_linestatus").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    lines = lines.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    lines = lines.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("name").alias("importer")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("region").alias("_r"), F.col("name").alias("_n")), "s_nationkey")
    imports = lines.select(
        F.col("o_orderpriority").alias("project"), "importer", F.when(F.col("l_linenumber") % 2 == 0, F.col("_r")).otherwise(F.concat("_n", F.lit(".thing"))).alias("imported"),
        F.col("c_mktsegment").alias("path"), F.col("l_linenumber").alias("lineno"), (F.col("l_linestatus") == "O").alias("in_type_checking"),
    )
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project")).distinct()
    modules = projects.join(nation.select("name").union(nation.select("region")).distinct().withColumnRenamed("name", "module"))
    return module_graph.module_edges(imports, modules)


# ---- matching


_ENTITIES_SQL = """
    WITH e AS (SELECT p_type AS project, p_type || ':' || p_brand || ':' || p_name AS id, 'function' AS kind, replace(lower(p_brand), '#', '.') AS module, replace(p_name, ' ', '_') AS name,
                      'p0-a' || length(p_name) || '-v0-k0-w0-d' || (CAST(replace(p_brand, 'Brand#', '') AS INT) % 5) || '-kd0' AS key, count(*) AS n, max(p_size) AS m FROM part GROUP BY ALL),
         s AS (SELECT * FROM e WHERE project = 'ECONOMY'), t AS (SELECT * FROM e WHERE project <> 'ECONOMY'),
         x AS (SELECT t.project, s.id AS source_id, t.id AS target_id, s.name AS s_name, t.name AS t_name, s.module AS s_module, t.module AS t_module, s.key AS s_key, t.key AS t_key,
                      (least(s.n, t.n) + least(s.m, t.m)) / (greatest(s.n, t.n) + greatest(s.m, t.m)) AS ast, CASE WHEN s.module = t.module THEN 1.0 ELSE 0.5 END AS mod, CASE WHEN s.module = t.module THEN 0 ELSE 2 END AS distance FROM s JOIN t ON s.kind = t.kind)
"""


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of one type as the reference's functions, those of each other type as a submission's."""
    rows = table(spark, sf_dir, "part").groupBy("p_type", "p_brand", "p_name").agg(F.count("*").alias("n"), F.max("p_size").cast("long").alias("m"))
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    name, zero = F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(0)
    out = rows.select(
        F.col("p_type").alias("project"), F.concat_ws(":", "p_type", "p_brand", "p_name").alias("canonical_id"), F.lit("function").alias("kind"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(".")).alias("module"), name.alias("qualname"), name.alias("name"),
        C.signature_key(zero, F.length("p_name"), zero, zero, zero, brand % 5, zero).alias("signature_key"), F.create_map(F.lit("n"), "n", F.lit("m"), "m").alias("bag"), F.lit("").alias("docstring"),
    )
    return out.where("project = 'ECONOMY'").drop("project"), out.where("project <> 'ECONOMY'")


@query("match_exact", _ENTITIES_SQL + "SELECT project, source_id, min(target_id) AS target_id FROM x WHERE s_module = t_module AND s_name = t_name AND s_key = t_key GROUP BY ALL HAVING count(*) = 1")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_pairs(*_entities(spark, sf_dir))


@query("match_explicit", _ENTITIES_SQL + """SELECT t.project, s.id AS source_id, min(t.id) AS target_id FROM s JOIN t ON t.module = 'brand.7' AND t.name = s.name AND t.kind = s.kind AND t.key = s.key WHERE s.module = 'brand.2' GROUP BY ALL HAVING count(*) = 1""")
def match_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one module are said to be in another one."""
    sources, targets = _entities(spark, sf_dir)
    explicit = sources.where("module = 'brand.2'").select(F.col("canonical_id").alias("source_id"), F.lit("brand.7").alias("module"), "qualname", "kind", "signature_key")
    return matching.explicit_pairs(sources, targets, explicit)


_STRUCTURAL_SQL = _ENTITIES_SQL + """, c AS (SELECT *, round(0.70 * ast + 0.30 * mod, 6) AS confidence FROM x WHERE s_key = t_key),
         k AS (SELECT *, row_number() OVER (PARTITION BY project, source_id ORDER BY confidence DESC, mod DESC, distance, target_id) AS rank FROM c)
"""


@query("match_structural", _STRUCTURAL_SQL + "SELECT project, source_id, target_id, confidence, rank FROM k WHERE rank <= 5")
def match_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.structural_candidates(*_entities(spark, sf_dir))
    return selection.top_k(found, ["project", "source_id"], matching._rank(), 5).select("project", "source_id", "target_id", "confidence", "rank")


@query(
    "match_fuzzy",
    _STRUCTURAL_SQL
    + """, d AS (SELECT project, source_id, target_id FROM k WHERE rank <= 3 UNION SELECT project, source_id, target_id FROM x WHERE s_name = t_name)
    SELECT project, source_id, target_id, greatest(round(0.55 * round(0.70 * ast + 0.30 * mod, 6) + 0.30 * (1.0 - levenshtein(s_name, t_name) / greatest(length(s_name), length(t_name))), 6), 0.0) AS confidence FROM x JOIN d USING (project, source_id, target_id)""",
)
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets = _entities(spark, sf_dir)
    seeds = selection.top_k(matching.structural_candidates(sources, targets), ["project", "source_id"], matching._rank(), 3)
    return matching.fuzzy_candidates(sources, targets, seeds).select("project", "source_id", "target_id", "confidence")


@query(
    "match_claims",
    _STRUCTURAL_SQL + "SELECT project, target_id, max_by(source_id, (confidence, source_id)) AS source_id FROM k WHERE rank = 1 GROUP BY ALL",
)
def match_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.structural_candidates(*_entities(spark, sf_dir))
    return matching.claims(selection.top_k(found, ["project", "source_id"], matching._rank(), 1))


@query("match_required_names", _STRUCTURAL_SQL + "SELECT project, source_id, target_id FROM k WHERE s_name = t_name")
def match_required_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets = _entities(spark, sf_dir)
    return matching.required_names(matching.structural_candidates(sources, targets).select("project", "source_id", "target_id"), sources, targets)


# ---- summaries and verdicts


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("target"), F.concat(F.lit("rule@"), F.dayofmonth("ts")).alias("rule_id"), F.when(status == "error", "FAILED").when(status == "purchase", "ERROR").when(status == "view", "SKIPPED").otherwise("OK").alias("status"),
        F.when(F.col("value") >= 20, F.array("props")).otherwise(F.array().cast("array<string>")).alias("facts"), "ts", "event_id",
    )


_RESULTS_SQL = """
    WITH r AS (SELECT user_id AS target, 'rule@' || day(ts) AS rule_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'ERROR' WHEN 'view' THEN 'SKIPPED' ELSE 'OK' END AS status, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS facts, ts, event_id FROM events)
"""


@query("matching_summary", _RESULTS_SQL + "SELECT rule_id, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'SKIPPED') AS skipped FROM r GROUP BY 1")
def matching_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status_pivot(_results(spark, sf_dir), ["OK", "FAILED", "ERROR", "SKIPPED"], ["rule_id"])


@query("count_unverified", _RESULTS_SQL + "SELECT target, count(*) FILTER (status IN ('SKIPPED', 'ERROR')) AS n FROM r GROUP BY 1")
def count_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.count_where(_results(spark, sf_dir), F.col("status").isin("SKIPPED", "ERROR"), ["target"])


@query("first_problem_names", _RESULTS_SQL + """, f AS (SELECT target, rule_id, min((ts, event_id)) AS seen FROM r WHERE status IN ('FAILED', 'ERROR') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seen, rule_id) AS n FROM f)
    SELECT target, array_to_string(list(rule_id ORDER BY n) FILTER (n <= 4), ',') AS names, count(*) AS total FROM k GROUP BY 1""")
def first_problem_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).where(F.col("status").isin(*summary.VIOLATIONS))
    return summary.first_names(rows, ["target"], "rule_id", ["ts", "event_id"], 4).withColumn("names", F.array_join("names", ","))


@query(
    "not_judged_reason",
    _RESULTS_SQL
    + """, k AS (SELECT rule_id, target, count(*) FILTER (status = 'ERROR') AS e, count(*) FILTER (status = 'FAILED' AND facts = 0) AS b, count(*) FILTER (status <> 'SKIPPED') AS j FROM r GROUP BY ALL)
    SELECT rule_id, target, CASE WHEN e > 0 THEN 'error' WHEN b > 0 THEN 'failed_without_facts' ELSE 'nothing_judged' END AS reason FROM k WHERE e > 0 OR b > 0 OR j = 0""",
)
def not_judged_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.not_judged_reason(_results(spark, sf_dir), ["rule_id", "target"])


@query(
    "verdict_counts",
    _RESULTS_SQL
    + """, v AS (SELECT rule_id, target, CASE WHEN bool_or(status = 'FAILED') THEN 'failed' WHEN bool_or(status = 'ERROR') THEN 'not_judged' ELSE 'passed' END AS verdict FROM r GROUP BY ALL)
    SELECT verdict, n, ordinal FROM (VALUES ('passed', 0), ('failed', 1), ('not_judged', 2)) o(verdict, ordinal) JOIN LATERAL (SELECT count(*) AS n FROM v WHERE v.verdict = o.verdict) ON true""",
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("key", F.struct("rule_id", "target"))
    return summary.verdict_counts(summary.verdicts(rows, "key", F.col("status") == "FAILED", F.col("status") == "ERROR"))


@query(
    "global_status",
    """SELECT c_custkey, CASE WHEN n = 0 THEN 'not_applied' WHEN f > 0 THEN 'violated' WHEN p > 0 OR t < 100000 OR u > 4 OR l > 2 OR c_acctbal < 0 THEN 'unverified' ELSE 'ok' END AS status,
              CASE WHEN n = 0 THEN 'no_role' WHEN f > 0 THEN 'findings' WHEN p > 0 THEN 'not_judged' WHEN t < 100000 THEN 'coverage' WHEN u > 4 THEN 'mutants' WHEN l > 2 THEN 'dropped' WHEN c_acctbal < 0 THEN 'disputed' ELSE '' END AS reason
       FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS f, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AS p,
                    coalesce(max(o_totalprice), 0) AS t, count(*) FILTER (o_orderpriority = '2-HIGH') AS u, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""",
)
def global_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda c: F.count_if(c)
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), when((s == "F") & (p == "1-URGENT")).alias("f"), when((s == "P") & (p == "5-LOW")).alias("p"), F.max("o_totalprice").alias("t"), when(p == "2-HIGH").alias("u"), when(p == "3-MEDIUM").alias("l")
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(orders, "c_custkey", "left").fillna(0, ["n", "f", "p", "t", "u", "l"])
    verdict = summary.global_status(F.col("n") > 0, F.col("f"), F.col("p"), F.col("t") >= 100000, F.greatest(F.col("u") - 4, F.lit(0)), F.greatest(F.col("l") - 2, F.lit(0)), (F.col("c_acctbal") < 0).cast("int"))
    return rows.select("c_custkey", verdict.alias("v")).select("c_custkey", "v.status", "v.reason")


@query(
    "most_specific_error",
    """WITH f AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders), c AS (SELECT * FROM (VALUES ('any_failed', 'F', NULL, 1, 0), ('urgent', NULL, '1-URGENT', 1, 1), ('urgent_failed', 'F', '1-URGENT', 2, 2), ('low_failed', 'F', '5-LOW', 2, 3), ('pending', 'P', NULL, 1, 4)) v(error, cs, cp, keys, ordinal))
    SELECT o_orderkey, error FROM (SELECT o_orderkey, error, row_number() OVER (PARTITION BY o_orderkey ORDER BY keys DESC, ordinal) AS n FROM f JOIN c ON (cs IS NULL OR cs = s) AND (cp IS NULL OR cp = p)) WHERE n = 1""",
)
def most_specific_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts against a small catalogue of errors, each a map of keys that must agree."""
    entries = [("any_failed", {"status": "F"}), ("urgent", {"priority": "1-URGENT"}), ("urgent_failed", {"status": "F", "priority": "1-URGENT"}), ("low_failed", {"status": "F", "priority": "5-LOW"}), ("pending", {"status": "P"})]

    def entry(k: int, error: str, keys: dict[str, str]) -> Column:
        signature = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
        return F.when(C.signature_fits("fact", signature), F.struct(F.lit(error).alias("error"), F.lit(len(keys)).alias("keys"), F.lit(k).alias("ordinal")))

    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("fact"))
    hits = facts.select("o_orderkey", F.explode(F.array_compact(F.array(*[entry(k, *e) for k, e in enumerate(entries)]))).alias("h")).select("o_orderkey", "h.*")
    return summary.most_specific(hits, ["o_orderkey"])


@query(
    "case_coverage",
    """WITH x AS (SELECT DISTINCT p_type AS target, p_brand || '/' || p_size AS line FROM part), y AS (SELECT DISTINCT p_type AS target, p_brand || '/' || p_size AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45)
    SELECT target, count(*) AS lines, count(y.line) AS run, round(count(y.line) / count(*), 9) AS ratio FROM x LEFT JOIN y USING (target, line) GROUP BY 1""",
)
def case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("line")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("target"), line)
    ran = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return summary.case_coverage(part.select("target", "line"), part.join(ran, "p_partkey").select("target", "line")).withColumn("ratio", F.round("ratio", 9))


@query("first_mutants", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def first_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_in_order(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20)


@query("first_seen", _RESULTS_SQL + "SELECT target, rule_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY target, rule_id ORDER BY ts, event_id) AS n FROM r) WHERE n = 1 GROUP BY 1, 2")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.first_seen(_results(spark, sf_dir), ["target", "rule_id"], ["ts", "event_id"]).select("target", "rule_id", "event_id")
