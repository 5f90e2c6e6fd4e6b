"""Queries over recorded events, with their SQL: the driver's tables read as what submissions did while they ran.

Order lines are calls: a customer's market segment and the order's priority make the submission, the order's year the case,
the customer's nation calls the supplier's. Events of users are what objects showed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.catalog import query, table
from structura.operators import flow, runtime

#: The submission whose run is the reference.
MODEL = "BUILDING/1-URGENT"

_CALLS_SQL = """
    WITH m AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '.n' || n_nationkey AS name, 'r' || n_regionkey AS region FROM nation),
         c AS (SELECT c_mktsegment || '/' || o_orderpriority AS project, 'y' || year(o_orderdate) AS "case", a.name AS caller, b.name AS callee,
                      CASE WHEN l_linenumber > 4 THEN '_f' ELSE 'f' END || l_linenumber AS function, CASE WHEN l_returnflag = 'R' THEN [a.region] END AS via,
                      l_returnflag, l_linestatus, l_partkey
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
               JOIN m a ON a.k = c_nationkey JOIN m b ON b.k = s_nationkey)
"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("region"), F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.concat(F.lit("y"), F.year("o_orderdate")).alias("case"))
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("name").alias("caller"), F.col("region").alias("_r")), "c_nationkey")
    rows = rows.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("name").alias("callee")), "s_nationkey")
    return rows.select(
        F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("project"), "case", "caller", "callee",
        F.concat(F.when(F.col("l_linenumber") > 4, "_f").otherwise("f"), "l_linenumber").alias("function"), F.when(F.col("l_returnflag") == "R", F.array("_r")).alias("via"),
        "l_returnflag", "l_linestatus", "l_partkey",
    )


def _edges(calls: DataFrame) -> DataFrame:
    return calls.select("project", "case", F.col("caller").alias("origin"), F.col("callee").alias("end")).where("origin <> end")


def _model(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("project") == MODEL).drop("project")


_E = _CALLS_SQL + """, e AS (SELECT DISTINCT project, "case", caller AS origin, callee AS "end" FROM c WHERE caller <> callee)"""
_RECURSIVE = "WITH RECURSIVE " + _E.strip().removeprefix("WITH ")


@query(
    "runtime_calls_required",
    _CALLS_SQL
    + """SELECT project, "case", module FROM (SELECT DISTINCT project, "case" FROM c) k, (VALUES ('r1.n1'), ('r3.n3'), ('r2.n12')) v(module)
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project = k.project AND c."case" = k."case" AND (c.callee = module OR starts_with(c.callee, module || '.')))""",
)
def runtime_calls_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    return runtime.missing_calls(calls, calls, ["r1.n1", "r3.n3", "r2.n12"])


@query(
    "runtime_calls_forbidden",
    _CALLS_SQL
    + """SELECT DISTINCT project, "case", caller, callee FROM c WHERE (callee = 'r2' OR starts_with(callee, 'r2.')) AND callee <> 'r2.n12' AND NOT coalesce(list_contains(via, 'r1'), false)""",
)
def runtime_calls_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.forbidden_calls(_calls(spark, sf_dir).drop("function"), ["r2"], allow=["r2.n12"], through=["r1"], transitive=True)


@query(
    "runtime_instances",
    _CALLS_SQL
    + """, i AS (SELECT project, "case", caller AS creator, callee || '.' || replace(p_brand, '#', '') AS class, p_brand, l_returnflag = 'R' AS kin FROM c JOIN part ON l_partkey = p_partkey),
         n AS (SELECT DISTINCT project, class, replace(class, 'Brand', 'Model') AS reference_class FROM i WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')),
         k AS (SELECT i.*, reference_class, coalesce(reference_class, i.class) AS named FROM i LEFT JOIN n USING (project, class))
    SELECT DISTINCT project, "case", creator, named AS class FROM k WHERE starts_with(named, 'r1.') AND NOT named = 'r1.n1.Model2' AND (reference_class IS NOT NULL OR kin)""",
)
def runtime_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    made = _calls(spark, sf_dir).join(part, "l_partkey").select(
        "project", "case", F.col("caller").alias("creator"), F.concat("callee", F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("class"), "p_brand", (F.col("l_returnflag") == "R").alias("kin")
    )
    names = made.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("project", "class", F.replace("class", F.lit("Brand"), F.lit("Model")).alias("reference_class")).distinct()
    return runtime.forbidden_instances(made, names, ["r1"], allow=["r1.n1.Model2"])


@query(
    "runtime_reference_calls",
    _E
    + f""", r AS (SELECT "case", origin, "end" FROM e WHERE project = '{MODEL}'), q AS (SELECT DISTINCT project, "case" FROM e),
         w AS (SELECT q.project, r."case", r.origin, r."end" FROM q JOIN r ON q."case" = r."case")
    SELECT *, 'extra' AS kind FROM (SELECT project, "case", origin, "end" FROM e EXCEPT SELECT project, "case", origin, "end" FROM w)
    UNION ALL SELECT *, 'missing' AS kind FROM (SELECT project, "case", origin, "end" FROM w EXCEPT SELECT project, "case", origin, "end" FROM e)""",
)
def runtime_reference_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(_calls(spark, sf_dir))
    return runtime.reference_calls(_model(rows), rows, require_all=True)


@query(
    "runtime_module_interface",
    _CALLS_SQL + """SELECT DISTINCT project, "case", caller, callee, function FROM c WHERE starts_with(callee, 'r1.') AND NOT starts_with(caller, 'r1.') AND starts_with(function, '_')""",
)
def runtime_module_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.module_interface_calls(_calls(spark, sf_dir), "r1")


@query(
    "architecture_runtime",
    _E
    + f""", r AS (SELECT DISTINCT origin, "end" FROM e WHERE project = '{MODEL}'), t AS (SELECT project, origin, "end", min("case") AS "case" FROM e GROUP BY ALL)
    SELECT project, t.origin, t."end", t."case", CASE WHEN starts_with(t.origin, 'r0.') AND starts_with(t."end", 'r1.') THEN 'divergent' WHEN starts_with(t.origin, 'r2.') AND starts_with(t."end", 'r3.') THEN 'allowed'
           WHEN r.origin IS NOT NULL THEN 'convergent' ELSE 'divergent' END AS kind FROM t LEFT JOIN r USING (origin, "end")
    UNION ALL SELECT q.project, r.origin, r."end", NULL, 'absent' FROM (SELECT DISTINCT project FROM t) q, r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.project = q.project AND t.origin = r.origin AND t."end" = r."end")""",
)
def architecture_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(_calls(spark, sf_dir))
    return runtime.architecture_runtime(_model(rows).select("origin", "end"), rows, require_all=True, allow=[("r2", "r3")], forbid=[("r0", "r1")])


@query(
    "runtime_layers",
    _E
    + f""", x AS (SELECT DISTINCT project, origin, "end", split_part(origin, '.', 1) AS a, split_part("end", '.', 1) AS b FROM e),
         v AS (SELECT project, CASE WHEN a IN ('r1', 'r2') AND b IN ('r1', 'r2') THEN 'sibling' WHEN (b = 'r0' AND a <> 'r0') OR (a = 'r3' AND b <> 'r3') THEN 'upward' WHEN a = 'r0' AND b = 'r3' THEN 'skip' END AS kind,
                      a AS origin_layer, b AS target_layer, origin || ' -> ' || "end" AS path FROM x WHERE a <> b AND a <> 'r4' AND b <> 'r4')
    SELECT * FROM v WHERE kind IS NOT NULL AND (kind, path) NOT IN (SELECT kind, path FROM v WHERE project = '{MODEL}' AND kind IS NOT NULL)""",
)
def runtime_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(_calls(spark, sf_dir))
    return runtime.runtime_layers(rows, _model(rows), ["r0", "r1 | r2", "r3"], closed=["r1"]).withColumn("path", F.array_join("path", " -> "))


@query(
    "runtime_cycles",
    "WITH RECURSIVE "
    + _CALLS_SQL.strip().removeprefix("WITH ")
    + f""", e AS (SELECT DISTINCT project, caller AS origin, callee AS "end" FROM c WHERE caller <> callee AND l_returnflag = 'A' AND l_linestatus = 'F'),
         g AS (SELECT project, origin, "end" FROM e UNION ALL SELECT '', origin, "end" FROM e WHERE project = '{MODEL}' AND split_part(origin, '.', 1) = split_part("end", '.', 1)),
         r AS (SELECT project, origin AS a, "end" AS b FROM g UNION SELECT r.project, r.a, g."end" FROM r JOIN g ON g.project = r.project AND g.origin = r.b),
         p AS (SELECT x.project, x.a, least(x.a, min(x.b)) AS component, count(*) AS n FROM r x JOIN r y ON x.project = y.project AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.project, x.a),
         t AS (SELECT p.project, p.component, list(p.a ORDER BY p.a) AS nodes, count(h.component) AS homed, min(h.component) AS lo, max(h.component) AS hi FROM p LEFT JOIN p h ON h.project = '' AND h.a = p.a WHERE p.project <> '' GROUP BY ALL)
    SELECT project, component, array_to_string(nodes, ',') AS nodes FROM t WHERE homed < len(nodes) OR lo <> hi""",
)
def runtime_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned and filled lines only: calls of one kind."""
    rows = _edges(_calls(spark, sf_dir).where("l_returnflag = 'A' AND l_linestatus = 'F'"))
    model = _model(rows).where(F.substring_index("origin", ".", 1) == F.substring_index("end", ".", 1))
    return runtime.runtime_cycles(rows, model).withColumn("nodes", F.array_join("nodes", ","))


@query(
    "runtime_imports",
    _CALLS_SQL
    + """SELECT DISTINCT project, caller AS importer, callee AS imported, CASE WHEN starts_with(callee, 'r4.') THEN 'r4' ELSE 'r0.n0' END AS prefix FROM c
    WHERE (starts_with(callee, 'r4.') OR callee = 'r0.n0') AND callee <> 'r4.n4'""",
)
def runtime_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calls(spark, sf_dir).select("project", F.col("caller").alias("importer"), F.col("callee").alias("imported"))
    return runtime.forbidden_imports(rows, ["r4", "r0.n0"], allow=["r4.n4"])


@query(
    "runtime_writes",
    _CALLS_SQL
    + """SELECT DISTINCT project, "case", CASE WHEN l_linestatus = 'F' THEN caller END AS writer, callee AS class, function AS attribute, l_returnflag AS change FROM c
    WHERE l_linestatus <> 'F' OR split_part(caller, '.', 1) <> split_part(callee, '.', 1)""",
)
def runtime_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes are nations; those of one region are a family."""
    rows = _calls(spark, sf_dir)
    writes = rows.select("project", "case", F.when(F.col("l_linestatus") == "F", F.col("caller")).alias("writer"), F.col("callee").alias("class"), F.col("function").alias("attribute"), F.col("l_returnflag").alias("change"))
    name = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("class"))
    pairs = name.join(name.withColumnRenamed("class", "base"), "n_regionkey").select("class", "base")
    family = rows.select("project", F.col("callee").alias("class")).distinct().join(pairs, "class")
    return runtime.foreign_writes(writes, family)


@query(
    "name_translation",
    _CALLS_SQL + """SELECT project, coalesce(CASE WHEN starts_with(caller, 'r1.') THEN 'a.' || caller END, caller) AS caller, coalesce(CASE WHEN starts_with(callee, 'r1.') THEN 'a.' || callee END, callee) AS callee, count(*) AS n FROM c GROUP BY ALL""",
)
def name_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calls(spark, sf_dir).groupBy("project", "caller", "callee").agg(F.count("*").alias("n"))
    names = rows.select("project", F.col("callee").alias("target")).union(rows.select("project", "caller")).distinct().where(F.startswith("target", F.lit("r1."))).withColumn("reference", F.concat(F.lit("a."), "target"))
    return runtime.translate(rows, names, ["caller", "callee"])


# ---- events of users


_SEEN_SQL = """
    WITH s AS (SELECT 'd' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS project, CAST(user_id AS VARCHAR) AS "case", event_type AS name, CASE WHEN value >= 20 THEN 'big' ELSE 'small' END AS type, value, ts, event_id FROM events),
         b AS (SELECT project, "case", max(value) < 60 AS constructible FROM s GROUP BY ALL)
"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), F.lpad(F.dayofmonth("ts").cast("string"), 2, "0")).alias("project"), F.col("user_id").cast("string").alias("case"), F.col("event_type").alias("name"),
        F.when(F.col("value") >= 20, "big").otherwise("small").alias("type"), "value", "ts", "event_id",
    )


def _built(seen: DataFrame) -> DataFrame:
    return seen.groupBy("project", "case").agg((F.max("value") < 60).alias("constructible"))


@query(
    "runtime_members_required",
    _SEEN_SQL
    + """, h AS (SELECT DISTINCT project, "case", name, type FROM s WHERE name IN ('click', 'error'))
    SELECT project, "case", NULL AS name, 'not_constructible' AS reason FROM b WHERE NOT constructible
    UNION ALL SELECT DISTINCT b.project, b."case", n.name, CASE WHEN h.type IS NULL THEN 'missing' ELSE 'type_differs' END
    FROM b CROSS JOIN (VALUES ('click'), ('error')) n(name) LEFT JOIN h ON h.project = b.project AND h."case" = b."case" AND h.name = n.name
    WHERE constructible AND (h.type IS NULL OR (n.name = 'error' AND h.type <> 'big'))""",
)
def runtime_members_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _seen(spark, sf_dir)
    return runtime.member_violations(_built(seen), seen, ["click", "error"], {"error": "big"})


@query(
    "runtime_members_forbidden",
    _SEEN_SQL
    + """SELECT project, "case", NULL AS name, 'not_constructible' AS reason FROM b WHERE NOT constructible
    UNION ALL SELECT DISTINCT project, "case", name, 'present' FROM s JOIN b USING (project, "case") WHERE constructible AND name = 'error'""",
)
def runtime_members_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _seen(spark, sf_dir)
    return runtime.member_violations(_built(seen), seen, ["error"], forbidden=True)


@query(
    "runtime_class_kind",
    """WITH k AS (SELECT p_type AS project, p_brand AS class, list(DISTINCT p_name ORDER BY p_name) FILTER (p_size > 40) AS m FROM part GROUP BY ALL)
    SELECT project, class, array_to_string(m, ',') AS abstract_methods FROM k WHERE m IS NOT NULL AND len(m) > 0""",
)
def runtime_class_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.array_sort(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_name")))).alias("abstract_methods")
    classes = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("project"), F.col("p_brand").alias("class")).agg(left)
    return runtime.class_kind(classes, abstract=False).withColumn("abstract_methods", F.array_join("abstract_methods", ","))


@query(
    "runtime_protocol",
    _SEEN_SQL
    + """, o AS (SELECT project, "case", name, max(value > 10) AS callable, max(value > 30) AS binds FROM s GROUP BY ALL)
    SELECT b.project, b."case", n.name, CASE WHEN o.callable IS NULL THEN 'missing' WHEN must AND NOT o.callable THEN 'not_callable' ELSE 'does_not_bind' END AS reason
    FROM b CROSS JOIN (VALUES ('click', true), ('view', false)) n(name, must) LEFT JOIN o ON o.project = b.project AND o."case" = b."case" AND o.name = n.name
    WHERE o.callable IS NULL OR (must AND (NOT o.callable OR NOT o.binds))""",
)
def runtime_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _seen(spark, sf_dir)
    needed = spark.createDataFrame([("click", True), ("view", False)], "name string, callable boolean")
    return runtime.protocol_violations(seen, needed, seen.select("project", "case", "name", (F.col("value") > 10).alias("callable"), (F.col("value") > 30).alias("binds")))


@query("runtime_singleton", _SEEN_SQL + """SELECT name AS project, project AS "case", count(DISTINCT "case") AS objects FROM s GROUP BY 1, 2 HAVING count(DISTINCT "case") > 1""")
def runtime_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.singleton_violations(_seen(spark, sf_dir).select(F.col("name").alias("project"), F.col("project").alias("case"), F.col("case").alias("object")))


@query(
    "runtime_observer",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS project, event_type AS "case", CASE WHEN day(ts) < 12 THEN 'before' WHEN day(ts) < 15 THEN 'subscribed' ELSE 'unsubscribed' END AS phase, value FROM events),
         k AS (SELECT project, "case", coalesce(bool_or(phase = 'subscribed') FILTER (value >= 10), false) AS told, coalesce(bool_or(phase = 'unsubscribed') FILTER (value >= 10), false) AS late FROM s GROUP BY ALL)
    SELECT project, "case", CASE WHEN NOT told THEN 'not_notified' ELSE 'notified_after_leaving' END AS reason FROM k WHERE NOT told OR late""",
)
def runtime_observer(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("ts")
    notices = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project"), F.col("event_type").alias("case"), F.when(day < 12, "before").when(day < 15, "subscribed").otherwise("unsubscribed").alias("phase"), "value")
    return runtime.observer_violations(notices.where("value >= 10"), notices)


@query("runtime_delegation", _SEEN_SQL + """SELECT project, "case" FROM s GROUP BY ALL HAVING NOT bool_or(name = 'purchase' AND type = 'big')""")
def runtime_delegation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _seen(spark, sf_dir)
    return runtime.missing_delegation(seen.where("type = 'big'").withColumnRenamed("name", "member"), seen, "purchase")


_STAGES = ["signup", "view", "purchase"]


@query(
    "runtime_flow",
    """WITH s AS (SELECT CASE WHEN day(ts) <= 10 THEN 'm' WHEN day(ts) <= 20 THEN 'a' ELSE 'b' END AS project, CAST(user_id AS VARCHAR) AS "case", left(event_type, 1) AS stage, event_type IN ('signup', 'view', 'purchase') AS staged, ts, event_id FROM events),
         r AS (SELECT "case", list(stage ORDER BY ts, event_id) AS model FROM s WHERE project = 'm' AND staged GROUP BY ALL),
         t AS (SELECT project, "case", coalesce(string_agg(stage, '' ORDER BY ts, event_id) FILTER (staged), '') AS called FROM s GROUP BY ALL),
         j AS (SELECT project, "case", called, model, regexp_matches(called, array_to_string(model, '.*')) AS kept, model IS NULL AS none, NOT list_has_all(model, ['s', 'v', 'p']) AS missing FROM t LEFT JOIN r USING ("case"))
    SELECT project, "case", CASE WHEN none OR missing THEN 'ERROR' WHEN kept THEN 'OK' ELSE 'FAILED' END AS status,
           CASE WHEN none THEN 'reference_calls_nothing' WHEN missing THEN 'reference_misses_stage' WHEN kept THEN '' ELSE 'out_of_order' END AS reason FROM j""",
)
def runtime_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten days of a user are the reference's run, the others submissions."""
    day = F.dayofmonth("ts")
    rows = table(spark, sf_dir, "events").select(F.when(day <= 10, "m").when(day <= 20, "a").otherwise("b").alias("project"), F.col("user_id").cast("string").alias("case"), F.col("event_type").alias("stage"), "ts", "event_id")
    return runtime.runtime_flow(rows, rows.where("project = 'm'").drop("project"), _STAGES, ["ts", "event_id"])


@query(
    "unexercised_lines",
    """WITH x AS (SELECT DISTINCT p_type AS project, p_brand AS file, p_size AS line FROM part),
         y AS (SELECT DISTINCT p_type AS project, p_brand AS file, p_size AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40)
    SELECT project, file, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM (FROM x EXCEPT FROM y) GROUP BY ALL""",
)
def unexercised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("project"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    ran = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return runtime.unexercised(part, part.join(ran, "p_partkey")).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query(
    "observing_gate",
    """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'SKIPPED' WHEN o_orderstatus = 'P' THEN 'FAILED' WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' WHEN o_totalprice < 50000 AND o_orderstatus = 'F' THEN 'ERROR' WHEN o_totalprice < 50000 THEN 'FAILED' END AS status,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'dynamic_checks_disabled' WHEN o_orderstatus = 'P' THEN 'kind_mismatch' WHEN o_orderpriority = '1-URGENT' THEN 'probe_crashed' WHEN o_totalprice < 50000 AND o_orderstatus = 'F' THEN 'reference_case_invalid' WHEN o_totalprice < 50000 THEN 'case_setup_failed' END AS reason,
        count(*) AS n FROM orders GROUP BY 1, 2""",
)
def observing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    probe = F.when(priority == "1-URGENT", "crashed").otherwise("completed")
    verdict = runtime.gate(priority != "5-LOW", status != "P", probe, price >= 50000, status != "F")
    return table(spark, sf_dir, "orders").select(verdict.alias("v")).groupBy(F.col("v.status").alias("status"), F.col("v.reason").alias("reason")).agg(F.count("*").alias("n"))


@query(
    "variable_flow",
    """WITH RECURSIVE n AS (SELECT user_id AS function, day(ts) AS node, max_by(event_type, event_id) AS stage FROM events GROUP BY ALL),
         g AS (SELECT DISTINCT user_id AS function, day(ts) AS node, day(ts) + 1 + event_id % 4 AS next FROM events WHERE day(ts) < 28),
         s AS (SELECT function, min(node) AS node FROM g GROUP BY 1),
         o AS (SELECT function, node, CASE stage WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS ordinal FROM n WHERE stage IN ('signup', 'view', 'purchase')),
         r AS (SELECT s.function, s.node, CASE WHEN coalesce(ordinal, -1) = 0 THEN 1 ELSE 0 END AS progress, coalesce(ordinal, -1) > 0 AS bad FROM s LEFT JOIN o USING (function, node)
               UNION SELECT r.function, g.next, CASE WHEN coalesce(o.ordinal, -1) = r.progress THEN r.progress + 1 ELSE r.progress END, coalesce(o.ordinal, -1) > r.progress
               FROM r JOIN g ON g.function = r.function AND g.node = r.node LEFT JOIN o ON o.function = r.function AND o.node = g.next WHERE NOT r.bad)
    SELECT function, node, progress, CASE WHEN bad THEN 'out_of_order' ELSE 'stage_missing' END AS reason FROM r
    WHERE bad OR (progress < 3 AND NOT EXISTS (SELECT 1 FROM g WHERE g.function = r.function AND g.node = r.node))""",
)
def variable_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are nodes of a user's graph, an event leads to a later day, and a day's last event is its stage."""
    day = F.dayofmonth("ts")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("function"), day.alias("node"), (day + 1 + F.col("event_id") % 4).cast("int").alias("next"), "event_type", "event_id")
    edges = events.where("node < 28").select("function", "node", "next").distinct()
    stages = events.groupBy("function", "node").agg(F.max_by("event_type", "event_id").alias("stage"))
    return flow.stage_paths(edges, stages, edges.groupBy("function").agg(F.min("node").alias("node")), _STAGES, ["function"])
