"""Queries about orders of inheritance, chains of aliases, values along control flow, path counts and turns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structura.catalog import _EDGES_SQL, _nation_edges, query, table
from structura.operators import aliases, dataflow, linearize, paths, selection

# ---- inheritance


#: Parts as classes: a part inherits from its brand, its type and their mix, in three orders, one of which contradicts the mix.
_CLASSES_SQL = """
    p AS (SELECT 'part' || p_partkey AS class, p_brand AS brand, 'type ' || p_type AS kind, p_brand || ' ' || p_type AS mix, p_size % 3 AS shape FROM part),
    b AS (SELECT DISTINCT class, CASE shape WHEN 0 THEN [kind, brand] WHEN 1 THEN [mix, kind] ELSE [brand, mix] END AS bases, 3 AS level FROM p
          UNION SELECT DISTINCT mix, [brand, kind], 2 FROM p
          UNION SELECT DISTINCT brand, ['made', 'named'], 1 FROM p
          UNION SELECT DISTINCT kind, ['named'], 1 FROM p)
"""


def _mro_sql(levels: int = 3) -> str:
    """A merge for each level of classes: lists lose the first head that is in no tail until none is left."""
    out = f"WITH RECURSIVE {_CLASSES_SQL}, o0 AS (SELECT 'made' AS class, ['made'] AS mro UNION ALL SELECT 'named', ['named'])"
    for k in range(1, levels + 1):
        out += f""",
    s{k} AS (SELECT x.class, list(mro ORDER BY place) || [any_value(bases)] AS lists FROM (SELECT class, bases, unnest(bases) AS base, generate_subscripts(bases, 1) AS place FROM b WHERE level = {k}) x JOIN o{k - 1} o ON o.class = x.base GROUP BY x.class),
    m{k} AS (SELECT class, lists AS rest, []::VARCHAR[] AS done FROM s{k}
             UNION ALL
             SELECT class, list_filter(list_transform(rest, lambda x: CASE WHEN x[1] = head THEN x[2:] ELSE x END), lambda x: len(x) > 0), list_append(done, head)
             FROM (SELECT *, list_filter(list_transform(rest, lambda x: x[1]), lambda h: len(list_filter(rest, lambda x: list_position(x, h) > 1)) = 0)[1] AS head FROM m{k} WHERE len(rest) > 0) WHERE head IS NOT NULL),
    o{k} AS (SELECT * FROM o{k - 1} UNION ALL SELECT class, [class] || done FROM m{k} WHERE len(rest) = 0)"""
    return out


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part"), "p_partkey").alias("class"), F.col("p_brand").alias("brand"), F.concat(F.lit("type "), "p_type").alias("kind"), F.concat("p_brand", F.lit(" "), "p_type").alias("mix"), (F.col("p_size") % 3).alias("shape")
    )
    own = p.select("class", F.when(F.col("shape") == 0, F.array("kind", "brand")).when(F.col("shape") == 1, F.array("mix", "kind")).otherwise(F.array("brand", "mix")).alias("bases"))
    more = [p.select(F.col("mix").alias("class"), F.array("brand", "kind").alias("bases")), p.select("brand", F.array(F.lit("made"), F.lit("named"))), p.select("kind", F.array(F.lit("named")))]
    for m in more:
        own = own.union(m.distinct())
    return own.select("class", F.posexplode("bases").alias("place", "base"))


@query("mro_linearization", _mro_sql() + " SELECT c.class, CASE WHEN o.mro IS NULL THEN 'inconsistent' ELSE 'ok' END AS status, array_to_string(o.mro, ' > ') AS mro FROM (SELECT class FROM b UNION SELECT unnest(bases) FROM b) c LEFT JOIN o3 o USING (class)")
def mro_linearization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class's resolution order, or that it has none."""
    return linearize.linearize(_classes(spark, sf_dir)).withColumn("mro", F.array_join("mro", " > "))


_MEMBERS = {"made": ("maker", "price"), "named": ("name", "label")}


@query(
    "members_by_mro",
    _mro_sql()
    + """, members AS (SELECT 'made' AS holder, unnest(['maker', 'price']) AS name UNION ALL SELECT 'named', unnest(['name', 'label'])
                       UNION ALL SELECT DISTINCT brand, unnest(['price', 'name']) FROM (SELECT DISTINCT brand FROM p)
                       UNION ALL SELECT kind, unnest(['label', 'price']) FROM (SELECT DISTINCT kind FROM p) UNION ALL SELECT mix, 'label' FROM (SELECT DISTINCT mix FROM p)),
         looked AS (SELECT class, unnest(mro) AS holder, generate_subscripts(mro, 1) - 1 AS place FROM o3)
    SELECT class, name, holder, CAST(place AS INT) AS place FROM looked JOIN members USING (holder) QUALIFY row_number() OVER (PARTITION BY class, name ORDER BY place) = 1
    """,
)
def members_by_mro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class gives each member that a class has."""
    bases = _classes(spark, sf_dir)
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("type "), "p_type").alias("kind"), F.concat("p_brand", F.lit(" "), "p_type").alias("mix"))
    holders = [(own.select(F.col("brand").alias("holder")), ("price", "name")), (own.select(F.col("kind").alias("holder")), ("label", "price")), (own.select(F.col("mix").alias("holder")), ("label",))]
    members = spark.createDataFrame([(h, n) for h, names in _MEMBERS.items() for n in names], "holder string, name string")
    for rows, names in holders:
        members = members.union(rows.distinct().select("holder", F.explode(F.array(*[F.lit(n) for n in names]))))
    return linearize.found_first(linearize.linearize(bases), members).select("class", "name", "holder", "place")


# ---- aliases


@query(
    "alias_chains",
    """
    WITH RECURSIVE o AS (SELECT event_type, event_id, lead(event_id) OVER w AS next, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
         p AS (SELECT event_type, 'e' || event_id AS name, CASE WHEN next IS NOT NULL THEN 'e' || next WHEN event_type = 'error' THEN 'e' || first ELSE 'end of ' || event_type END AS target FROM o),
         r AS (SELECT event_type, name, target AS final, 1::BIGINT AS hops FROM p WHERE target LIKE 'end of %'
               UNION ALL SELECT p.event_type, p.name, r.final, r.hops + 1 FROM r JOIN p ON p.event_type = r.event_type AND p.target = r.name)
    SELECT event_type, name, r.final, r.hops, r.final IS NULL AS cyclic FROM p LEFT JOIN r USING (event_type, name)
    """,
)
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event stands for the next one of its type, the last one for an end, or (errors) for the first again."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.lead("event_id").over(w).alias("next"), F.first("event_id").over(w).alias("first"))
    name = lambda c: F.concat(F.lit("e"), c)
    target = F.when(F.col("next").isNotNull(), name("next")).when(F.col("event_type") == "error", name("first")).otherwise(F.concat(F.lit("end of "), "event_type"))
    return aliases.follow(e.select("event_type", name("event_id").alias("name"), target.alias("target")), ["event_type"])


# ---- values along control flow


#: Orders as statements of their customer's program: each sets its status, and goes on to the next one and to the next of its priority.
_FLOW_SQL = """
    s AS (SELECT o_custkey AS program, o_orderkey AS node, o_orderstatus AS variable, o_orderpriority AS how,
                 lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
    e AS (SELECT program, node AS origin, a AS "end" FROM s WHERE a IS NOT NULL UNION SELECT program, node, b FROM s WHERE b IS NOT NULL),
    r AS (SELECT s.program, e."end" AS node, variable, s.node AS definition FROM s JOIN e ON e.program = s.program AND e.origin = s.node
          UNION SELECT r.program, e."end", r.variable, r.definition FROM r JOIN s ON s.program = r.program AND s.node = r.node JOIN e ON e.program = r.program AND e.origin = r.node WHERE s.variable <> r.variable)
"""


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = ("o_orderdate", "o_orderkey")
    s = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("program"), F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("variable"), F.col("o_orderpriority").alias("how"),
        F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(*order)).alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*order)).alias("b"),
    )
    return s, s.select("program", F.col("node").alias("origin"), F.explode(F.array_compact(F.array("a", "b"))).alias("end")).distinct()


@query("reaching_definitions", f"WITH RECURSIVE {_FLOW_SQL} SELECT program, node, variable, definition FROM r")
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, edges = _flow(spark, sf_dir)
    return dataflow.reaching(edges, s.select("program", "node", "variable"), ["program"])


@query(
    "type_tests_deciding",
    f"""WITH RECURSIVE {_FLOW_SQL}, d AS (SELECT DISTINCT r.program, r.definition AS node FROM r JOIN s USING (program, node) WHERE s.how = '1-URGENT' AND s.variable = r.variable)
    SELECT program, node, EXISTS (SELECT 1 FROM d WHERE d.program = s.program AND d.node = s.node) AS branches FROM s WHERE how = '2-HIGH'
    UNION ALL SELECT program, node, true FROM s WHERE how = '5-LOW'""",
)
def type_tests_deciding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High orders keep a type test's outcome that urgent ones of the same status branch on; low ones branch at once."""
    s, edges = _flow(spark, sf_dir)
    kept = s.where("how = '2-HIGH'").select("program", "node", "variable")
    at_once = s.where("how = '5-LOW'").select("program", "node", F.lit(None).cast("string").alias("variable"))
    branches = s.where("how = '1-URGENT'").select("program", "node", "variable").unionByName(at_once)
    return dataflow.deciding(edges, kept.unionByName(at_once), s.select("program", "node", "variable"), branches, ["program"]).select("program", "node", "branches")


# ---- paths


@query(
    "path_counts_forbidden",
    "WITH RECURSIVE "
    + _EDGES_SQL.strip().removeprefix("WITH ")
    + """, own AS (SELECT year, origin, "end" FROM g WHERE origin < "end" AND NOT starts_with("end", 'r2.')),
         w AS (SELECT year, origin AS start, origin AS node, 1::HUGEINT AS n FROM (SELECT DISTINCT year, origin FROM own WHERE starts_with(origin, 'r0.'))
               UNION ALL SELECT w.year, w.start, o."end", sum(w.n)::HUGEINT FROM w JOIN own o ON o.year = w.year AND o.origin = w.node WHERE NOT starts_with(w.node, 'r3.') GROUP BY ALL)
    SELECT year, start, node AS target, 'r3' AS prefix, sum(n)::DECIMAL(38, 0) AS paths FROM w WHERE starts_with(node, 'r3.') GROUP BY ALL
    """,
)
def path_counts_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paths lead from nations of r0 to those of r3, around r2, along edges to greater names, of all years."""
    rows = _nation_edges(spark, sf_dir).where("origin < end")
    roots = rows.where(F.startswith("origin", F.lit("r0."))).select("year", F.col("origin").alias("start")).distinct()
    return paths.path_counts(rows, roots, ["r3"], ["r2"], by=["year"])


@query(
    "shortest_forbidden_paths",
    "WITH RECURSIVE "
    + _EDGES_SQL.strip().removeprefix("WITH ")
    + """, own AS (SELECT year, origin, "end" FROM g WHERE NOT starts_with("end", 'r2.') AND NOT (starts_with(origin, 'r0.') AND starts_with("end", 'r3.'))),
         w AS (SELECT DISTINCT year, origin AS start, origin AS node, 0 AS steps FROM own WHERE starts_with(origin, 'r0.')
               UNION SELECT w.year, w.start, o."end", w.steps + 1 FROM w JOIN own o ON o.year = w.year AND o.origin = w.node WHERE NOT starts_with(w.node, 'r3.') AND w.steps < 25)
    SELECT year, start, node AS target, CAST(min(steps) AS INT) AS steps FROM w WHERE starts_with(node, 'r3.') GROUP BY ALL
    """,
)
def shortest_forbidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a shortest path from r0 to each nation of r3 is that isn't a single step, around r2, over all edges of all years."""
    rows = _nation_edges(spark, sf_dir).where("not (startswith(origin, 'r0.') and startswith(end, 'r3.'))")
    roots = rows.where(F.startswith("origin", F.lit("r0."))).select("year", F.col("origin").alias("start")).distinct()
    return paths.shortest_paths(rows, roots, ["r3"], ["r2"], by=["year"]).select("year", "start", "target", (F.size("path") - 1).alias("steps"))


# ---- turns


@query(
    "round_robin_repeats",
    """
    WITH RECURSIVE m AS (SELECT 'lang ' || lang AS kind, doc_id FROM documents WHERE lang IS NOT NULL UNION SELECT 'source ' || source, doc_id FROM documents WHERE source IS NOT NULL UNION SELECT 'size ' || n_chars % 3, doc_id FROM documents WHERE n_chars IS NOT NULL),
         g AS (SELECT kind, list(doc_id ORDER BY doc_id)[1:200] AS ids FROM m GROUP BY kind),
         a AS (SELECT list(kind ORDER BY kind) AS kinds, list(ids ORDER BY kind) AS ids FROM g),
         t AS (SELECT 0 AS i, []::BIGINT[] AS taken, NULL::VARCHAR AS kind, NULL::BIGINT AS doc_id
               UNION ALL SELECT i + 1, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, k, x
               FROM (SELECT i, taken, kinds[i % len(kinds) + 1] AS k, list_filter(ids[i % len(kinds) + 1], lambda d: NOT list_contains(taken, d))[1] AS x FROM t, a WHERE len(taken) < 200 AND i < 20000))
    SELECT kind, doc_id, CAST(row_number() OVER (ORDER BY i) AS INT) AS turn FROM t WHERE doc_id IS NOT NULL
    """,
)
def round_robin_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 documents taken in turn by languages, sources and sizes, none twice: a document is in three groups."""
    d = table(spark, sf_dir, "documents")
    kinds = [F.concat(F.lit("lang "), "lang"), F.concat(F.lit("source "), "source"), F.concat(F.lit("size "), F.col("n_chars") % 3)]
    rows = d.select("doc_id", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    return selection.in_turn_once(rows, "kind", ["doc_id"], "doc_id", 200).select("kind", "doc_id", "turn")
