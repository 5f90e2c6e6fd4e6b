"""Queries over the driver's tables and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.functions import columns as C
from structura.functions import globs
from structura.operators import edges, graph, likeness, membership, selection, summary

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "status_summary",
    "SELECT coalesce(o_orderstatus, '') AS status, coalesce(o_orderpriority, '') AS severity, count(*) AS n FROM orders GROUP BY 1, 2",
)
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.count_by(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("severity")), "status", "severity")


# ---- summaries of results


@query("top_counts", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_counts(table(spark, sf_dir, "events"), "event_type", 5)


#: Return flags as statuses and line statuses as severities: lines are results, orders their targets.
_RESULTS_SQL = """
    SELECT l_orderkey AS target, CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'WARNING' ELSE 'OK' END AS status,
           CASE l_linestatus WHEN 'F' THEN 'error' ELSE 'warning' END AS severity, l_shipdate FROM lineitem
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return lines.select(
        F.col("l_orderkey").alias("target"), F.when(flag == "R", "FAILED").when(flag == "A", "WARNING").otherwise("OK").alias("status"),
        F.when(F.col("l_linestatus") == "F", "error").otherwise("warning").alias("severity"),
    )


@query(
    "exit_code_per_target",
    f"SELECT target, max(CASE WHEN status IN ('FAILED', 'ERROR') OR (status NOT IN ('SKIPPED', 'OK') AND severity = 'warning') OR status = 'WARNING' THEN 1 ELSE 0 END) AS exit_code FROM ({_RESULTS_SQL}) GROUP BY 1",
)
def exit_code_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.target_exit_codes(_results(spark, sf_dir), warnings_as_fail=True)


@query(
    "run_exit_policy",
    f"""
    WITH t AS (SELECT target, max(CASE WHEN status IN ('FAILED', 'ERROR') THEN 1 ELSE 0 END) AS c FROM ({_RESULTS_SQL}) GROUP BY 1),
         n AS (SELECT count(*) AS total, coalesce(sum(c), 0) AS failed FROM t)
    SELECT 'any_fail' AS policy, CAST(failed >= 1 AS INT) AS exit_code FROM n
    UNION ALL SELECT 'all_fail', CAST(total > 0 AND failed = total AS INT) FROM n
    UNION ALL SELECT 'threshold', CAST(failed >= 10 AS INT) FROM n
    """,
)
def run_exit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_exit_codes(summary.target_exit_codes(_results(spark, sf_dir)), threshold=10)


@query(
    "verdict_precedence",
    """
    SELECT source AS target, CASE WHEN bool_or(coalesce(toxic, 0) = 1) THEN 'failed' WHEN bool_or(l.doc_id IS NULL) THEN 'not_judged' ELSE 'passed' END AS verdict
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
    """,
)
def verdict_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("target")), table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("judged"))
    rows = docs.join(labels, "doc_id", "left")
    return summary.verdicts(rows, "target", F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("judged").isNull())


@query("failing_targets_per_rule", "SELECT event_type AS rule, count(DISTINCT user_id) AS failing_targets FROM events WHERE value > 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def failing_targets_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.failing_targets(table(spark, sf_dir, "events").where("value > 5"), "event_type", "user_id")


@query("timings_summary", "SELECT count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 3) AS total, round(max(value), 6) AS longest, round(avg(value), 5) AS mean FROM events WHERE value IS NOT NULL HAVING count(*) > 0")
def timings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.timings(table(spark, sf_dir, "events"), "value").select("n", F.round("total", 3).alias("total"), "longest", F.round("mean", 5).alias("mean"))


@query(
    "mutant_outcomes",
    """
    WITH r AS (SELECT user_id AS mutant, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'ERROR' WHEN 'view' THEN 'SKIPPED' ELSE 'OK' END AS status,
                      CASE WHEN value < 8 THEN 'probe_timeout' ELSE 'finding' END AS reason FROM events),
         b AS (SELECT *, status = 'ERROR' OR (status = 'FAILED' AND reason LIKE 'probe\\_%' ESCAPE '\\') AS blind FROM r)
    SELECT mutant, CASE WHEN bool_or(status = 'FAILED' AND NOT blind) THEN 'killed' WHEN bool_or(blind) OR NOT bool_or(status <> 'SKIPPED') THEN 'not_run' ELSE 'survived' END AS outcome
    FROM b GROUP BY 1
    """,
)
def mutant_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("mutant"), F.when(e == "error", "FAILED").when(e == "purchase", "ERROR").when(e == "view", "SKIPPED").otherwise("OK").alias("status"),
        F.when(F.col("value") < 8, "probe_timeout").otherwise("finding").alias("reason"),
    )
    return summary.mutant_outcomes(rows)


@query(
    "bounded_count",
    "SELECT l_orderkey AS target, count(*) AS n, CASE WHEN count(*) < 2 THEN 'too_few' WHEN count(*) > 5 THEN 'too_many' ELSE 'within' END AS verdict FROM lineitem GROUP BY 1",
)
def bounded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("target")).agg(F.count("*").alias("n"))
    return n.withColumn("verdict", summary.bounded_count(F.col("n"), 2, 5))


@query(
    "metric_normalisation",
    "SELECT s_suppkey AS id, s_nationkey AS nation, CASE WHEN max(s_acctbal) OVER w = min(s_acctbal) OVER w THEN 1.0 ELSE (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) END AS score_norm FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
)
def metric_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("score"))
    return summary.min_max(rows, "score", by=["nation"]).drop("score")


# ---- likeness and choice


#: Parts that share brand and size, by the likeness of their names and types; parts with equal names are compared once.
_PAIRS_SQL = """
    WITH p AS (SELECT p_partkey, p_brand, p_size, p_name || ' ' || p_type AS name FROM part),
         s AS (SELECT a.p_partkey AS source_id, b.p_partkey AS target_id,
                      round(1.0 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS score
               FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)
"""


def _likest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return likeness.likest_names(p, ["p_brand", "p_size"], "p_partkey", "name", C.name_similarity, k)


#: All parts, whatever their brand and size.
_ALL_PAIRS_SQL = _PAIRS_SQL.replace("a.p_brand = b.p_brand AND a.p_size = b.p_size AND ", "")


@query("name_similarity_topk", _ALL_PAIRS_SQL + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS INT) AS rank FROM s) WHERE rank <= 3")
def name_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's three likest of all others; parts without a name or type come last."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    return likeness.likest_names(p, [], "p_partkey", "name", C.name_similarity, 3).union(likeness.nameless_pairs(p, "p_partkey", "name", 3))


@query(
    "match_status",
    _PAIRS_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS k FROM s),
         t AS (SELECT source_id, max(CASE WHEN k = 1 THEN target_id END) AS target_id, max(CASE WHEN k = 1 THEN score END) AS best, max(CASE WHEN k = 2 THEN score END) AS second FROM r WHERE k <= 2 GROUP BY 1)
    SELECT *, CASE WHEN best < 0.5 THEN 'UNMATCHED' WHEN best < 0.8 THEN 'LOW_CONFIDENCE' WHEN second >= best - 0.03 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM t
    """,
)
def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = selection.best_two(_likest(spark, sf_dir, 2).drop("rank"), ["source_id"], "target_id", "score", [F.desc("score"), "target_id"])
    return two.withColumn("status", selection.match_status(F.col("best"), F.col("second")))


@query(
    "one_to_one_winner",
    _PAIRS_SQL
    + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS k FROM s) WHERE k = 1)
    SELECT source_id, target_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) AS w FROM b) WHERE w = 1
    """,
)
def one_to_one_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _likest(spark, sf_dir, 1).drop("rank")
    return selection.winners(best, "target_id", [F.desc("score"), "source_id"])


@query(
    "doc_token_jaccard",
    r"""
    WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM documents),
         b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM benchmark),
         k AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(w) AS t FROM d) x JOIN (SELECT item_id, unnest(w) AS t FROM b) y USING (t)),
         j AS (SELECT doc_id, item_id, len(list_intersect(d.w, b.w)) AS i, len(d.w) + len(b.w) AS n FROM k JOIN d USING (doc_id) JOIN b USING (item_id)),
         s AS (SELECT doc_id, item_id, round(i / (n - i), 6) AS score FROM j)
    SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s) WHERE r = 1
    """,
)
def doc_token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's likest benchmark item of all with which it shares a word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", C.word_set("text").alias("w"))
    items = table(spark, sf_dir, "benchmark").select("item_id", C.word_set("text").alias("v"))
    # Counts of shared words come from joining on words, of all words from the arrays' sizes: no text meets an item's.
    words = docs.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    shared = words.join(items.select("item_id", F.size("v").alias("m"), F.explode("v").alias("t")), "t").groupBy("doc_id", "item_id", "n", "m").agg(F.count("*").alias("i"))
    scored = shared.select("doc_id", "item_id", F.round(F.col("i") / (F.col("n") + F.col("m") - F.col("i")), 6).alias("score"))
    return selection.top_k(scored, ["doc_id"], [F.desc("score"), "item_id"], 1).drop("rank")


@query(
    "multiset_jaccard",
    r"""
    WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS t FROM conversations),
         c AS (SELECT conv_id, turn, t, count(*) AS n FROM w WHERE t <> '' GROUP BY ALL),
         p AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn - 1) AS turn, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y
               FROM c a FULL JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 AND a.t = b.t),
         s AS (SELECT conv_id, turn, sum(least(x, y)) AS lo, sum(greatest(x, y)) AS hi, sum(x) AS nx, sum(y) AS ny FROM p GROUP BY ALL)
    SELECT s.conv_id, s.turn, CASE WHEN nx = 0 OR ny = 0 THEN 0.0 ELSE round(lo / hi, 6) END AS score
    FROM s JOIN (SELECT DISTINCT conv_id, turn FROM conversations) a USING (conv_id, turn)
    JOIN (SELECT DISTINCT conv_id, turn - 1 AS turn FROM conversations) b USING (conv_id, turn)
    """,
)
def multiset_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word bags of each turn against the next one's."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("first"), F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("then"), F.lower("text").alias("text"))
    sides = turns.select(F.explode(F.array(F.struct(F.col("first").alias("key"), F.lit(0).alias("side")), F.struct(F.col("then").alias("key"), F.lit(1).alias("side")))).alias("k"), "text")
    each = sides.select("k.key.conv_id", "k.key.turn", "k.side", "text").dropna(subset=["conv_id", "turn"])
    # Comparing takes long for the few bytes it reads, so its partitions are fixed, not merged by their sizes.
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    # Texts of both sides of a pair of turns come to one row, so words never fill a task's hash table: a task holds a pair's.
    text = lambda side: F.concat_ws(" ", F.collect_list(F.when(F.col("side") == side, F.col("text"))))
    pairs = each.groupBy("conv_id", "turn").agg(text(0).alias("a"), text(1).alias("b"), F.min("side").alias("first"), F.max("side").alias("last")).where("first < last")
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    return pairs.select("conv_id", "turn", words("a").alias("a"), words("b").alias("b")).select("conv_id", "turn", C.bag_likeness("a", "b").alias("score"))


@query(
    "round_robin_sample",
    "SELECT lang, doc_id, CAST(turn AS INT) AS turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50",
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.in_turn(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 50)


@query("result_page", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25 OFFSET 40")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.page(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 40, 25)


# ---- names, globs, membership


@query(
    "longest_prefix",
    r"""
    WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
         n AS (SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '.') AS name FROM u),
         m AS (SELECT DISTINCT array_to_string(list_reverse(string_split(host, '.'))[1:2], '.') AS module FROM u UNION SELECT 'com.example.www' UNION SELECT 'com')
    SELECT page_id, name, (SELECT module FROM m WHERE n.name = module OR starts_with(n.name, module || '.') ORDER BY length(module) DESC LIMIT 1) AS module FROM n
    """,
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed host names (`com.example.www`) in the most specific of their domains."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    names = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("name"))
    modules = names.select(F.array_join(F.slice(F.split("name", r"\."), 1, 2), ".").alias("module")).union(spark.createDataFrame([("com.example.www",), ("com",)], "module string"))
    return graph.longest_prefix(names, modules).select("page_id", "name", "module")


@query("glob_filter", r"SELECT page_id, url FROM pages WHERE regexp_full_match(regexp_replace(url, '^https?://', ''), '(?:[^/]+/)*en/[^/]*|[^/]*\.example\.org/(?:[^/]+/)*[^/]*\.html')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", "url").where(globs.matches_any(path, ["**/en/*", "*.example.org/**/*.html"]))


@query(
    "required_division",
    "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) r WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = r.p))",
)
def required_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    need = orders.select(F.col("o_orderpriority").alias("item"))
    return membership.divides(table(spark, sf_dir, "customer").select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("item")), need, ["c_custkey"])


@query("forbidden_absence", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 40)")
def forbidden_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return membership.lacks(table(spark, sf_dir, "part").select("p_partkey"), hits, ["p_partkey"])


@query(
    "stage_order",
    """
    WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS stages FROM events GROUP BY 1),
         a AS (SELECT user_id, stages, list_position(stages, 'signup') AS p FROM e),
         b AS (SELECT *, list_position(stages[coalesce(nullif(p, 0), 1000000) + 1:], 'view') AS q FROM a),
         c AS (SELECT *, list_position(stages[coalesce(nullif(p, 0), 1000000) + coalesce(nullif(q, 0), 1000000) + 1:], 'purchase') AS r FROM b)
    SELECT user_id, CAST(CASE WHEN coalesce(p, 0) = 0 THEN 0 WHEN coalesce(q, 0) = 0 THEN 1 WHEN coalesce(r, 0) = 0 THEN 2 ELSE 3 END AS INT) AS met FROM c
    """,
)
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's events meet signup, view, purchase in order."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return events.select("user_id", C.in_order(F.col("e.event_type"), ["signup", "view", "purchase"]).alias("met"))


# ---- edges between nations


#: Who buys where: edges (year, origin, end, n) between nations, named region.nation.
_EDGES_SQL = """
    WITH m AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '.n' || n_nationkey AS name FROM nation),
         e AS (SELECT year(o_orderdate) AS year, a.name AS origin, b.name AS "end", count(*) AS n
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
               JOIN m a ON a.k = c_nationkey JOIN m b ON b.k = s_nationkey GROUP BY ALL),
         g AS (SELECT year, origin, "end" FROM e WHERE origin <> "end")
"""

#: Of these the two busiest of each nation and year: a sparse graph, for the search whose result grows exponentially with edges.
_BUSIEST_SQL = _EDGES_SQL.replace("g AS (", "all_g AS (") + """,
         g AS (SELECT year, origin, "end" FROM (SELECT *, row_number() OVER (PARTITION BY year, origin ORDER BY n DESC, "end") AS r FROM e WHERE origin <> "end") WHERE r <= 2)
"""


def _nation_edges(spark: SparkSession, sf_dir: str, busiest: int | None = None) -> DataFrame:
    """Who buys from whom in a year, or only from so many busiest ones."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # Nation keys are counted, then named: names never ride along with lines.
    n = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("year", "c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    named = n.join(nation.select(F.col("k").alias("c_nationkey"), F.col("name").alias("origin")), "c_nationkey").join(nation.select(F.col("k").alias("s_nationkey"), F.col("name").alias("end")), "s_nationkey")
    named = named.where("origin <> end")
    return (named if busiest is None else selection.top_k(named, ["year", "origin"], [F.desc("n"), "end"], busiest)).select("year", "origin", "end")


def _year(edges_: DataFrame, year: int) -> DataFrame:
    return edges_.where(F.col("year") == year).select("origin", "end")


@query(
    "edge_diff",
    _EDGES_SQL
    + """, a AS (SELECT origin, "end" FROM g WHERE year = 1997), b AS (SELECT origin, "end" FROM g WHERE year = 1998)
    SELECT origin, "end", CASE WHEN b.origin IS NULL THEN 'absent' WHEN starts_with(origin, 'r0.') AND starts_with("end", 'r1.') THEN 'divergent'
           WHEN starts_with(origin, 'r2.') AND "end" = 'r3.n8' THEN 'allowed' WHEN a.origin IS NOT NULL THEN 'convergent' ELSE 'divergent' END AS kind
    FROM a FULL JOIN b USING (origin, "end")
    """,
)
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir)
    return edges.compare_edges(_year(rows, 1997), _year(rows, 1998), "strict", allow=[("r2", "r3.n8")], forbid=[("r0", "r1")])


@query(
    "fan_metrics",
    _EDGES_SQL
    + """, s AS (SELECT year, origin AS module, 0 AS i, 1 AS o FROM g UNION ALL SELECT year, "end", 1, 0 FROM g)
    SELECT year, module, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, round(sum(o) / (sum(i) + sum(o)), 9) AS instability FROM s GROUP BY 1, 2
    """,
)
def fan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.fan_metrics(_nation_edges(spark, sf_dir), ["year"]).withColumn("instability", F.round("instability", 9))


@query(
    "shared_edges",
    _EDGES_SQL + """SELECT origin, "end", count(DISTINCT year) AS targets, (SELECT count(DISTINCT year) FROM g) AS "of", round(count(DISTINCT year) / (SELECT count(DISTINCT year) FROM g), 9) AS share FROM g GROUP BY 1, 2""",
)
def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir).withColumns({"rule": F.lit("trade"), "kind": F.lit("used")})
    return edges.shared_edges(rows, "year").select("origin", "end", "targets", "of", F.round("share", 9).alias("share"))


@query(
    "static_runtime_edges",
    _EDGES_SQL
    + """, a AS (SELECT origin, "end" FROM g WHERE year = 1999), b AS (SELECT origin, "end" FROM g WHERE year = 2000)
    SELECT origin, "end", CASE WHEN b.origin IS NULL THEN 'static_only' WHEN a.origin IS NULL THEN 'runtime_only' ELSE 'both' END AS seen FROM a FULL JOIN b USING (origin, "end")
    """,
)
def static_runtime_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir)
    return edges.static_runtime(_year(rows, 1999), _year(rows, 2000))


@query(
    "dependency_matrix",
    _EDGES_SQL
    + """, d AS (SELECT split_part(origin, '.', 1) AS origin, split_part("end", '.', 1) AS "end", year FROM g),
         k AS (SELECT origin, "end", CASE WHEN year = 1995 THEN 5 WHEN year < 1997 THEN 4 WHEN year < 1999 THEN 3 WHEN year < 2001 THEN 2 ELSE 1 END AS r FROM d)
    SELECT origin, "end", CASE max(r) WHEN 5 THEN 'divergent' WHEN 4 THEN 'undecided' WHEN 3 THEN 'absent' WHEN 2 THEN 'allowed' ELSE 'convergent' END AS kind FROM k GROUP BY 1, 2
    """,
)
def dependency_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("year")
    kind = F.when(y == 1995, "divergent").when(y < 1997, "undecided").when(y < 1999, "absent").when(y < 2001, "allowed").otherwise("convergent")
    region = lambda c: F.substring_index(c, ".", 1).alias(c)
    return edges.dependency_matrix(_nation_edges(spark, sf_dir).select(region("origin"), region("end"), kind.alias("kind")))


@query(
    "fold_new_modules",
    "WITH RECURSIVE "
    + _EDGES_SQL.strip().removeprefix("WITH ")
    + """, own AS (SELECT origin, "end" FROM g WHERE year = 1996),
         w AS (SELECT origin, "end" AS via FROM own WHERE NOT starts_with(origin, 'r4') AND starts_with("end", 'r4')
               UNION SELECT w.origin, o."end" FROM w JOIN own o ON o.origin = w.via WHERE starts_with(o."end", 'r4'))
    SELECT DISTINCT origin, "end" FROM (
        SELECT origin, "end" FROM own WHERE NOT starts_with(origin, 'r4') AND NOT starts_with("end", 'r4')
        UNION ALL SELECT w.origin, o."end" FROM w JOIN own o ON o.origin = w.via WHERE NOT starts_with(o."end", 'r4')) WHERE origin <> "end"
    """,
)
def fold_new_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of one region are unknown modules and fold into those that use them."""
    known = table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("module"))
    return edges.fold_new_modules(_year(_nation_edges(spark, sf_dir), 1996), known)[0].select("origin", "end")


@query(
    "reachability",
    "WITH RECURSIVE "
    + _EDGES_SQL.strip().removeprefix("WITH ")
    + """, r AS (SELECT year, origin AS start, "end" AS node FROM g UNION SELECT r.year, r.start, o."end" FROM r JOIN g o ON o.origin = r.node AND o.year = r.year)
    SELECT year, start, node FROM r
    """,
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_nation_edges(spark, sf_dir), by=["year"])


@query(
    "cycles_scc",
    "WITH RECURSIVE "
    + _EDGES_SQL.strip().removeprefix("WITH ")
    + """, r AS (SELECT year, origin AS start, "end" AS node FROM g UNION SELECT r.year, r.start, o."end" FROM r JOIN g o ON o.origin = r.node AND o.year = r.year),
         p AS (SELECT a.year, a.start, a.node FROM r a JOIN r b ON a.year = b.year AND a.start = b.node AND a.node = b.start)
    SELECT year, min(start) AS component, node FROM p GROUP BY year, node HAVING count(*) > 1
    """,
)
def cycles_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strongly_connected(_nation_edges(spark, sf_dir), ["year"])


@query(
    "simple_paths_forbidden",
    "WITH RECURSIVE "
    + _BUSIEST_SQL.strip().removeprefix("WITH ")
    + """, own AS (SELECT origin, "end" FROM g WHERE year = 1999 AND NOT starts_with("end", 'r1.')),
         w AS (SELECT origin AS start, "end" AS node, [origin, "end"] AS path FROM own WHERE starts_with(origin, 'r0.') AND NOT (origin = "end")
               UNION ALL SELECT w.start, o."end", list_append(w.path, o."end") FROM w JOIN own o ON o.origin = w.node
               WHERE NOT starts_with(w.node, 'r2.') AND (starts_with(o."end", 'r2.') OR NOT list_contains(w.path, o."end")))
    SELECT start, node AS target, 'r2' AS prefix, array_to_string(path, ' -> ') AS path FROM w WHERE starts_with(node, 'r2.')
    """,
)
def simple_paths_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _year(_nation_edges(spark, sf_dir, 2), 1999)
    roots = rows.where(F.startswith("origin", F.lit("r0."))).select(F.col("origin").alias("start")).distinct()
    return graph.simple_paths(rows, roots, ["r2"], ["r1"]).withColumn("path", F.array_join("path", " -> "))


@query(
    "layer_violations_direct",
    _EDGES_SQL
    + """, p AS (SELECT *, CASE split_part(origin, '.', 1) WHEN 'r0' THEN 0 WHEN 'r1' THEN 1 WHEN 'r2' THEN 1 WHEN 'r3' THEN 2 END AS a,
                    CASE split_part("end", '.', 1) WHEN 'r0' THEN 0 WHEN 'r1' THEN 1 WHEN 'r2' THEN 1 WHEN 'r3' THEN 2 END AS b,
                    split_part(origin, '.', 1) AS x, split_part("end", '.', 1) AS y FROM g)
    SELECT year, CASE WHEN b < a THEN 'upward' WHEN a = b THEN 'sibling' ELSE 'skip' END AS kind, x AS origin_layer, y AS target_layer, origin || ' -> ' || "end" AS path
    FROM p WHERE x <> y AND (b < a OR (a = b) OR (a = 0 AND b = 2))
    """,
)
def layer_violations_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as layers: r0 over r1 | r2 (closed) over r3; r4 is in none."""
    found = graph.layer_violations(_nation_edges(spark, sf_dir), ["r0", "r1 | r2", "r3"], closed=["r1"], chains=False, by=["year"])
    return found.select("year", "kind", "origin_layer", "target_layer", F.array_join("path", " -> ").alias("path"))


@query("cycle_paths")
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle through the first node of each component: the order of a search, which SQL doesn't express."""
    rows = _nation_edges(spark, sf_dir)
    return graph.cycle_paths(rows, graph.strongly_connected(rows, ["year"]), ["year"]).withColumn("path", F.array_join("path", " -> "))


@query("layer_violations_chains")
def layer_violations_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As layer_violations_direct, also through nations of the region that is in no layer."""
    found = graph.layer_violations(_nation_edges(spark, sf_dir), ["r0", "r1 | r2", "r3"], closed=["r1"], by=["year"])
    return found.withColumn("path", F.array_join("path", " -> "))


@query(
    "layered_policy",
    "WITH RECURSIVE "
    + _EDGES_SQL.strip().removeprefix("WITH ")
    + """, a AS (SELECT origin, "end" FROM g WHERE year = 1995), b AS (SELECT origin, "end" FROM g WHERE year = 2001),
         r AS (SELECT "end" AS start, "end" AS node FROM b UNION SELECT r.start, a."end" FROM r JOIN a ON a.origin = r.node)
    SELECT origin, "end", CASE WHEN b.origin IS NULL THEN 'absent' WHEN a.origin IS NOT NULL THEN 'convergent'
           WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.start = b."end" AND r.node = b.origin) THEN 'undecided' ELSE 'divergent' END AS kind
    FROM a FULL JOIN b USING (origin, "end")
    """,
)
def layered_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_edges(spark, sf_dir)
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("module"))
    return edges.compare_edges(_year(rows, 1995), _year(rows, 2001), "layered", known=known)
