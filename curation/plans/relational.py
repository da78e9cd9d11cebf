"""Reads over the programme star: joins, aggregates, predicates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.operators import joins
from curation.plans import star
from curation.plans.registry import Rows, query, table
from curation.plans.star import CTE


@query("j5_programmes_fee_exists", CTE + """
SELECT p.program_id, p.academic_year, c.catalog_name, u.university FROM program p
LEFT JOIN catalog c USING (catalog_id) LEFT JOIN university u USING (university_id)
WHERE academic_year = 1997 AND EXISTS (SELECT 1 FROM fee f WHERE f.program_id = p.program_id AND scope = 'R' AND mode = 'F' AND amount <= 30000 AND basis = 'per_programme')
ORDER BY academic_year DESC, program_id""")
def programmes_fee_exists(spark, d):
    """Programmes of a year for which one fee row meets scope, mode, limit and basis together."""
    found = star.program(spark, d).where("academic_year = 1997")
    found = joins.having_one_row(found, star.fee(spark, d), "program_id", "program_id", joins.fee_conditions("R", "F", 30000))
    named = found.join(star.catalog(spark, d), "catalog_id", "left").join(star.university(spark, d), "university_id", "left")
    return named.select("program_id", "academic_year", "catalog_name", "university").orderBy(F.desc("academic_year"), "program_id")


@query("j5_no_filter_keeps_all", CTE + "SELECT count(*) AS n, count(DISTINCT catalog_id) AS catalogs FROM program")
def no_filter_keeps_all(spark, d):
    kept = joins.having_one_row(star.program(spark, d), star.fee(spark, d), "program_id", "program_id", joins.fee_conditions())
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("catalog_id").alias("catalogs"))


@query("j1_program_catalog_left", CTE + "SELECT program_id, academic_year, catalog_name FROM program LEFT JOIN catalog USING (catalog_id)")
def program_catalog_left(spark, d):
    return star.program(spark, d).join(star.catalog(spark, d), "catalog_id", "left").select("program_id", "academic_year", "catalog_name")


@query("j2_star_left_joins", """
SELECT l_orderkey, l_linenumber, p_name AS subject, s_name AS exam, n_name AS framework, r_name AS evidence FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def star_left_joins(spark, d):
    rows = table(spark, d, "lineitem")
    out = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    out = out.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("l_orderkey", "l_linenumber", F.col("p_name").alias("subject"), F.col("s_name").alias("exam"), F.col("n_name").alias("framework"), F.col("r_name").alias("evidence"))


@query("j3_requirement_exam_left", "SELECT p_partkey, p_name, ps AS exam FROM part LEFT JOIN (SELECT s_suppkey, s_name AS ps FROM supplier) ON p_partkey = s_suppkey")
def requirement_exam_left(spark, d):
    return with_exam(table(spark, d, "part"), table(spark, d, "supplier"))


def with_exam(requirements, exams):
    exam = exams.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("exam"))
    return requirements.join(exam, "p_partkey", "left").select("p_partkey", "p_name", "exam")


@query("j4_program_catalog_inner", CTE + "SELECT program_id, catalog_name FROM program JOIN catalog USING (catalog_id)")
def program_catalog_inner(spark, d):
    return star.program(spark, d).join(star.catalog(spark, d), "catalog_id").select("program_id", "catalog_name")


@query("j6_orphans", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("j8_children_nested", CTE + """
SELECT p.program_id, academic_year, coalesce(string_agg(scope || '/' || mode || '/' || CAST(amount AS VARCHAR), ';' ORDER BY scope, mode, amount), '') AS fees
FROM program p LEFT JOIN fee f USING (program_id) GROUP BY ALL""")
def children_nested(spark, d):
    """Every programme with its fees in one nested column: one plan, no query per programme."""
    return with_fees(star.program(spark, d), star.fee(spark, d))


def with_fees(programmes, fees):
    out = joins.with_children(programmes, {"fees": (fees, ["scope", "mode", "amount"])}, "program_id")
    text = F.transform(F.coalesce("fees", F.array().cast("array<struct<scope:string,mode:string,amount:decimal(12,2)>>")), lambda x: F.concat_ws("/", x.scope, x.mode, x.amount.cast("string")))
    return out.select("program_id", "academic_year", F.concat_ws(";", text).alias("fees"))


@query("j10_token_candidates", """
WITH n AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name),
t AS (SELECT id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS tok FROM n)
SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM t a JOIN t b USING (tok) WHERE a.id < b.id""")
def token_candidates(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).withColumn("tokens", F.split(F.lower("p_name"), " "))
    left = names.select(F.col("id").alias("left_id"), F.col("tokens").alias("lt"))
    right = names.select(F.col("id").alias("right_id"), F.col("tokens").alias("rt"))
    return joins.token_candidates(left, right, "left_id", "right_id", "lt", "rt").where("left_id < right_id")


@query("j12_shared_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
i AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, CAST(sum(CASE WHEN trim(l.line, ' ') IN (SELECT line FROM i) THEN 1 ELSE 0 END) AS BIGINT) AS shared, count(*) AS lines FROM l GROUP BY doc_id""")
def shared_lines(spark, d):
    """Lines that stand in more than one document, by membership in the set of shared lines; lines are shuffled as hashes."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("all"))
    # blank lines are no members and would all meet under one key
    lines = docs.select("doc_id", F.explode("all").alias("line")).withColumn("line", F.trim("line")).where("line <> ''").select("doc_id", joins.line_key(F.col("line")).alias("k"))
    shared = lines.join(joins.shared_keys(lines, "doc_id", "k"), "k", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    counts = docs.groupBy("doc_id").agg(F.sum(F.size("all")).alias("lines"))
    return counts.join(shared, "doc_id", "left").select("doc_id", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"), "lines")


@query("j13_u1_requirement_sets", CTE + """,
o AS (SELECT DISTINCT catalog_id, status FROM program WHERE academic_year = 1996), n AS (SELECT DISTINCT catalog_id, status FROM program WHERE academic_year = 1997)
SELECT coalesce(o.catalog_id, n.catalog_id) AS catalog_id, coalesce(o.status, n.status) AS status,
 CASE WHEN o.catalog_id IS NULL THEN 'added' WHEN n.catalog_id IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM o FULL JOIN n ON o.catalog_id = n.catalog_id AND o.status = n.status""")
def requirement_sets(spark, d):
    p = star.program(spark, d)
    return joins.compared(p.where("academic_year = 1996"), p.where("academic_year = 1997"), ["catalog_id", "status"])


LISTED = Rows("o_orderkey long, pos int", [(7, 1), (3, 2), (7, 3), (1, 4), (999999999, 5), (32, 6), (5, 7)])


@query("j14_review_order", f"SELECT o.o_orderkey, pos, o_orderstatus FROM orders o JOIN (SELECT o_orderkey, min(pos) AS pos FROM {LISTED.sql} GROUP BY 1) USING (o_orderkey) ORDER BY pos")
def review_order(spark, d):
    return joins.in_listed_order(table(spark, d, "orders"), LISTED.df(spark), "o_orderkey", "pos").select("o_orderkey", "pos", "o_orderstatus")


FACULTIES = Rows("univ int, faculty string", [(1, "Arts - History"), (1, "History"), (1, "Science - Physics"), (1, "physics "), (1, "Eng - Law"), (1, "Law School - Law"), (1, "Law"), (2, "Physics"), (2, None)])


@query("j15_sole_faculty_sibling", f"""
WITH r AS (SELECT univ, faculty, regexp_replace(lower(list_last(string_split(faculty, ' - '))), '[^a-z0-9]+', '', 'g') AS s, contains(faculty, ' - ') AS pre FROM {FACULTIES.sql}),
p AS (SELECT univ, s, min(faculty) AS f FROM r WHERE pre GROUP BY 1, 2 HAVING count(DISTINCT faculty) = 1)
SELECT r.univ, r.faculty, coalesce(CASE WHEN NOT pre THEN p.f END, r.faculty) AS canonical FROM r LEFT JOIN p ON r.univ = p.univ AND r.s = p.s""")
def sole_faculty_sibling(spark, d):
    return joins.sole_sibling(FACULTIES.df(spark), "univ", "faculty")


CANDIDATES = Rows("id int, anchor string, slug string, title string, markdown string", [(1, "MSc Data", "msc-data", None, " "), (2, "", None, "Welcome", "MA Arts"), (3, None, None, None, None)])


@query("j16_name_candidates", f"""
SELECT id, source, value FROM (SELECT id, 'anchor' AS source, anchor AS value FROM {CANDIDATES.sql} UNION ALL SELECT id, 'slug', slug FROM {CANDIDATES.sql}
UNION ALL SELECT id, 'title', title FROM {CANDIDATES.sql} UNION ALL SELECT id, 'markdown', markdown FROM {CANDIDATES.sql}) WHERE trim(coalesce(value, '')) <> ''""")
def name_candidates(spark, d):
    return joins.unpivoted(CANDIDATES.df(spark), "id", ["anchor", "slug", "title", "markdown"])


EDGES = Rows("src string, dst string", [("index", "a"), ("index", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "index"), ("x", "y")])


@query("j17_depth_bounded_reach", f"""
WITH RECURSIVE e AS (SELECT * FROM {EDGES.sql}), r(node, depth) AS (SELECT 'index', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def depth_bounded_reach(spark, d):
    return joins.reachable(EDGES.df(spark), spark.createDataFrame([("index",)], "node string"), 3)


@query("a1_count", "SELECT count(*) AS n FROM orders")
def count_all(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))


@query("a2_status_by_university_year", CTE + """,
c AS (SELECT university_id, academic_year, count(*) AS n FROM program JOIN catalog USING (catalog_id) GROUP BY ALL)
SELECT university, coalesce(string_agg(academic_year || ':' || n, ',' ORDER BY academic_year DESC), '') AS years FROM university LEFT JOIN c USING (university_id) GROUP BY university""")
def status_by_university_year(spark, d):
    """Programmes per university and year; a university without any has an empty list."""
    counts = star.program(spark, d).join(star.catalog(spark, d), "catalog_id").groupBy("university_id", "academic_year").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("university_id").agg(F.sort_array(F.collect_list(F.struct("academic_year", "n")), False).alias("y"))
    years = F.concat_ws(",", F.transform("y", lambda x: F.concat_ws(":", x.academic_year, x.n)))
    return star.university(spark, d).join(listed, "university_id", "left").select("university", F.coalesce(years, F.lit("")).alias("years"))


@query("a4_scope_preview", CTE + "SELECT count(*) AS n, string_agg(DISTINCT CAST(academic_year AS VARCHAR), ',' ORDER BY CAST(academic_year AS VARCHAR)) AS years, count(DISTINCT catalog_id) AS names FROM program JOIN catalog USING (catalog_id) WHERE university_id = 3")
def scope_preview(spark, d):
    rows = star.program(spark, d).join(star.catalog(spark, d).where("university_id = 3"), "catalog_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("academic_year")).cast("array<string>")).alias("years"), F.count_distinct("catalog_id").alias("names"))


@query("a5_breakdown_by_reason", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason")
def breakdown_by_reason(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


@query("a6_a21_latest_summary", """
SELECT max(event_id) AS audit_id, arg_max(event_type, event_id) AS stop_reason, arg_max(event_type, event_id) IN ('error', 'purchase') AS anomalous,
 (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS breakdown FROM events""")
def latest_summary(spark, d):
    """The newest audit row with the breakdown beside it; both sides are one row."""
    e = table(spark, d, "events")
    kinds = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("event_type", "n"))).alias("b"))
    last = e.agg(F.max("event_id").alias("audit_id"), F.max_by("event_type", "event_id").alias("stop_reason"))
    out = last.crossJoin(F.broadcast(kinds))
    return out.select("audit_id", "stop_reason", F.col("stop_reason").isin("error", "purchase").alias("anomalous"), F.concat_ws(",", F.transform("b", lambda x: F.concat_ws("=", x.event_type, x.n))).alias("breakdown"))


@query("a7_dropped_by_stage", "SELECT event_type AS stage, user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS links FROM events GROUP BY 1, 2")
def dropped_by_stage(spark, d):
    return grouped_by_stage(table(spark, d, "events"))


def grouped_by_stage(events):
    links = F.concat_ws(",", F.array_sort(F.collect_list("event_id")).cast("array<string>"))
    return events.groupBy(F.col("event_type").alias("stage"), "user_id").agg(links.alias("links"))


@query("a12_cost_rollup", """
SELECT role AS model, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, CAST(sum(length(text) // 4 * CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 15 ELSE 1 END) AS BIGINT) AS cost
FROM conversations GROUP BY ROLLUP (role)""")
def cost_rollup(spark, d):
    """Tokens and cost per model with the grand total as the row without a model; unknown models have the default rate."""
    rates = spark.createDataFrame([("user", 3), ("assistant", 15)], "role string, rate long")
    rows = table(spark, d, "conversations").join(F.broadcast(rates), "role", "left").withColumn("tokens", F.floor(F.length("text") / 4))
    return rows.rollup(F.col("role").alias("model")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.coalesce("rate", F.lit(1))).alias("cost"))


@query("a18_alias_union", "SELECT p_brand, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS aliases FROM part GROUP BY p_brand")
def alias_union(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.concat_ws("|", F.array_sort(F.collect_set("p_name"))).alias("aliases"))


@query("a20_ingest_counters", "SELECT count(*) FILTER (event_type = 'click') AS created, count(*) FILTER (event_type = 'view') AS updated, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value IS NULL) AS quarantined FROM events")
def ingest_counters(spark, d):
    e, c = table(spark, d, "events"), F.col("event_type")
    return e.agg(F.count_if(c == "click").alias("created"), F.count_if(c == "view").alias("updated"), F.count_if(c == "error").alias("failed"), F.count_if(F.col("value").isNull()).alias("quarantined"))


@query("a22_job_with_tasks", "SELECT user_id, count(*) AS tasks, string_agg(event_type, '>' ORDER BY ts, event_id) AS stages FROM events GROUP BY user_id")
def job_with_tasks(spark, d):
    return with_ordered_tasks(table(spark, d, "events"))


def with_ordered_tasks(events):
    tasks = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("tasks"), F.concat_ws(">", F.transform(tasks, lambda x: x.event_type)).alias("stages"))


@query("p1_p2_p3_p4_filters", CTE + "SELECT program_id, status, tuition FROM program WHERE academic_year = 1995 AND status IN ('F', 'P') AND tuition IS NOT NULL AND tuition <= 150000.00")
def filters(spark, d):
    return star.program(spark, d).where((F.col("academic_year") == 1995) & F.col("status").isin("F", "P") & F.col("tuition").isNotNull() & (F.col("tuition") <= 150000)).select("program_id", "status", "tuition")


@query("t1_programmes_ordered", CTE + "SELECT academic_year, catalog_name, program_id FROM program JOIN catalog USING (catalog_id) ORDER BY academic_year DESC, catalog_name, program_id")
def programmes_ordered(spark, d):
    return star.program(spark, d).join(star.catalog(spark, d), "catalog_id").select("academic_year", "catalog_name", "program_id").orderBy(F.desc("academic_year"), "catalog_name", "program_id")


@query("t2_t3_children_ordered", CTE + "SELECT program_id, line, row_number() OVER (PARTITION BY program_id ORDER BY cutoff NULLS FIRST, line, amount, scope, mode) AS by_cutoff, row_number() OVER (PARTITION BY program_id ORDER BY scope, mode, basis, line, amount, cutoff) AS by_scope FROM fee")
def children_ordered(spark, d):
    w = W.partitionBy("program_id")
    return star.fee(spark, d).select(
        "program_id", "line", F.row_number().over(w.orderBy(F.asc_nulls_first("cutoff"), "line", "amount", "scope", "mode")).cast("long").alias("by_cutoff"),
        F.row_number().over(w.orderBy("scope", "mode", "basis", "line", "amount", "cutoff")).cast("long").alias("by_scope"),
    )


@query("t5_t6_newest_limited", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_limited(spark, d):
    limit = max(1, min(50, 200))
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", "ts", "event_type")


@query("t7_universities_by_update", CTE + "SELECT university_id, max(updated_at) AS updated_at FROM program JOIN catalog USING (catalog_id) GROUP BY 1 ORDER BY 2 DESC, 1")
def universities_by_update(spark, d):
    rows = star.program(spark, d).join(star.catalog(spark, d), "catalog_id")
    return rows.groupBy("university_id").agg(F.max("updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), "university_id")


@query("t13_limit_with_reason", "SELECT doc_id, CASE WHEN (SELECT count(*) FROM documents) > 30 THEN 'reached_limit' ELSE 'exhausted' END AS stop FROM documents ORDER BY doc_id LIMIT 30")
def limit_with_reason(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return docs.orderBy("doc_id").limit(30).crossJoin(F.broadcast(n)).select("doc_id", F.when(F.col("n") > 30, "reached_limit").otherwise("exhausted").alias("stop"))


@query("u2_candidates_minus_active", "SELECT DISTINCT p_brand FROM part WHERE p_size > 45 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size < 2")
def candidates_minus_active(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size > 45").select("p_brand").subtract(p.where("p_size < 2").select("p_brand"))


@query("u3_kept_and_rescued", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def kept_and_rescued(spark, d):
    """Kept links and those rescued, where only links that had been dropped can be rescued."""
    o = table(spark, d, "orders")
    rescued = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.where("o_orderstatus = 'F'").select("o_orderkey").union(o.where("o_orderstatus <> 'F'").select("o_orderkey").intersect(rescued)).distinct()


@query("u4_ordered_unvisited", "SELECT event_type, user_id, min(event_id) AS pos FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) GROUP BY ALL")
def ordered_unvisited(spark, d):
    e = table(spark, d, "events")
    visited = e.where("event_type = 'purchase' and value > 90").select("user_id")
    return e.groupBy("event_type", "user_id").agg(F.min("event_id").alias("pos")).join(visited, "user_id", "left_anti").select("event_type", "user_id", "pos")
