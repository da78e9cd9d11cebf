"""Window-shaped queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.operators import joins, series
from curation.plans import star
from curation.plans.registry import Rows, query, table
from curation.plans.star import CTE


@query("wa_latest_version", CTE + "SELECT catalog_id, program_id, academic_year FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY academic_year DESC, program_id DESC) AS n FROM program) WHERE n = 1")
def latest_version(spark, d):
    return joins.latest(star.program(spark, d), ["catalog_id"], [F.desc("academic_year"), F.desc("program_id")]).select("catalog_id", "program_id", "academic_year")


@query("wb_group_map", CTE + """,
f AS (SELECT catalog_id, status, row_number() OVER (PARTITION BY catalog_id ORDER BY academic_year DESC, program_id) AS n FROM program)
SELECT status, max(catalog_id) AS catalog_id FROM f WHERE n = 1 GROUP BY status""")
def group_map(spark, d):
    """First row of each catalogue entry by newest year; of equal names the later entry stands."""
    first = joins.latest(star.program(spark, d), ["catalog_id"], [F.desc("academic_year"), F.asc("program_id")])
    return first.groupBy("status").agg(F.max("catalog_id").alias("catalog_id"))


@query("wc_contexts_newest_year", CTE + "SELECT catalog_name, status, max(academic_year) AS academic_year FROM program JOIN catalog USING (catalog_id) GROUP BY 1, 2")
def contexts_newest_year(spark, d):
    rows = star.program(spark, d).join(star.catalog(spark, d), "catalog_id")
    return rows.groupBy("catalog_name", "status").agg(F.max("academic_year").alias("academic_year"))


@query("wd_deadline_rounds", CTE + "SELECT program_id, line, CAST(row_number() OVER (PARTITION BY program_id ORDER BY cutoff NULLS LAST, line) AS INTEGER) AS round FROM fee")
def deadline_rounds(spark, d):
    return star.fee(spark, d).select("program_id", "line", F.row_number().over(W.partitionBy("program_id").orderBy(F.asc_nulls_last("cutoff"), "line")).alias("round"))


@query("we_version_validity", CTE + """
SELECT catalog_id, program_id, CAST(row_number() OVER w AS INTEGER) AS version_no, lead(updated_at) OVER w AS valid_to
FROM (SELECT catalog_id, max(program_id) AS program_id, updated_at FROM program GROUP BY ALL) WINDOW w AS (PARTITION BY catalog_id ORDER BY updated_at)""")
def version_validity(spark, d):
    rows = star.program(spark, d).groupBy("catalog_id", "updated_at").agg(F.max("program_id").alias("program_id"))
    return series.validity(rows, ["catalog_id"], "updated_at").select("catalog_id", "program_id", "version_no", "valid_to")


@query("wf_history", CTE + "SELECT catalog_id, academic_year, program_id, CAST(round(tuition - lag(tuition) OVER (PARTITION BY catalog_id ORDER BY academic_year, program_id), 2) AS DOUBLE) AS change FROM program ORDER BY 1, 2, 3")
def history(spark, d):
    return with_change(star.program(spark, d))


def with_change(programmes):
    w = W.partitionBy("catalog_id").orderBy("academic_year", "program_id")
    return programmes.select("catalog_id", "academic_year", "program_id", F.round(F.col("tuition") - F.lag("tuition").over(w), 2).cast("double").alias("change")).orderBy("catalog_id", "academic_year", "program_id")


YIELDS = Rows("site string, page int, n int", [("a", 1, 50), ("a", 2, 48), ("a", 3, 50), ("a", 4, 5), ("b", 1, 10), ("b", 2, 0), ("b", 3, 0), ("c", 1, 10), ("c", 2, 1), ("c", 3, 9), ("c", 4, 9), ("d", 1, 0)])


@query("wg_decreasing_yield", f"""
SELECT site, page, coalesce(row_number() OVER w >= 4 AND n < 0.2 * avg(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
 OR (max(n) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 0 AND row_number() OVER w >= 2) AS stop FROM {YIELDS.sql} WINDOW w AS (PARTITION BY site ORDER BY page)""")
def decreasing_yield(spark, d):
    return series.decreasing_yield(YIELDS.df(spark), ["site"], "page", "n").select("site", "page", "stop")


@query("wg_daily_yield_of_users", """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, day, coalesce(row_number() OVER w >= 4 AND n < 0.2 * avg(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
 OR (max(n) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 0 AND row_number() OVER w >= 2) AS stop FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def daily_yield(spark, d):
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return series.decreasing_yield(days, ["user_id"], "day", "n").select("user_id", "day", "stop")


@query("wh_trace_last_200", "SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 200")
def trace_last_200(spark, d):
    w = W.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("seq", F.row_number().over(w.orderBy("ts", "event_id")).cast("long"))
    return series.last_n(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 200).select("user_id", "event_id", "seq")


@query("wi_shared_line_islands", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
i AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
m AS (SELECT l.*, i.line IS NOT NULL AS member, trim(l.line, ' ') = '' AS blank FROM l LEFT JOIN i ON trim(l.line, ' ') = i.line),
r AS (SELECT *, CASE WHEN member OR blank THEN sum(CASE WHEN NOT member AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) END AS run FROM m),
c AS (SELECT *, sum(CASE WHEN member THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) AS n FROM r)
SELECT doc_id, count(*) AS lines_left FROM c WHERE run IS NULL OR n < 3 GROUP BY doc_id""")
def shared_line_islands(spark, d):
    """Lines left when runs of three shared lines or more are dropped; blank lines bridge a run."""
    split = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    lines = split.select("doc_id", "pos", (line == "").alias("blank"), joins.line_key(line).alias("k"))
    # blank lines are no members and would all meet under one key
    filled = lines.where("not blank")
    shared = joins.shared_keys(filled, "doc_id", "k").withColumn("hit", F.lit(True))
    found = filled.join(shared, "k", "left").select("doc_id", "pos", "blank", F.coalesce("hit", F.lit(False)).alias("member"))
    marked = found.unionByName(lines.where("blank").select("doc_id", "pos", "blank", F.lit(False).alias("member")))
    left = series.drop_long_islands(marked, ["doc_id"], "pos", "member", "blank")
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines_left"))


@query("wj_context_lines", "SELECT conv_id, turn, concat_ws(' ', lag(role) OVER w, role, lead(role) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def context_lines(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn", "role")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.lag("role").over(w), "role", F.lead("role").over(w)).alias("context"))


@query("wk_best_fee_candidate", CTE + "SELECT program_id, line, amount FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY (basis = 'per_programme')::INT DESC, (scope = 'N')::INT DESC, amount DESC, line) AS n FROM fee) WHERE n = 1")
def best_fee_candidate(spark, d):
    order = [F.desc(F.col("basis") == "per_programme"), F.desc(F.col("scope") == "N"), F.desc("amount"), F.asc("line")]
    return joins.latest(star.fee(spark, d), ["program_id"], order).select("program_id", "line", "amount")


@query("wl_compact_older_turns", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND n > 3 AND length(text) > 200 THEN '[compacted]' ELSE 'kept' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations)""")
def compact_older_turns(spark, d):
    """All but the last three results of a role are compacted when long."""
    n = F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    old = (F.col("role") == "assistant") & (F.col("n") > 3) & (F.length("text") > 200)
    return table(spark, d, "conversations").withColumn("n", n).select("conv_id", "turn", F.when(old, "[compacted]").otherwise("kept").alias("state"))


MARKDOWN = Rows("page int, pos int, line string", [(1, 0, "intro"), (1, 1, "# Fees"), (1, 2, "HKD 1"), (1, 3, ""), (1, 4, "HKD 2"), (1, 5, "## Dates"), (1, 6, "May"), (2, 0, "no heading")])


@query("wm_heading_sections", f"""
WITH h AS (SELECT *, count(CASE WHEN line LIKE '#%' THEN 1 END) OVER (PARTITION BY page ORDER BY pos) AS g FROM {MARKDOWN.sql})
SELECT page, regexp_replace(max(CASE WHEN line LIKE '#%' THEN line END), '^#+ *', '') AS heading, string_agg(line, '|' ORDER BY pos) FILTER (line NOT LIKE '#%') AS body FROM h GROUP BY page, g""")
def heading_sections(spark, d):
    rows = MARKDOWN.df(spark).withColumn("head", F.when(F.col("line").startswith("#"), F.struct("pos", "line")))
    rows = rows.withColumn("head", F.last("head", ignorenulls=True).over(W.partitionBy("page").orderBy("pos")))
    body = F.array_sort(F.collect_list(F.when(~F.col("line").startswith("#"), F.struct("pos", "line"))))
    text = F.concat_ws("|", F.transform(body, lambda x: x.line))
    out = rows.groupBy("page", "head").agg(F.when(F.size(body) > 0, text).alias("body"))
    return out.select("page", F.regexp_replace("head.line", "^#+ *", "").alias("heading"), "body")


ONHOLD = Rows("name string, confidence double, pos int", [("a", 0.7, 1), ("b", 0.9, 2), ("c", 0.7, 3), ("d", None, 4)])


@query("wo_onhold_items", f"SELECT CAST(row_number() OVER (ORDER BY confidence DESC NULLS LAST, pos) AS INTEGER) AS idx, name FROM {ONHOLD.sql}")
def onhold_items(spark, d):
    return ONHOLD.df(spark).select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("confidence"), "pos")).alias("idx"), "name")


@query("wp_retention_newest_3", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY day DESC LIMIT 3) GROUP BY 1")
def retention_newest(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.desc("day")).limit(3)


TASKS = Rows("id int, state string, age_min int", [(1, "done", 90), (2, "failed", 10), (3, "running", 500), (4, "done", 30), (5, "done", 20), (6, "done", 61), (7, "done", 60)])


@query("wq_eviction", f"""
WITH t AS (SELECT *, state <> 'running' AND age_min > 60 AS old FROM {TASKS.sql}), r AS (SELECT * FROM t WHERE NOT old),
n AS (SELECT *, CASE WHEN state <> 'running' THEN row_number() OVER (PARTITION BY state <> 'running' ORDER BY age_min DESC, id) END AS k, count(*) OVER () - 3 AS excess FROM r)
SELECT id, state FROM n WHERE k IS NULL OR k > excess""")
def eviction(spark, d):
    """Terminal tasks over an hour go; of the rest the oldest terminal ones beyond three in all."""
    over = F.col("state") != "running"
    left = TASKS.df(spark).where(~(over & (F.col("age_min") > 60)))
    total = left.agg((F.count(F.lit(1)) - 3).alias("excess"))
    n = F.when(over, F.row_number().over(W.partitionBy(over).orderBy(F.desc("age_min"), "id")))
    return left.withColumn("n", n).crossJoin(F.broadcast(total)).where("n is null or n > excess").select("id", "state")
