"""Queries of the MERGE-shaped writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.functions import text as T
from curation.functions import urls as U
from curation.operators import merge
from curation.plans import star
from curation.plans.registry import Rows, query, table
from curation.plans.star import CTE
from curation.plans.text import KEY
from curation.plans.urls import canonical

OLD = Rows("catalog_key string, year int, name string, tuition double, faculty string", [("a", 2024, "MSc A", 10.0, "Arts"), ("b", 2024, "MSc B", None, None), ("c", 2023, "MSc C", 5.0, "Law")])
NEW = Rows("catalog_key string, year int, name string, tuition double, faculty string", [("a", 2024, "", 12.0, " "), ("b", 2024, "MSc B2", None, "Sci"), ("d", 2024, "MSc D", 1.0, None)])


@query("w1_upsert_programmes", f"""
SELECT coalesce(o.catalog_key, n.catalog_key) AS catalog_key, coalesce(o.year, n.year) AS year, coalesce(CASE WHEN trim(n.name) <> '' THEN n.name END, o.name) AS name, coalesce(n.tuition, o.tuition) AS tuition,
 coalesce(CASE WHEN trim(n.faculty) <> '' THEN n.faculty END, o.faculty) AS faculty, CASE WHEN n.catalog_key IS NOT NULL THEN o.catalog_key IS NULL END AS created
FROM {OLD.sql} o FULL JOIN {NEW.sql} n ON o.catalog_key = n.catalog_key AND o.year = n.year""")
def upsert_programmes(spark, d):
    return merge.upserted(OLD.df(spark), NEW.df(spark), ["catalog_key", "year"])


@query("w1_upsert_orders", """
WITH o AS (SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_totalprice) AS price FROM orders WHERE year(o_orderdate) <= 1996 GROUP BY 1),
n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_totalprice) AS price FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price, CASE WHEN n.k IS NOT NULL THEN o.k IS NULL END AS created FROM o FULL JOIN n ON o.k = n.k""")
def upsert_orders(spark, d):
    def snapshot(years):
        last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
        return table(spark, d, "orders").where(years).groupBy(F.col("o_custkey").alias("k")).agg(last.alias("status"), F.max("o_totalprice").alias("price"))

    return merge.upserted(snapshot("year(o_orderdate) <= 1996"), snapshot("year(o_orderdate) = 1997"), ["k"])


KEYS = Rows("code string, name string, url string", [(" HKU#MSC ", "x", "https://a.b/c"), (None, "MSc Data!", "https://A.b/C/"), ("", "MSc Data!", None), (None, None, ""), (None, "---", "ftp"), ])


@query("w2_catalog_key", f"""
SELECT name, url, CASE WHEN trim(coalesce(code, '')) <> '' THEN 'group:' || lower(trim(code)) WHEN {canonical("coalesce(url, '')")} IS NOT NULL THEN 'url:' || ({canonical("coalesce(url, '')")})
 ELSE 'name:' || coalesce(nullif(trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unnamed') END AS key FROM {KEYS.sql}""")
def catalog_key(spark, d):
    url = U.canonical(F.col("url"))
    key = F.when(~T.blank(F.col("code")), F.concat(F.lit("group:"), F.lower(F.trim("code")))).when(url.isNotNull(), F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("name:"), T.slug(F.col("name"), "unnamed")))
    return KEYS.df(spark).select("name", "url", key.alias("key"))


@query("w4_child_actions", CTE + """,
o AS (SELECT catalog_id, status, max(tuition) AS tuition FROM program WHERE academic_year = 1996 GROUP BY 1, 2), n AS (SELECT catalog_id, status, max(tuition) AS tuition FROM program WHERE academic_year = 1997 GROUP BY 1, 2)
SELECT coalesce(o.catalog_id, n.catalog_id) AS catalog_id, coalesce(o.status, n.status) AS status, coalesce(n.tuition, o.tuition) AS tuition,
 CASE WHEN o.catalog_id IS NULL THEN 'insert' WHEN n.catalog_id IS NULL THEN 'delete' WHEN o.tuition = n.tuition THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.catalog_id = n.catalog_id AND o.status = n.status""")
def child_actions(spark, d):
    def year(y):
        return star.program(spark, d).where(F.col("academic_year") == y).groupBy("catalog_id", "status").agg(F.max("tuition").alias("tuition"))

    return merge.child_actions(year(1996), year(1997), ["catalog_id", "status"], ["tuition"])


@query("w5_u8_valid_fees", CTE + "SELECT program_id, scope, mode, amount FROM (SELECT *, row_number() OVER (PARTITION BY program_id, scope, mode ORDER BY line) AS n FROM fee WHERE amount > 0 AND basis IN ('per_programme', 'per_year') AND scope IN ('R', 'A')) WHERE n = 1")
def valid_fees(spark, d):
    """The first valid fee of each key; of rows with one line number, that which comes first in the table."""
    ok = (F.col("amount") > 0) & F.col("basis").isin("per_programme", "per_year") & F.col("scope").isin("R", "A")
    first = [F.asc("line"), *map(F.asc, star.PLACE)]
    return merge.first_per_key(star.fee(spark, d, placed=True).where(ok), ["program_id", "scope", "mode"], first).select("program_id", "scope", "mode", "amount")


@query("w7_evidence_hash", "SELECT DISTINCT sha256(concat_ws('|', coalesce(url, ''), '', 'css', coalesce(CAST(page_id % 5 AS VARCHAR), ''))) AS content_hash FROM pages")
def evidence_hash(spark, d):
    empty = F.lit("")
    return table(spark, d, "pages").select(F.sha2(F.concat_ws("|", F.coalesce("url", empty), empty, F.lit("css"), (F.col("page_id") % 5).cast("string")), 256).alias("content_hash")).distinct()


@query("w8_requirement_versions", CTE + """,
s AS (SELECT catalog_id, academic_year, string_agg(DISTINCT status, ',' ORDER BY status) AS mark FROM program WHERE academic_year IN (1996, 1997) GROUP BY 1, 2),
c AS (SELECT *, lag(mark) OVER (PARTITION BY catalog_id ORDER BY academic_year) AS before FROM s), v AS (SELECT * FROM c WHERE before IS NULL OR before <> mark)
SELECT catalog_id, mark, academic_year, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY academic_year) AS INTEGER) AS version_no, lead(academic_year) OVER (PARTITION BY catalog_id ORDER BY academic_year) AS valid_to FROM v""")
def requirement_versions(spark, d):
    """Version 1 from the first year's requirement sets, then the next year's sets merged in."""
    def year(y):
        rows = star.program(spark, d).where(F.col("academic_year") == y)
        return rows.groupBy("catalog_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("status"))).alias("mark")).withColumn("academic_year", F.lit(y))

    first = year(1996).withColumns({"version_no": F.lit(1), "valid_to": F.lit(None).cast("int")})
    return merge.versioned(first, year(1997), "catalog_id", "mark", "academic_year")


@query("w11_cascading_delete", CTE + """
SELECT (SELECT count(*) FROM program WHERE academic_year <> 1995) AS programmes, (SELECT count(*) FROM fee WHERE program_id NOT IN (SELECT program_id FROM program WHERE academic_year = 1995)) AS fees""")
def cascading_delete(spark, d):
    p = star.program(spark, d)
    left, children = merge.deleted(p, {"fee": star.fee(spark, d)}, p.where("academic_year = 1995"), "program_id")
    return left.agg(F.count(F.lit(1)).alias("programmes")).crossJoin(F.broadcast(children["fee"].agg(F.count(F.lit(1)).alias("fees"))))


@query("w12_p17_patch", f"SELECT catalog_key, year, CASE WHEN catalog_key = 'a' THEN 'MSc New' ELSE name END AS name, CASE WHEN catalog_key = 'a' THEN NULL ELSE tuition END AS tuition, faculty FROM {OLD.sql}")
def patch(spark, d):
    return merge.patched(OLD.df(spark), {"name": "MSc New", "tuition": None}, F.col("catalog_key") == "a", ["name", "tuition", "faculty"])


PATCHES = Rows("o_orderkey long, status string", [(1, "X"), (2, "F"), (-5, "F"), (3, None)])


@query("w13_batch_patch_errors", f"""
SELECT p.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'not_found' WHEN p.status IS NULL THEN 'empty_patch' WHEN p.status NOT IN ('F', 'O', 'P') THEN 'invalid_value' ELSE 'ok' END AS code FROM {PATCHES.sql} p LEFT JOIN orders o USING (o_orderkey)""")
def batch_patch_errors(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(True).alias("found"))
    code = F.when(F.col("found").isNull(), "not_found").when(F.col("status").isNull(), "empty_patch").when(~F.col("status").isin("F", "O", "P"), "invalid_value").otherwise("ok")
    return PATCHES.df(spark).join(o, "o_orderkey", "left").select("o_orderkey", code.alias("code"))


@query("w14_quarantine_latest", "SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95) GROUP BY 1, 2")
def quarantine_latest(spark, d):
    """Newest entry per key, minus the keys that have succeeded since."""
    e = table(spark, d, "events")
    done = e.where("event_type = 'purchase' and value > 95").select("user_id")
    return e.where("event_type <> 'purchase'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id")).join(done, "user_id", "left_anti").select("user_id", "event_type", "event_id")


@query("w19_recomputed_codes", f"SELECT p_partkey, 'u#' || {KEY.replace('{c}', 'p_name')} AS code FROM part WHERE 'u#' || {KEY.replace('{c}', 'p_name')} <> 'u#' || lower(p_name)")
def recomputed_codes(spark, d):
    code = T.group_code(F.lit("u"), F.col("p_name"))
    return table(spark, d, "part").where(code != F.concat(F.lit("u#"), F.lower("p_name"))).select("p_partkey", code.alias("code"))


@query("w20_last_event_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def last_event_state(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


DERIVED = Rows("program_id int, mode string, scope string, amount double", [(1, "FullTime", "all", 10.0), (2, "PartTime", "all", 7.0)])
EXISTING = Rows("program_id int, mode string, scope string, amount double", [(1, "FullTime", "all", 9.0), (3, "FullTime", "local", 1.0)])


@query("w23_append_absent_fee", f"SELECT * FROM {EXISTING.sql} UNION ALL SELECT * FROM {DERIVED.sql} d WHERE NOT EXISTS (SELECT 1 FROM {EXISTING.sql} e WHERE e.program_id = d.program_id AND e.mode = d.mode AND e.scope = d.scope)")
def append_absent_fee(spark, d):
    old = EXISTING.df(spark)
    return old.unionByName(DERIVED.df(spark).join(old, ["program_id", "mode", "scope"], "left_anti"))


LEARN = Rows("enabled boolean, name string, confidence double", [(False, "MSc", 0.9), (True, " ", 0.9), (True, "News", 0.9), (True, "MSc Law", 1.5), (True, "MSc Law", None), (True, "MSc Law", 0.7)])


@query("w24_learn_reasons", f"SELECT enabled, name, confidence, CASE WHEN NOT enabled THEN 'disabled' WHEN trim(name) = '' THEN 'empty' WHEN lower(name) = 'news' THEN 'noise' WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'invalid_confidence' ELSE 'learned' END AS outcome FROM {LEARN.sql}")
def learn_reasons(spark, d):
    c = F.col("confidence")
    outcome = F.when(~F.col("enabled"), "disabled").when(T.blank(F.col("name")), "empty").when(T.noise_name(F.col("name")), "noise").when(c.isNull() | ~c.between(0, 1), "invalid_confidence").otherwise("learned")
    return LEARN.df(spark).select("enabled", "name", "confidence", outcome.alias("outcome"))


@query("w28_label_rename", "SELECT event_id, CASE event_type WHEN 'view' THEN 'FETCH_RAW' WHEN 'click' THEN 'EXTRACT' ELSE upper(event_type) END AS stage, CAST(ts AS DATE) AS day FROM events")
def label_rename(spark, d):
    renamed = F.coalesce(F.try_element_at(F.create_map(F.lit("view"), F.lit("FETCH_RAW"), F.lit("click"), F.lit("EXTRACT")), F.col("event_type")), F.upper("event_type"))
    return table(spark, d, "events").select("event_id", renamed.alias("stage"), F.to_date("ts").alias("day"))
