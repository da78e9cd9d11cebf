"""Queries of record assembly, validation, selection and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.functions import text as T
from curation.operators import fuzzy, merge, topk
from curation.plans.registry import Rows, query, table

RECORDS = Rows("id int, name string, year int, url string, html string, tuition double, faculty string, deadlines int, requirements int", [
    (1, "MSc A", 2024, "u1", "h", None, None, 0, 0), (2, " ", 2024, "u2", "h", 1.0, None, 0, 0), (3, "MSc C", 0, None, "h", None, "Arts", 2, 0), (4, None, None, "u4", "", 5.0, None, 0, 1), (5, "MSc E", 2025, "u5", "h", None, "Law", 0, 0),
])


@query("p8_rule_validation", f"SELECT id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'name_blank' WHEN coalesce(year, 0) <= 0 THEN 'bad_year' END AS error FROM {RECORDS.sql}")
def rule_validation(spark, d):
    error = F.when(T.blank(F.col("name")), "name_blank").when(F.coalesce("year", F.lit(0)) <= 0, "bad_year")
    return RECORDS.df(spark).select("id", error.alias("error"))


@query("p9_p18_thin_and_content", f"SELECT id, tuition IS NULL AS thin, tuition IS NOT NULL OR deadlines > 0 OR requirements > 0 AS has_content FROM {RECORDS.sql}")
def thin_and_content(spark, d):
    return RECORDS.df(spark).select("id", F.col("tuition").isNull().alias("thin"), (F.col("tuition").isNotNull() | (F.col("deadlines") > 0) | (F.col("requirements") > 0)).alias("has_content"))


@query("s16_failed_pages", f"SELECT id, coalesce(url, '') = '' OR coalesce(html, '') = '' AS failed FROM {RECORDS.sql}")
def failed_pages(spark, d):
    return RECORDS.df(spark).select("id", (T.blank(F.col("url")) | T.blank(F.col("html"))).alias("failed"))


@query("p24_fields_present", f"SELECT id, trim(coalesce(name, '')) <> '' AS name, tuition IS NOT NULL AS tuition, deadlines > 0 AS deadlines FROM {RECORDS.sql}")
def fields_present(spark, d):
    return RECORDS.df(spark).select("id", (~T.blank(F.col("name"))).alias("name"), F.col("tuition").isNotNull().alias("tuition"), (F.col("deadlines") > 0).alias("deadlines"))


SELECTIONS = Rows("id int, raw string", [(1, "1,3-5 x"), (2, "2 2 7-6"), (3, ""), (4, None), (5, "4-4, 9")])


@query("u12_selected_indices", """SELECT * FROM (VALUES (1, '1,3,4,5', 'x'), (2, '2', '7-6'), (3, '', ''), (4, '', ''), (5, '4,9', '')) v(id, selected, invalid)""")
def selected_indices(spark, d):
    """Numbers and ranges to a sorted set; tokens that are neither are returned."""
    parts = F.filter(F.split(F.coalesce("raw", F.lit("")), "[, ]+"), lambda x: x != "")
    low, high = (lambda x: F.regexp_extract(x, "^([0-9]+)", 1).try_cast("int")), (lambda x: F.regexp_extract(x, "([0-9]+)$", 1).try_cast("int"))
    ok = lambda x: x.rlike("^[0-9]+(-[0-9]+)?$") & (low(x) <= high(x))
    numbers = F.flatten(F.transform(F.filter(parts, ok), lambda x: F.sequence(low(x), high(x))))
    return SELECTIONS.df(spark).select("id", F.concat_ws(",", F.array_sort(F.array_distinct(numbers)).cast("array<string>")).alias("selected"), F.concat_ws(" ", F.filter(parts, lambda x: ~ok(x))).alias("invalid"))


HOLD = Rows("idx int, name string", [(1, "a"), (2, "b"), (3, "c")])
PICKED = Rows("idx int", [(1,), (3,), (9,)])


@query("u13_onhold_split", f"SELECT idx, CASE WHEN idx IN (SELECT idx FROM {PICKED.sql}) THEN 'selected' ELSE 'discarded' END AS state FROM {HOLD.sql} UNION ALL SELECT idx, 'invalid' FROM {PICKED.sql} WHERE idx NOT IN (SELECT idx FROM {HOLD.sql})")
def onhold_split(spark, d):
    hold, picked = HOLD.df(spark), PICKED.df(spark)
    chosen = hold.join(picked, "idx", "left_semi").select("idx", F.lit("selected").alias("state"))
    rest = hold.join(picked, "idx", "left_anti").select("idx", F.lit("discarded").alias("state"))
    return chosen.union(rest).union(picked.join(hold, "idx", "left_anti").select("idx", F.lit("invalid")))


@query("u11_paging_absorb", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def paging_absorb(spark, d):
    return merge.first_per_key(table(spark, d, "part").withColumn("k", F.lower("p_name")), ["k"], [F.asc("p_partkey")]).select("p_name", "p_partkey")


ITEMS = Rows("page int, pos int, name string, url string", [(1, 1, "MSc A", "u1"), (1, 2, "msc a", "u2"), (1, 3, "MSc B", "u1"), (1, 4, "MSc B", "u3"), (1, 5, "MSc C", "u2"), (2, 1, "MSc A", "u1")])


@query("u5_greedy_item_dedup", "SELECT * FROM (VALUES (1, 1, 'MSc A', 'u1'), (1, 4, 'MSc B', 'u3'), (1, 5, 'MSc C', 'u2'), (2, 1, 'MSc A', 'u1')) v(page, pos, name, url)")
def greedy_item_dedup(spark, d):
    """In order, an item goes if its URL or its name was kept before."""
    rows = ITEMS.df(spark).withColumn("k", F.lower("name"))
    return fuzzy.greedy_distinct(rows, "page", "pos", ["url", "k"]).drop("k")


@query("f6_t8_taxonomy_top3")
def taxonomy_top3(spark, d):
    """The three best taxonomy entries of each name among those that share a token with it."""
    names = table(spark, d, "part").select("p_name").distinct()
    return topk.best_entries(names, "p_name", names, "p_name", itself=False)


def chunk_end(start: str) -> str:
    """In SQL, where the chunk that starts there ends: at the last paragraph or line break of its second half, else when full."""
    window = f"substr(text, {start} + 1, 1000)"
    at = {mark: f"length(regexp_extract({window}, '(?s)^(.*){mark}', 1))" for mark in (r"\n\n", r"\n")}
    breaks = " ".join(f"WHEN {x} >= 500 THEN {start} + {x}" for x in at.values())
    return f"CASE WHEN length(text) - ({start}) <= 1000 THEN length(text) {breaks} ELSE {start} + 1000 END"


@query("f11_chunks", f"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS chunk, 0::BIGINT AS s, {chunk_end("0")} AS e FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text, chunk + 1, e - 200, {chunk_end("(e - 200)")} FROM c WHERE e < length(text))
SELECT doc_id, chunk::INT AS chunk, (e - s)::INT AS n, sha256(substr(text, s + 1, e - s)) AS digest FROM c""")
def chunked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(fuzzy.chunks(F.col("text"), 1000)).alias("chunk", "part"))
    return docs.select("doc_id", "chunk", F.length("part").alias("n"), F.sha2("part", 256).alias("digest"))


@query("f44_selector_text")
def selector_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(fuzzy.selected_text(F.col("html"), "p")).alias("paragraphs"), F.concat_ws(" | ", fuzzy.selected_text(F.col("html"), "h1")).alias("heading"))


SCORED = Rows("job int, url string, score double, pos int", [(1, "a", 0.95, 1), (1, "b", 0.93, 2), (2, "a", 0.95, 1), (2, "b", 0.5, 2), (3, "a", 0.1, 1)] + [(4, f"u{i}", 0.99, i) for i in range(11)])


@query("t9_p22_auto_run", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, pos) AS n FROM {SCORED.sql} WHERE score >= 0.4),
j AS (SELECT DISTINCT job FROM {SCORED.sql}), c AS (SELECT job, count(*) AS n, bool_and(score >= 0.92) AS sure FROM k GROUP BY job)
SELECT j.job, coalesce(n, 0) AS kept, CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidates_above_keep_threshold' WHEN n > 10 THEN 'candidate_count_exceeds_auto_limit' WHEN NOT sure THEN 'confidence_below_auto_threshold' ELSE 'run' END AS decision FROM j LEFT JOIN c USING (job)""")
def auto_run(spark, d):
    good = F.col("score") >= 0.4
    g = SCORED.df(spark).groupBy("job").agg(F.count_if(good).alias("kept"), F.bool_and(F.when(good, F.col("score") >= 0.92)).alias("sure"))
    decision = F.when(F.col("kept") == 0, "no_candidates_above_keep_threshold").when(F.col("kept") > 10, "candidate_count_exceeds_auto_limit").when(~F.col("sure"), "confidence_below_auto_threshold").otherwise("run")
    return g.select("job", "kept", decision.alias("decision"))


ERRORS = Rows("message string", [("net::ERR_CONNECTION_REFUSED at x",), ("timeout",), ("Connection refused",), (None,)])


@query("p25_connection_refused", f"SELECT message, coalesce(regexp_matches(lower(message), 'connection[_ ]refused'), false) AS refused FROM {ERRORS.sql}")
def connection_refused(spark, d):
    return ERRORS.df(spark).select("message", F.coalesce(F.lower("message").rlike("connection[_ ]refused"), F.lit(False)).alias("refused"))


ARGS = Rows("slug string, year int, scope string, lim int, everything boolean, low double, high double", [("hku", 2024, " Non_Local ", 5, False, 0.4, 0.9), ("HKU!", 0, "x", None, False, 0.9, 0.4), ("ln", 2025, None, 3, True, 0.4, 0.4)])


@query("p20_p21_p23_arguments", f"""
SELECT slug, regexp_matches(slug, '^[a-z0-9-]+$') AS slug_ok, year > 0 AS year_ok, CASE WHEN lower(trim(scope)) IN ('local', 'non_local', 'all') THEN lower(trim(scope)) END AS scope,
 (lim IS NULL) = everything AS range_ok, low <= high AS thresholds_ok FROM {ARGS.sql}""")
def arguments(spark, d):
    s = F.lower(F.trim("scope"))
    return ARGS.df(spark).select(
        "slug", F.col("slug").rlike("^[a-z0-9-]+$").alias("slug_ok"), (F.col("year") > 0).alias("year_ok"), F.when(s.isin("local", "non_local", "all"), s).alias("scope"),
        (F.col("lim").isNull() == F.col("everything")).alias("range_ok"), (F.col("low") <= F.col("high")).alias("thresholds_ok"),
    )
