"""Queries of intake and staged jobs on their own columns: JSON sources, external records, routing, crawls, cases, overrides."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import money as M
from curation.functions import text as T
from curation.functions import urls as U
from curation.functions import vocabulary as V
from curation.operators import fuzzy, merge, series
from curation.plans.registry import Rows, query, table

PAYLOADS = Rows("page int, body string", [
    (1, '{"data":{"items":[{"title":{"en":"MSc A &amp; B"},"link":"https://x.edu/a"},{"title":{"en":" msc a & b "},"link":"https://x.edu/b"},{"title":{"en":"News"},"link":"https://x.edu/n"},{"title":{},"link":"https://x.edu/o"},{"title":{"en":"MA C"}}]}}'),
    (2, '{"data":{"items":[]}}'), (3, "not json"), (4, '{"data":{"items":"x"}}'),
])


@query("s9_json_api_items", "SELECT * FROM (VALUES (1, true, 'MSc A & B', 'https://x.edu/a'), (1, true, 'MA C', NULL), (2, false, NULL, NULL), (3, false, NULL, NULL), (4, false, NULL, NULL)) v(page, usable, name, url)")
def json_api_items(spark, d):
    """Items at a dotted path of a JSON answer, names unescaped, without noise and each name once; usable if there are any items."""
    items = F.try_variant_get(F.try_parse_json("body"), "$.data.items", "array<variant>")
    rows = PAYLOADS.df(spark).withColumn("items", items).select("page", (F.coalesce(F.size("items"), F.lit(0)) > 0).alias("usable"), F.posexplode_outer("items").alias("pos", "i"))
    name = F.trim(U.unescaped(F.try_variant_get("i", "$.title.en", "string")))
    named = rows.where("usable").select("page", "usable", "pos", name.alias("name"), F.try_variant_get("i", "$.link", "string").alias("url")).where(~T.noise_name(F.col("name")))
    named = merge.first_per_key(named.withColumn("k", F.lower("name")), ["page", "k"], [F.asc("pos")]).select("page", "usable", "name", "url")
    return named.unionByName(rows.where("not usable").select("page", "usable", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("url")))


SUBMITTED = Rows("idx int, item string", [(0, '{"name_en":"MSc A","tuition":5}'), (1, '["x"]'), (2, '{"name_en":" "}'), (3, '{"name_en":"MSc B","tuition":7}'), (4, '{"name_en":"MSc A","tuition":null}'), (5, '"MSc"'), (6, '{"tuition":1}')])
STORED = Rows("name_en string, tuition int", [("MSc B", 6), ("MSc Z", 1)])


@query("s12_external_ingest", """SELECT * FROM (VALUES (false, 0, 'created'), (false, 1, 'invalid_item_type'), (false, 2, 'missing_name_en'), (false, 3, 'updated'), (false, 4, 'updated'), (false, 5, 'invalid_item_type'), (false, 6, 'missing_name_en'),
 (true, 0, 'parsed'), (true, 1, 'invalid_item_type'), (true, 2, 'missing_name_en'), (true, 3, 'parsed'), (true, 4, 'parsed'), (true, 5, 'invalid_item_type'), (true, 6, 'missing_name_en')) v(dry_run, idx, outcome)""")
def external_ingest(spark, d):
    """Each submitted item's error code or outcome: created, updated (stored, or named by an earlier item), parsed in a dry run."""
    v = F.try_parse_json("item")
    rows = SUBMITTED.df(spark).select("idx", F.startswith(F.schema_of_variant(v), F.lit("OBJECT")).alias("object"), F.try_variant_get(v, "$.name_en", "string").alias("name_en"))
    error = F.when(~F.col("object"), "invalid_item_type").when(T.blank(F.col("name_en")), "missing_name_en")
    rows = rows.withColumn("error", error).join(STORED.df(spark).select("name_en", F.lit(True).alias("stored")), "name_en", "left")
    again = F.row_number().over(W.partitionBy("name_en", F.col("error").isNull()).orderBy("idx")) > 1
    real = F.coalesce("error", F.when(F.col("stored") | again, "updated").otherwise("created"))
    return rows.select("idx", real.alias("real"), F.coalesce("error", F.lit("parsed")).alias("dry")).unpivot("idx", ["real", "dry"], "run", "outcome").select((F.col("run") == "dry").alias("dry_run"), "idx", "outcome")


@query("s12_external_ingest_merged", "SELECT * FROM (VALUES ('MSc A', 5, true), ('MSc B', 7, false), ('MSc Z', 1, NULL)) v(name_en, tuition, created)")
def external_ingest_merged(spark, d):
    """The stored table after the ingest: of an item that comes twice the given values of the later one count."""
    v = F.try_parse_json("item")
    rows = SUBMITTED.df(spark).select("idx", F.try_variant_get(v, "$.name_en", "string").alias("name_en"), F.try_variant_get(v, "$.tuition", "int").alias("tuition")).where(~T.blank(F.col("name_en")))
    last = rows.groupBy("name_en").agg(F.max_by("tuition", F.when(F.col("tuition").isNotNull(), F.col("idx"))).alias("tuition"))
    return merge.upserted(STORED.df(spark), last, ["name_en"])


FILES = Rows("path string", [("a/List.XLSX",), ("b.pdf",), ("c.Pdf",), ("d.xls",), ("e.csv",), ("noext",)])
RAW = Rows("id int, tuition_raw string, tuition double, duration_raw string, options int, deadline_raw string, deadlines int, requirement_raw string, requirements int", [
    (1, "HK$ 1", None, None, None, None, None, None, None), (2, "HK$ 1", 1.0, "1 year", None, None, None, None, None), (3, "x", 1.0, "1 year", 1, "May", 1, "IELTS", 1), (4, None, None, None, None, None, None, "", None), (5, None, None, None, None, "soon", None, None, None), (6, None, None, None, None, None, None, "CV", None),
])


@query("s17_file_routes", "SELECT * FROM (VALUES ('a/List.XLSX', 'excel'), ('b.pdf', 'pdf'), ('c.Pdf', 'pdf'), ('d.xls', 'excel'), ('e.csv', 'excel'), ('noext', 'excel')) v(path, route)")
def file_routes(spark, d):
    """PDF by its suffix, whatever its case; any other file goes the way of sheets."""
    return FILES.df(spark).select("path", F.when(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)) == ".pdf", "pdf").otherwise("excel").alias("route"))


@query("s17_needs_parsing", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, true), (6, true)) v(id, needs)")
def needs_parsing(spark, d):
    """Raw text is there for a field whose parsed value is not."""
    pairs = [("tuition_raw", "tuition"), ("duration_raw", "options"), ("deadline_raw", "deadlines"), ("requirement_raw", "requirements")]
    open_ = F.lit(False)
    for raw, value in pairs:
        open_ = open_ | ((F.coalesce(raw, F.lit("")) != "") & F.col(value).isNull())
    return RAW.df(spark).select("id", open_.alias("needs"))


JUDGED = Rows("id int, name string, matches array<string>, scores array<double>", [
    (1, "", [], []), (2, "AB", [], []), (3, "News", [], []), (4, "MSc Law", [], []), (5, "MSc Law", ["MA Film"], [0.4]), (6, "MSc Law", ["MA Film", "Master of Film"], [0.9, 0.5]), (7, "MSc Law and Economics", ["Law Economics", "MA Film"], [0.6, 0.9]),
    (8, "法律硕士", ["MSc Law"], [0.9]), (9, "MSc Law", ["X", "!"], [0.9, 0.9]), (10, None, None, None), (11, "Law A", ["Law in A B"], [0.5]),
])


@query("p13_suspect_names", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, false), (6, true), (7, false), (8, true), (9, true), (10, true), (11, false)) v(id, suspect)")
def suspect_names(spark, d):
    """Short or noise, or sharing less than half of the tokens of every confident match (score 0.5 or more); tokens have two signs or more."""
    def words(c):
        return F.array_distinct(F.filter(T.tokens(c), lambda x: F.length(x) >= 2))

    sure = F.filter(F.arrays_zip("matches", "scores"), lambda m: m["scores"] >= 0.5)
    own = words(F.col("name"))
    near = F.exists(sure, lambda m: F.size(F.array_intersect(own, words(m["matches"]))) >= 0.5 * F.greatest(F.size(words(m["matches"])), F.lit(1)))
    unlike = (F.coalesce(F.size(sure), F.lit(0)) > 0) & ((F.size(own) == 0) | ~near)
    short = F.length(F.trim(F.coalesce("name", F.lit("")))) < 3
    return JUDGED.df(spark).select("id", (short | T.noise_name(F.col("name")) | F.coalesce(unlike, F.lit(False))).alias("suspect"))


GIVEN = Rows("id int, field string, value string", [(1, "study_mode", " fulltime "), (2, "study_mode", "evening"), (3, "applicant_scope", "NON_LOCAL"), (4, "basis", "Per_Credit"), (5, "currency", "hkd"), (6, "currency", None), (7, "category", "")])
ALLOWED = {"study_mode": V.MODES, "applicant_scope": V.APPLICANTS, "basis": V.BASES, "currency": V.CURRENCY_CODES, "category": V.CATEGORIES}


@query("p21_enum_arguments", """SELECT * FROM (VALUES (1, 'FullTime', NULL), (2, NULL, 'study_mode must be one of: FullTime, Hybrid, PartTime, Unknown'), (3, 'non_local', NULL), (4, 'per_credit', NULL), (5, 'HKD', NULL), (6, NULL, NULL),
 (7, NULL, 'category must be one of: academic_subject, experience, language, other, portfolio, standardized_test')) v(id, canonical, error)""")
def enum_arguments(spark, d):
    """Values matched without case and blanks and given back in canonical spelling; the error names the field and what it may be."""
    allowed = spark.createDataFrame([(f, v, v.lower(), ", ".join(sorted(vs))) for f, vs in ALLOWED.items() for v in vs], "field string, canonical string, k string, list string")
    rows = GIVEN.df(spark).withColumn("k", F.lower(F.trim("value")))
    out = rows.join(F.broadcast(allowed.drop("list")), ["field", "k"], "left").join(F.broadcast(allowed.select("field", "list").distinct()), "field", "left")
    return out.select("id", "canonical", F.when(F.col("value").isNotNull() & F.col("canonical").isNull(), F.concat(F.col("field"), F.lit(" must be one of: "), "list")).alias("error"))


RUNS = Rows("job int, seq int, event string, stage string, attempt int", [
    (1, 1, "start", "fetch_raw", 1), (1, 2, "ok", "fetch_raw", 1), (1, 3, "start", "extract_structured", 1), (1, 4, "ok", "extract_structured", 1), (1, 5, "start", "validate_rules", 1), (1, 6, "ok", "validate_rules", 1), (1, 7, "start", "persist_versioned", 1), (1, 8, "ok", "persist_versioned", 1),
    (2, 1, "start", "fetch_raw", 1), (2, 2, "fail", "fetch_raw", 1), (2, 3, "start", "fetch_raw", 2), (2, 4, "fail", "fetch_raw", 2), (2, 5, "start", "fetch_raw", 3), (2, 6, "fail", "fetch_raw", 3), (3, 1, "start", "fetch_raw", 1), (3, 2, "interrupt", "fetch_raw", 1),
    (4, 1, "start", "fetch_raw", 1), (4, 2, "fail", "fetch_raw", 1), (5, 1, "start", "fetch_raw", 1), (5, 2, "error", "fetch_raw", 1), (6, 1, "start", "fetch_raw", 1), (6, 2, "ok", "fetch_raw", 1), (7, 1, "created", None, None),
])


@query("x1_job_states", "SELECT * FROM (VALUES (1, 'SUCCEEDED', NULL), (2, 'POISONED', 'fetch_raw'), (3, 'CANCELLED', 'fetch_raw'), (4, 'RUNNING', 'fetch_raw'), (5, 'FAILED', 'fetch_raw'), (6, 'RUNNING', 'extract_structured'), (7, 'PENDING', 'fetch_raw')) v(job, status, stage)")
def job_states(spark, d):
    """Replay of a job's events: all stages done is success, more failed attempts of a stage than its two retries poison the
    job, an interrupt cancels it, an error beyond the stages fails it; the stage is the first that has not succeeded."""
    e = RUNS.df(spark)
    done = F.collect_set(F.when(F.col("event") == "ok", F.col("stage")))
    poisoned = F.max(F.when(F.col("event") == "fail", F.col("attempt"))) > 2
    g = e.groupBy("job").agg(done.alias("done"), F.coalesce(poisoned, F.lit(False)).alias("poisoned"), F.max_by("event", "seq").alias("last"), F.bool_or(F.col("event") == "start").alias("begun"))
    left = F.filter(F.array(*map(F.lit, V.STAGES)), lambda s: ~F.array_contains("done", s))
    status = F.when(F.size(left) == 0, "SUCCEEDED").when(F.col("poisoned"), "POISONED").when(F.col("last") == "interrupt", "CANCELLED").when(F.col("last") == "error", "FAILED").when(F.col("begun"), "RUNNING").otherwise("PENDING")
    return g.select("job", status.alias("status"), F.try_element_at(left, F.lit(1)).alias("stage"))


ATTEMPTS = Rows("task int, attempt_count int, max_retries int, failed_at timestamp_ntz", [(t, a, m, dt.datetime(2026, 1, 1)) for t, a, m in ((1, 1, 2), (2, 2, 2), (3, 3, 2), (4, 0, 2), (5, 7, 9), (6, 1, 0))])


@query("x3_retry_or_poison", f"""
SELECT task, CASE WHEN attempt_count > max_retries THEN 'POISONED' ELSE 'RETRY_SCHEDULED' END AS state, CASE WHEN attempt_count > max_retries THEN 0 ELSE CAST(least(pow(2, greatest(attempt_count - 1, 0)), 30) AS INTEGER) END AS backoff,
 CASE WHEN attempt_count <= max_retries THEN failed_at + INTERVAL (CAST(least(pow(2, greatest(attempt_count - 1, 0)), 30) AS INTEGER)) SECOND END AS next_retry_at FROM {ATTEMPTS.sql}""")
def retry_or_poison(spark, d):
    """A failed attempt beyond the retries poisons the task, else the next one is due after twice the wait, thirty seconds at most."""
    over, wait = F.col("attempt_count") > F.col("max_retries"), M.backoff_seconds(F.col("attempt_count"))
    due = F.col("failed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))
    return ATTEMPTS.df(spark).select("task", F.when(over, "POISONED").otherwise("RETRY_SCHEDULED").alias("state"), F.when(over, 0).otherwise(wait).alias("backoff"), F.when(~over, due).alias("next_retry_at"))


CRAWL = Rows("site string, spa boolean, max_pages int, total_pages int, page int, url string, found int, passed boolean", [
    *[("drift", False, 50, 4, p, u, 10, None) for p, u in ((1, "https://x.edu/list/1"), (2, "https://x.edu/list/2"), (3, "https://x.edu/about"), (4, "https://x.edu/list/4"))],
    *[("yield", False, 50, 6, p, f"https://y.edu/l?page={p}", n, True) for p, n in enumerate((50, 48, 50, 5, 9, 9), 1)],
    *[("empty", False, 50, 4, p, f"https://z.edu/l?page={p}", n, None) for p, n in enumerate((9, 0, 0, 9), 1)],
    *[("poor", False, 50, 3, p, f"https://q.edu/l?page={p}", 100, p != 2) for p in (1, 2, 3)],
    *[("capped", False, 2, 9, p, f"https://c.edu/l?page={p}", 10, None) for p in (1, 2)],
    *[("whole", False, 50, 2, p, f"https://w.edu/l?page={p}", 10, None) for p in (1, 2)],
    ("spa", True, 50, 7, 1, "https://s.edu/l", 10, None),
])


@query("x9_crawl_stop", "SELECT * FROM (VALUES ('drift', 'url_drift', 2, 20), ('yield', 'decreasing_yield', 4, 153), ('empty', 'decreasing_yield', 3, 9), ('poor', 'quality_failed', 2, 200), ('capped', 'max_pages', 2, 20), ('whole', 'exhausted', 2, 20), ('spa', 'pagination_not_supported', 1, 10)) v(site, reason, pages, programs)")
def crawl_stop(spark, d):
    """Where a paged crawl ends: a URL that drifts from the first page's shape stops before its page counts, falling yield
    and a failed quality check after it; a crawl without either ran out, met its cap, or could not page at all."""
    w = W.partitionBy("site").orderBy("page")
    rows = CRAWL.df(spark).withColumns({"shape": U.shape(F.col("url")), "first": F.first("url").over(w)})
    rows = series.decreasing_yield(rows.withColumn("drift", F.col("shape") != U.shape(F.col("first"))), ["site"], "page", "found").withColumnRenamed("stop", "falling")
    why = F.when(F.col("drift"), "url_drift").when(F.col("falling"), "decreasing_yield").when(~F.coalesce("passed", F.lit(True)), "quality_failed")
    rows = rows.withColumn("why", why).withColumn("end", F.min(F.when(F.col("why").isNotNull(), F.col("page"))).over(W.partitionBy("site")))
    counts = F.col("end").isNull() | (F.col("page") < F.col("end")) | ((F.col("page") == F.col("end")) & (F.col("why") != "url_drift"))
    g = rows.groupBy("site").agg(
        F.max(F.when(F.col("page") == F.col("end"), F.col("why"))).alias("why"), F.count_if(counts).cast("int").alias("pages"), F.sum(F.when(counts, F.col("found")).otherwise(0)).cast("int").alias("programs"), F.bool_or("spa").alias("spa"),
        F.bool_or((F.col("total_pages") > F.col("max_pages"))).alias("capped"),
    )
    reason = F.coalesce("why", F.when(F.col("spa"), "pagination_not_supported").when(F.col("capped"), "max_pages").otherwise("exhausted"))
    return g.select("site", reason.alias("reason"), "pages", "programs")


FETCHES = Rows("job int, lim int, page int, next_url boolean, usable boolean, names array<string>", [
    (1, 3, 1, True, True, ["A", "B"]), (1, 3, 2, True, True, ["b", "C", "D"]), (1, 3, 3, True, True, ["E"]), (2, None, 1, True, True, ["A"]), (2, None, 2, True, True, ["a"]), (2, None, 3, True, True, ["B"]), (3, None, 1, True, True, ["A"]), (3, None, 2, True, False, ["B"]),
    (4, 9, 1, True, True, ["A"]), (4, 9, 2, False, True, ["B"]), *[(5, None, p, True, True, [f"N{p}"]) for p in range(1, 53)], (6, 1, 1, True, True, ["A", "B"]),
])


@query("x10_index_paging_stop", "SELECT * FROM (VALUES (1, 'reached_limit', 2, 'A,B,C'), (2, 'exhausted', 2, 'A'), (3, 'unusable', 2, 'A'), (4, 'exhausted', 2, 'A,B'), (6, 'reached_limit', 1, 'A')) v(job, reason, pages, names) UNION ALL SELECT 5, 'safety_cap', 50, string_agg('N' || i, ',' ORDER BY i) FROM range(1, 51) t(i)")
def index_paging_stop(spark, d):
    """Index pages absorbed in turn, each name once: the limit, fifty pages, no further page, an unusable one or one without
    a new name ends it."""
    f = FETCHES.df(spark)
    items = f.where("usable or page = 1").select("job", "page", F.posexplode("names").alias("pos", "name")).withColumn("k", F.lower("name"))
    items = merge.first_per_key(items, ["job", "k"], [F.asc("page"), F.asc("pos")])
    rows = f.join(items.groupBy("job", "page").agg(F.count(F.lit(1)).alias("fresh")), ["job", "page"], "left").fillna(0, "fresh")
    held = F.sum("fresh").over(W.partitionBy("job").orderBy("page"))
    full = F.coalesce(held >= F.col("lim"), F.lit(False))
    after = F.when((F.col("page") > 1) & ~F.col("usable"), "unusable").when((F.col("page") > 1) & (F.col("fresh") == 0), "exhausted").when(full, "reached_limit").when(F.col("page") >= 50, "safety_cap").when(~F.col("next_url"), "exhausted")
    stop = rows.withColumn("why", after).where("why is not null").groupBy("job").agg(F.min(F.struct("page", "why")).alias("s"))
    kept = items.join(stop, "job").where((F.col("page") < F.col("s.page")) | ((F.col("page") == F.col("s.page")) & (F.col("s.why") != "unusable"))).join(f.select("job", "lim").distinct(), "job")
    kept = kept.withColumn("n", F.row_number().over(W.partitionBy("job").orderBy("page", "pos"))).where("lim is null or n <= lim")
    names = kept.groupBy("job").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"])).alias("names"))
    return stop.join(names, "job").select("job", F.col("s.why").alias("reason"), F.col("s.page").alias("pages"), "names")


CASES = Rows("id int, name string, tuition_currency string, tuition_url string, modes array<string>, option_urls array<string>, categories array<string>, requirement_urls array<string>, required array<string>", [
    (1, "MSc A", "HKD", "u", ["FullTime"], ["u"], ["language"], ["u"], ["name_en", "tuition", "requirements"]), (2, " ", "OTHER", None, ["Unknown", "Unknown", "FullTime"], ["u", None, None], ["magic"], [None], ["name_en", "tuition", "study_options", "requirements"]),
    (3, "MA B", None, None, [], [], [], [], []), (4, "MA B", None, None, [], [], [], [], ["tuition", "name_en"]), (5, "MBA", "XXX", "u", ["Evening"], ["u"], [], [], ["tuition"]),
])


@query("a14_case_part_scores", "SELECT id, round(c, 6) AS completeness, round(n, 6) AS normalization, round(e, 6) AS evidence FROM (VALUES (1, 1.0, 1.0, 1.0), (2, 0.75, (0.4 + 0.4 + 0.0) / 3, (0.0 + 1.0 / 3 + 0.0) / 3), (3, 1.0, 1.0, 1.0), (4, 0.5, 1.0, 0.0), (5, 1.0, (0.0 + 0.0 + 1.0) / 3, 1.0)) v(id, c, n, e)")
def case_part_scores(spark, d):
    """How many required fields are there (the name alone if none is required), how many typed values are allowed ones, and
    what share of the rows of each field has evidence."""
    c = F.col
    present = F.create_map(F.lit("name_en"), ~T.blank(c("name")), F.lit("tuition"), c("tuition_currency").isNotNull(), F.lit("study_options"), F.size("modes") > 0, F.lit("requirements"), F.size("categories") > 0)
    fields = F.when(F.size("required") > 0, c("required")).otherwise(F.array(F.lit("name_en")))
    complete = F.size(F.filter(fields, lambda x: F.coalesce(F.try_element_at(present, x), F.lit(False)))) / F.size(fields)
    money = F.when(c("tuition_currency").isNull(), 1.0).when(~c("tuition_currency").isin(V.CURRENCY_CODES), 0.0).when(c("tuition_currency") == "OTHER", 0.4).otherwise(1.0)
    unknown = F.size(F.filter("modes", lambda x: x == "Unknown"))
    modes = F.when(F.exists("modes", lambda x: ~x.isin(V.MODES)), 0.0).otherwise(1.0 - F.least(F.lit(0.6), 0.3 * unknown))
    kinds = F.when(F.forall("categories", lambda x: x.isin(V.CATEGORIES)), 1.0).otherwise(0.0)

    def share(urls):
        return F.when(F.size(urls) > 0, F.size(F.array_compact(urls)) / F.size(urls))

    checks = F.array_compact(F.array(F.when(c("tuition_currency").isNotNull(), F.when(c("tuition_url").isNotNull(), 1.0).otherwise(0.0)), share("option_urls"), share("requirement_urls")))
    wanted = F.arrays_overlap("required", F.array(*map(F.lit, ["tuition", "study_options", "deadlines", "requirements"])))
    evidence = F.when(F.size(checks) > 0, F.aggregate(checks, F.lit(0.0), lambda a, x: a + x) / F.size(checks)).when(wanted, 0.0).otherwise(1.0)
    return CASES.df(spark).select("id", F.round(complete, 6).alias("completeness"), F.round((money + modes + kinds) / 3, 6).alias("normalization"), F.round(evidence, 6).alias("evidence"))


SAMPLES = Rows("case_id string, kind string, url string, status int, html string, already boolean", [
    ("a", "index", "u1", 200, "h", False), ("a", "detail", "u2", 204, "h", False), ("b", "index", "u", 200, "h", False), ("b", "detail", " ", None, None, False), ("c", "index", "u", 404, "h", False), ("c", "detail", "u", 200, "h", False), ("d", "index", "u", 200, "", True), ("d", "detail", "u", 500, None, True), ("e", "index", "u", 200, "", False), ("e", "detail", "u", 299, "h", False),
])


@query("a24_collection_report", "SELECT * FROM (VALUES ('a', 'ok', ''), ('b', 'failed', 'missing detail_url'), ('c', 'failed', 'index 404'), ('d', 'skipped', ''), ('e', 'failed', 'index 200'), (NULL, 'collected=1 skipped=1 failures=3', '')) v(case_id, status, errors)")
def collection_report(spark, d):
    """Cases whose two pages both came with a 2xx status and a body are collected, those on disk already are skipped, others
    failed with a reason per page; the last row has the counts."""
    ok = F.col("status").between(200, 299) & (F.coalesce("html", F.lit("")) != "")
    error = F.when(F.col("already"), None).when(T.blank(F.col("url")), F.concat(F.lit("missing "), "kind", F.lit("_url"))).when(~F.coalesce(ok, F.lit(False)), F.concat_ws(" ", "kind", "status"))
    g = SAMPLES.df(spark).withColumn("error", error).groupBy("case_id").agg(F.bool_or("already").alias("already"), F.array_sort(F.collect_list("error")).alias("errors"))
    cases = g.select("case_id", F.when(F.col("already"), "skipped").when(F.size("errors") == 0, "ok").otherwise("failed").alias("status"), F.concat_ws("|", "errors").alias("errors"))
    n = lambda s: F.count_if(F.col("status") == s)
    total = cases.agg(F.concat(F.lit("collected="), n("ok"), F.lit(" skipped="), n("skipped"), F.lit(" failures="), n("failed")).alias("status"))
    return cases.unionByName(total.select(F.lit(None).cast("string").alias("case_id"), "status", F.lit("").alias("errors")))


OVERRIDES = Rows("id int, slug string, name string, code string, enabled boolean, override boolean, low double, high double, matches array<string>, scores array<double>", [
    (1, "hku", "Faculty of Law", "hku#x", True, True, 0.4, 0.9, ["MSc Law", "MA Law"], [0.95126, 0.6]), (2, "hku", "MSc-Law", "hku#msclaw", True, True, 0.4, 0.9, ["MSc Law"], [0.99]), (3, "hku", "MA Art", "hku#maart", True, True, 0.4, 0.9, ["MSc Law"], [0.89]),
    (4, "hku", "MA Art", "hku#maart", True, False, 0.4, 0.9, ["MSc Law"], [0.99]), (5, "", "MA Art", None, True, True, 0.4, 0.9, ["MSc Law"], [0.9]), (6, "hku", "MA Art", "hku#maart", True, True, 0.4, 0.9, [], []),
])


@query("f51_taxonomy_override", """SELECT * FROM (VALUES (1, 'MSc Law', 'hku#msclaw', true, 0.9513, 'MSc Law 0.95126|MA Law 0.6'), (2, 'MSc-Law', 'hku#msclaw', false, 0.99, 'MSc Law 0.99'), (3, 'MA Art', 'hku#maart', false, 0.89, 'MSc Law 0.89'), (4, 'MA Art', 'hku#maart', false, 0.99, 'MSc Law 0.99'),
 (5, 'MSc Law', NULL, true, 0.9, 'MSc Law 0.9'), (6, 'MA Art', 'hku#maart', false, 0.0, '')) v(id, name, code, override_applied, best_score, matches)""")
def taxonomy_override(spark, d):
    """The best match replaces a name that is noise or another one, from the high threshold on; the trace keeps what was matched."""
    zipped = F.array_sort(F.transform(F.arrays_zip("matches", "scores"), lambda m: F.struct((-m["scores"]).alias("s"), m["matches"].alias("n"))))
    best = F.try_element_at(zipped, F.lit(1))
    score = F.coalesce(-best["s"], F.lit(0.0))
    unlike = T.noise_name(F.col("name")) | (T.squashed(F.col("name")) != T.squashed(best["n"]))
    hit = F.coalesce(F.col("enabled") & F.col("override") & (score >= F.col("high")) & unlike, F.lit(False))
    trace = F.struct("enabled", F.bround(score, 4).alias("best_score"), F.col("low").alias("low_threshold"), F.col("high").alias("high_threshold"), hit.alias("override_applied"), F.transform(zipped, lambda m: F.concat_ws(" ", m["n"], (-m["s"]).cast("string"))).alias("matches"))
    out = OVERRIDES.df(spark).select("id", F.when(hit, best["n"]).otherwise(F.col("name")).alias("name"), F.when(hit & (F.col("slug") != ""), T.group_code(F.col("slug"), best["n"])).otherwise(F.col("code")).alias("code"), trace.alias("trace"))
    return out.select("id", "name", "code", "trace.override_applied", "trace.best_score", F.concat_ws("|", "trace.matches").alias("matches"))


RECORDS = Rows("id int, markdown string, anchor string, title string, hints array<string>, faculty string, tuition double, dates array<string>, url string", [
    (1, "# MSc Data", "x", "t", [], "Arts", 5.0, ["2025-03-01", "2024-12-01", None], "u1"), (2, "text", "MA Law", "t", [], None, None, [], "u2"), (3, "text", "Visit website", "MBA | Uni", [], None, None, [], "u3"), (4, "text", "News", None, ["About us|0.9", "MA Film|0.8"], "Film", None, [], "u4"), (5, "", "MA", None, [], None, None, [], "u5"), (6, "text", None, None, [], None, None, [], "u6"),
])


@query("f58_record_assembly", """SELECT * FROM (VALUES (1, 'MSc Data', 'hku#mscdata', 'Arts', 5.0, '1 2024-12-01|2 2025-03-01|3', '{"source_url":"u1"}', NULL), (2, 'MA Law', 'hku#malaw', NULL, NULL, '', '{"source_url":"u2"}', NULL), (3, 'MBA', 'hku#mba', NULL, NULL, '', '{"source_url":"u3"}', NULL),
 (4, 'MA Film', 'hku#mafilm', 'Film', NULL, '', '{"source_url":"u4"}', NULL), (5, NULL, NULL, NULL, NULL, '', '{"source_url":"u5"}', 'No markdown content'), (6, NULL, NULL, NULL, NULL, '', '{"source_url":"u6"}', NULL)) v(id, name, code, faculty, tuition, deadlines, metadata, error)""")
def record_assembly(spark, d):
    """Name by heading, else anchor, else title, else hint, each unless it is noise; rounds by date, undated last; group code and metadata."""
    heading = F.nullif(T.heading_text(F.regexp_extract("markdown", r"(?m)^(#{1,3} .+)$", 1)), F.lit(""))
    hint = F.try_element_at(F.filter(F.transform("hints", lambda h: F.split(h, r"\|")[0]), lambda n: ~T.noise_name(n)), F.lit(1))
    good = lambda c: F.when(~T.noise_name(c), F.trim(c))
    name = F.coalesce(heading, good(F.col("anchor")), good(F.trim(F.split("title", r"\|")[0])), hint)
    empty = F.col("markdown") == ""
    rounds = F.concat(F.array_sort(F.array_compact("dates")), F.filter("dates", lambda x: x.isNull()))
    text = F.concat_ws("|", F.transform(rounds, lambda x, i: F.concat_ws(" ", i + 1, x)))
    keep = lambda c: F.when(~empty, c)
    return RECORDS.df(spark).select(
        "id", keep(name).alias("name"), keep(F.when(name.isNotNull(), T.group_code(F.lit("hku"), name))).alias("code"), keep(F.col("faculty")).alias("faculty"), keep(F.col("tuition")).alias("tuition"), text.alias("deadlines"),
        F.to_json(F.struct(F.col("url").alias("source_url"))).alias("metadata"), F.when(empty, "No markdown content").alias("error"),
    )


PAGING = Rows("id int, url string, html string", [
    (1, "https://x.edu/l?sort=a", '<ul class="x"><a href="?page=8">8</a></ul><nav aria-label="Pagination"><nav><a href="?sort=a&amp;page=1">1</a></nav><a href="?sort=a&amp;page=4">4</a><a href="#content">x</a></nav><a href="?page=99">99</a>'),
    (2, "https://x.edu/l", '<a href="/l?p=2">2</a><a href="/l?p=3">3</a><a href="/l?p=5">5</a><a href="/l?offset=10">o</a>'),
    (3, "https://x.edu/l", '<button data-page="1">1</button><button class="b" data-page="3">3</button>'), (4, "https://x.edu/l", "<p>x</p>"),
    (5, "https://x.edu/l", '<ul class="swiper-pagination"><a href="?page=1">1</a><a href="?page=2">2</a></ul>'), (6, "https://x.edu/l", '<ol class="pagination"><a href="?offset=0">1</a><a href="?offset=2">2</a><a href="?start_rank=5">s</a></ol>'), (7, "https://x.edu/l", None),
])


@query("f42_f43_pagination", """SELECT * FROM (VALUES (1, 'url_param', 4, 1, 0.9, 'https://x.edu/l?sort=a&page=1 https://x.edu/l?sort=a&page=2 https://x.edu/l?sort=a&page=3 https://x.edu/l?sort=a&page=4'),
 (2, 'url_param', 4, 1, 0.6, 'https://x.edu/l?p=2 https://x.edu/l?p=3 https://x.edu/l?p=4 https://x.edu/l?p=5'), (3, 'spa_button', 3, 1, 0.7, ''), (4, 'single_page', 1, 1, 1.0, ''), (5, 'single_page', 1, 1, 1.0, ''),
 (6, 'url_param', 3, 1, 0.9, 'https://x.edu/l?offset=0 https://x.edu/l?offset=1 https://x.edu/l?offset=2'), (7, 'single_page', 1, 1, 1.0, '')) v(id, kind, total_pages, current_page, confidence, urls)""")
def pagination(spark, d):
    """Page links within pagination containers (two values of a parameter), else anywhere (three), else numbered buttons,
    else one page; of several parameters the first by priority, and all pages from the least to the greatest value."""
    p = PAGING.df(spark).withColumn("html", F.coalesce("html", F.lit(""))).withColumn("inner", fuzzy.pagination_containers(F.col("html")))
    links = p.select("id", "url", F.explode(F.array(F.struct(F.lit("container").alias("how"), F.concat_ws(" ", "inner").alias("h")), F.struct(F.lit("loose").alias("how"), F.col("html").alias("h")))).alias("s")).select("id", "url", "s.*")
    hrefs = F.regexp_extract_all("h", F.lit(r'(?i)<a\s[^>]*href=["\']([^"\']*)["\'][^>]*>'), F.lit(1))
    rows = links.select("id", "url", "how", F.posexplode(hrefs).alias("pos", "href")).where(~F.startswith("href", F.lit("#"))).withColumn("link", U.resolved(U.unescaped(F.col("href")), F.col("url")))
    names = F.array(*map(F.lit, V.PAGE_PARAMS))
    found = rows.select("id", "how", "pos", "link", F.posexplode(names).alias("rank", "param")).withColumn("value", U.query_value(F.col("link"), F.col("param")).try_cast("int")).where("value is not null")
    g = found.groupBy("id", "how", "rank", "param").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("value").alias("n"), F.min_by("link", "pos").alias("template"))
    g = g.where(((F.col("how") == "container") & (F.col("n") >= 2)) | (F.col("n") >= 3)).groupBy("id").agg(F.min(F.struct("how", "rank", "param", "low", "high", "template")).alias("b"))
    buttons = F.transform(F.regexp_extract_all("html", F.lit(r'(?i)<button[^>]*\bdata-page=["\']([0-9]+)["\'][^>]*>'), F.lit(1)), lambda x: x.cast("int"))
    out = p.withColumn("buttons", F.array_distinct(buttons)).join(g, "id", "left")
    kind = F.when(F.col("b").isNotNull(), "url_param").when(F.size("buttons") >= 2, "spa_button").otherwise("single_page")
    urls = F.transform(F.sequence("b.low", "b.high"), lambda i: U.with_query_value(F.col("b.template"), F.col("b.param"), i))
    inside = F.col("b.how") == "container"
    return out.select(
        "id", kind.alias("kind"), F.when(kind == "url_param", F.col("b.high") - F.col("b.low") + 1).when(kind == "spa_button", F.array_max("buttons")).otherwise(1).alias("total_pages"), F.lit(1).alias("current_page"),
        F.when(kind == "single_page", 1.0).when(kind == "spa_button", 0.7).when(inside, 0.9).otherwise(0.6).alias("confidence"), F.coalesce(F.concat_ws(" ", urls), F.lit("")).alias("urls"),
    )


@query("wn_batches_of_100", "SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100 AS BIGINT) AS batch FROM events")
def batches(spark, d):
    """Every hundred records of a key a batch."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.floor((n - 1) / 100).alias("batch"))
