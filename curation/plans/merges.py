"""Queries of dedup and merge operators on their own columns: requirements, chunks, dimensions, taxonomy, tasks, backfills."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import money as M
from curation.functions import text as T
from curation.functions import urls as U
from curation.operators import fuzzy, merge
from curation.plans import star
from curation.plans.registry import Rows, query, table
from curation.plans.star import CTE

REQS = Rows("program int, pos int, category string, subject string, minimum string, text string", [
    (1, 1, "language", "IELTS", "6.5", "IELTS 6.5 overall"), (1, 2, "Language ", "IELTS", "6.5", "ielts 6.5, overall."), (1, 3, "language", None, "6.50", "Applicants must hold 6.5 in IELTS"), (1, 4, "language", "TOEFL iBT", "80", "TOEFL iBT 80"),
    (1, 5, "language", None, "80", "a TOEFL score of at least 80"), (1, 6, "academic_subject", None, None, "A bachelor degree with honours"), (1, 7, "academic_subject", None, None, "A bachelor degree with honors"), (1, 8, "other", None, None, "degree with honours"),
    (1, 9, "other", "Work", "2", "two years of work experience, 2 posts"), (1, 10, "other", "Work", "3", "two years of work experience, 3 posts"), (1, 11, "language", "CET-6", "430", "CET-6 of 430"), (1, 12, "language", None, "430.0", "430 or more in the CET6"),
    (2, 1, "language", "TOEFL", "80", "TOEFL iBT 80"), (3, 1, "other", None, None, None), (3, 2, "other", None, None, " -- "), (3, 3, "language", "IELTS", "high", "IELTS high"), (3, 4, "language", "IELTS", "HIGH", "a high IELTS"),
])


@query("u9_requirement_dedup", "SELECT * FROM (VALUES (1, 3), (1, 5), (1, 6), (1, 9), (1, 10), (1, 12), (2, 1), (3, 1), (3, 4)) v(program, pos)")
def requirement_dedup(spark, d):
    """Four stages: equal loose text of a category, the same test and threshold, containment, likeness; longer phrasings win."""
    return fuzzy.near_distinct_requirements(REQS.df(spark), "program", "pos").select("program", "pos")


CHUNKS = Rows("page int, chunk int, faculty string, options array<string>, deadlines array<string>", [
    (1, 1, "Arts", ["FullTime 12", "PartTime 24"], ["2025-03-01 R1"]), (1, 2, "", ["FullTime 12"], ["2025-03-01 Round one", " no date", "2025-06-01 R2"]), (1, 3, "Faculty of Arts", None, None), (2, 1, None, [], []), (2, 2, " Law", ["Unknown "], None),
])
CHUNK_FEES = Rows("page int, chunk int, pos int, mode string, scope string, basis string, amount int, source string", [
    (1, 1, 1, "FullTime", "all", "per_programme", 100, "HKD 100"), (1, 2, 1, "FullTime", "all", "per_programme", 110, "Tuition is HKD 110"), (1, 2, 2, "PartTime", "all", "per_programme", 60, None), (1, 3, 1, "FullTime", "all", "per_programme", 120, "Tuition HKD is 120"),
])


@query("u10_chunk_merge", """SELECT * FROM (VALUES (1, 'Faculty of Arts', 'FullTime 12|PartTime 24', '2025-03-01 R1|2025-06-01 R2', 'FullTime all per_programme 110|PartTime all per_programme 60'), (2, ' Law', 'Unknown ', '', '')) v(page, faculty, options, deadlines, fees)""")
def chunk_merge(spark, d):
    """Chunks of a page: the newest non-empty scalar, lists concatenated in order and then deduplicated: options by mode
    and duration, deadlines by date (those without go), fees by mode, scope and basis with the longest evidence."""
    c = CHUNKS.df(spark)
    scalar = F.max_by(F.nullif("faculty", F.lit("")), F.when(F.nullif("faculty", F.lit("")).isNotNull(), F.col("chunk")))

    def joined(name):
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.coalesce(name, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"]))

    merged = c.groupBy("page").agg(scalar.alias("faculty"), joined("options").alias("o"), joined("deadlines").alias("d"))
    dated = F.filter("d", lambda x: F.regexp_extract(x, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1) != "")
    days = F.array_distinct(F.transform(dated, lambda x: F.substring(x, 1, 10)))
    first = F.transform(days, lambda day: F.element_at(F.filter(dated, lambda x: F.startswith(x, day)), 1))
    key = ["page", "mode", "scope", "basis"]
    place = W.partitionBy(*key).orderBy("chunk", "pos")
    fees = CHUNK_FEES.df(spark).withColumn("first", F.struct(F.first("chunk").over(place), F.first("pos").over(place)))
    fees = merge.first_per_key(fees, key, [F.desc(F.length(F.coalesce("source", F.lit("")))), F.asc("chunk"), F.asc("pos")])
    text = F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat_ws(" ", "mode", "scope", "basis", "amount").alias("f")))), lambda x: x["f"])
    fees = fees.groupBy("page").agg(F.concat_ws("|", text).alias("fees"))
    out = merged.select("page", "faculty", F.concat_ws("|", F.array_distinct("o")).alias("options"), F.concat_ws("|", first).alias("deadlines"))
    return out.join(fees, "page", "left").fillna("", "fees").select("page", "faculty", "options", "deadlines", "fees")


SUBJECTS = Rows("normalized string, canonical string, aliases array<string>", [("maths", "Maths", ["Mathematics"]), ("law", "Law", []), ("art", "Art", [])])
NAMED = Rows("pos int, name string", [(1, "MATHS"), (2, "maths "), (3, "Law"), (4, "Physics"), (5, "PHYSICS!"), (6, " "), (7, "Physics"), (8, "日本")])


@query("w6_dimension_upsert", """SELECT * FROM (VALUES ('maths', 'maths', 'Mathematics|Maths|MATHS|maths', false), ('law', 'Law', '', NULL), ('art', 'Art', '', NULL), ('physics', 'Physics', 'Physics|PHYSICS!', true), ('subject', '日本', '', true)) v(normalized, canonical, aliases, created)""")
def dimension_upsert(spark, d):
    """Names merged into a stored dimension by key: the last spelling is canonical, every earlier one an alias once the
    spelling has changed; ``created`` is null where nothing changed."""
    new = NAMED.df(spark).where(~T.blank(F.col("name"))).withColumns({"normalized": T.slug(F.col("name"), "subject"), "name": F.trim("name")})
    new = new.groupBy("normalized").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    both = SUBJECTS.df(spark).join(new, "normalized", "full_outer")
    empty = F.array().cast("array<string>")
    chain = F.concat(F.array_compact(F.array("canonical")), F.coalesce("names", empty))
    changed = F.size(F.array_distinct(chain)) > 1
    aliases = F.when(changed, F.array_distinct(F.concat(F.coalesce("aliases", empty), chain))).otherwise(F.coalesce("aliases", empty))
    return both.select("normalized", F.element_at(chain, -1).alias("canonical"), F.concat_ws("|", aliases).alias("aliases"), F.when(F.col("canonical").isNull(), True).when(changed, False).alias("created"))


TAXONOMY = Rows("normalized string, name_en string, aliases array<string>, source string, first_seen_url string, confidence double", [
    ("mscdata", "MSc Data", ["Data MSc"], "seed", "u0", 0.5), ("malaw", "MA Law", [], "seed", None, None), ("bafilm", "BA Film", [], "learned", "uf", 0.95),
])
PERSISTED = Rows("pos int, name_en string, source_url string, confidence string", [
    (1, "MSC data", None, "0.4"), (2, "MSc-Data", "u2", "0.9"), (3, "News", "u3", "1"), (4, " ", "u4", "1"), (5, "MPhil Art", " ", "x"), (6, "mphil ART", "u6", "7"), (7, "MA Law", "u7", "-1"),
])


@query("w17_taxonomy_learn", """SELECT * FROM (VALUES ('mscdata', 'MSC data', 'Data MSc|MSC data|MSc-Data', 'learned', 'u2', 0.9, 'updated'), ('malaw', 'MA Law', 'MA Law', 'learned', 'u7', 0.0, 'updated'), ('bafilm', 'BA Film', '', 'learned', 'uf', 0.95, 'kept'),
 ('mphilart', 'MPhil Art', 'MPhil Art|mphil ART', 'learned', 'u6', 1.0, 'inserted')) v(normalized, name_en, aliases, source, first_seen_url, confidence, outcome)""")
def taxonomy_learn(spark, d):
    """Persisted names without noise, merged by normalized name (first spelling, greatest confidence within 0 and 1, first
    URL) and then into what is stored: given values win, aliases are united."""
    rows = PERSISTED.df(spark).where(~T.noise_name(F.col("name_en"))).withColumns({"normalized": T.squashed(F.col("name_en")), "url": F.nullif(F.trim("source_url"), F.lit(""))}).where("normalized <> ''")
    sure = F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    new = rows.groupBy("normalized").agg(
        F.min_by(F.trim("name_en"), "pos").alias("n_name"), F.collect_set(F.trim("name_en")).alias("n_aliases"), F.max(sure).alias("n_confidence"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("pos"))).alias("n_url")
    )
    both, empty = TAXONOMY.df(spark).join(new, "normalized", "full_outer"), F.array().cast("array<string>")
    hit = F.col("n_name").isNotNull()
    names = F.when(hit, F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", empty), "n_aliases", F.array("n_name"))))).otherwise(F.col("aliases"))
    return both.select(
        "normalized", F.coalesce("n_name", "name_en").alias("name_en"), F.concat_ws("|", names).alias("aliases"), F.when(hit, "learned").otherwise(F.col("source")).alias("source"), F.coalesce("n_url", "first_seen_url").alias("first_seen_url"),
        F.coalesce("n_confidence", "confidence").alias("confidence"), F.when(~hit, "kept").when(F.col("name_en").isNull(), "inserted").otherwise("updated").alias("outcome"),
    )


CACHE = Rows("domain string, fetch_mode string, success_count int, detail_pattern string", [("x.edu", "server", 3, None), ("y.edu", "client", 1, "hub"), ("q.edu", "server", 9, None)])
CRAWLS = Rows("pos int, url string, fetch_mode string, detail_pattern string", [(1, "https://X.edu/a", "client", None), (2, "https://x.edu/b", "client_wait", None), (3, "https://y.edu/", None, "thin_page_supplement"), (4, "https://z.edu/", "server", None), (5, "https://x.edu/c", None, ""), (6, "bad", "server", None)])


@query("w18_strategy_cache", "SELECT * FROM (VALUES ('x.edu', 'client_wait', 5, NULL), ('y.edu', 'client', 1, 'thin_page_supplement'), ('z.edu', 'server', 1, NULL), ('q.edu', 'server', 9, NULL)) v(domain, fetch_mode, success_count, detail_pattern)")
def strategy_cache(spark, d):
    """Successes add to a domain's counter and set its mode, learnt patterns are merged in, what is stored else stays."""
    rows = CRAWLS.df(spark).withColumn("domain", U.host(F.col("url"))).where("domain <> ''")

    def newest(c):
        return F.max_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("pos")))

    new = rows.groupBy("domain").agg(newest("fetch_mode").alias("m"), F.count("fetch_mode").cast("int").alias("n"), newest("detail_pattern").alias("p"))
    both = CACHE.df(spark).join(new, "domain", "full_outer")
    return both.select("domain", F.coalesce("m", "fetch_mode").alias("fetch_mode"), (F.coalesce("success_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("success_count"), F.coalesce("p", "detail_pattern").alias("detail_pattern"))


JOBS = Rows("job int, status string", [(1, "CANCELLED"), (2, "RUNNING"), (3, "POISONED"), (4, "SUCCEEDED"), (5, "FAILED")])
JOB_TASKS = Rows("job int, stage string, state string", [
    (1, "fetch_raw", "SUCCEEDED"), (1, "extract_structured", "RUNNING"), (1, "validate_rules", "PENDING"), (2, "fetch_raw", "RUNNING"), (3, "fetch_raw", "POISONED"), (3, "extract_structured", "RETRY_SCHEDULED"), (4, "fetch_raw", "SKIPPED"), (5, "fetch_raw", "FAILED"),
])


@query("w21_live_tasks_fail", f"SELECT job, stage, CASE WHEN status NOT IN ('PENDING', 'RUNNING') AND state IN ('RUNNING', 'PENDING', 'RETRY_SCHEDULED') THEN 'FAILED' ELSE state END AS state FROM {JOB_TASKS.sql} JOIN {JOBS.sql} USING (job)")
def live_tasks_fail(spark, d):
    """A job that has ended keeps no live task."""
    ended = ~F.col("status").isin("PENDING", "RUNNING") & F.col("state").isin("RUNNING", "PENDING", "RETRY_SCHEDULED")
    return JOB_TASKS.df(spark).join(JOBS.df(spark), "job").select("job", "stage", F.when(ended, "FAILED").otherwise(F.col("state")).alias("state"))


BOARD = Rows("task int, status string, owner string, blocked_by array<int>, blocks array<int>", [(1, "completed", "a", [], [2]), (2, "pending", "", [1], [4]), (3, "pending", "b", [1, 5], []), (4, "pending", "", [], []), (5, "in_progress", "c", [], [99])])
CLAIMS = Rows("ord int, task int, owner string", [(1, 2, "x"), (2, 2, "y"), (3, 3, "z"), (4, 3, "b"), (5, 77, "x"), (6, 4, "y")])


@query("x8_w22_ready_tasks", """SELECT * FROM (VALUES (1, 'completed', 'a', '', '', false), (2, 'in_progress', 'x', '', '4', true), (3, 'in_progress', 'b', '5', '', false), (4, 'in_progress', 'y', '2', '', false), (5, 'in_progress', 'c', '', '3', false)) v(task, status, owner, blocked_by, blocks, was_ready)""")
def ready_tasks(spark, d):
    """Edges hold in both directions whichever side declared them; a completed task blocks nothing any more; a claim takes
    a task that nobody or the claimer owns, the first one wins; ready is pending, unowned and unblocked."""
    t = BOARD.df(spark)
    edges = t.select(F.col("task").alias("b"), F.explode("blocked_by").alias("a")).unionByName(t.select(F.col("task").alias("a"), F.explode("blocks").alias("b"))).distinct()
    open_ = edges.join(t.where("status <> 'completed'").select(F.col("task").alias("a")), "a", "left_semi").join(t.select(F.col("task").alias("b")), "b", "left_semi")

    def listed(key, other, name):
        return open_.groupBy(F.col(key).alias("task")).agg(F.concat_ws(",", F.array_sort(F.collect_set(other)).cast("array<string>")).alias(name))

    c = CLAIMS.df(spark).withColumnRenamed("owner", "claimer").join(t.select("task", "owner"), "task").where("owner = '' or owner = claimer")
    won = c.groupBy("task").agg(F.min_by("claimer", "ord").alias("won"))
    out = t.select("task", "status", "owner").join(listed("b", "a", "blocked_by"), "task", "left").join(listed("a", "b", "blocks"), "task", "left").join(won, "task", "left").fillna("", ["blocked_by", "blocks"])
    ready = (F.col("status") == "pending") & (F.col("owner") == "") & (F.col("blocked_by") == "")
    return out.select("task", F.when(F.col("won").isNotNull(), "in_progress").otherwise(F.col("status")).alias("status"), F.coalesce("won", "owner").alias("owner"), "blocked_by", "blocks", ready.alias("was_ready"))


ITEMS = Rows("id int, category string, subject_name string, framework string, minimum_value string, unit string, applicant_scope string, requirement_text string, exam_code string", [
    (1, "Language", " IELTS ", None, "6.5", "Band", "ALL", "IELTS 6.5", "ielts"), (2, "language", "ielts", "", "6.5", "band", "all", " ielts 6.5", "IELTS"), (3, "other", None, None, None, None, None, 'Say "hi"', None),
])
SIGNED = ["applicant_scope", "category", "exam_code", "framework", "minimum_value", "requirement_text", "subject_name", "unit"]


SIGNED_SQL = ", ".join(f"{c}: lower(trim(coalesce({c}, '')))" for c in SIGNED)


@query("w25_signature", f"SELECT id, CAST(to_json({{{SIGNED_SQL}}}) AS VARCHAR) AS signature FROM {ITEMS.sql}")
def signature(spark, d):
    """Eight trimmed, lower-case fields as JSON with sorted keys; equal requirements have equal signatures."""
    fields = [F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in SIGNED]
    return ITEMS.df(spark).select("id", F.to_json(F.struct(*fields)).alias("signature"))


LEGACY = Rows("program int, university int, code string, name_en string, options string, deadlines string", [
    (1, 1, "HKU#A", "MSc A", '[{"mode":"FullTime","duration_months":12},{"mode":"PartTime","duration_months":24}]', '[{"round":1,"cutoff_date":"2025-03-01"}]'), (2, 1, " hku#a ", "MSc A", '[{"mode":"FullTime","duration_months":12}]', None),
    (3, 1, None, "MA B!", "[]", "not json"), (4, 2, "", None, None, '[{"round":2,"cutoff_date":"2025-06-01"}]'),
])
STORED_OPTIONS = Rows("program int, mode string, months int", [(2, "FullTime", 18)])


@query("w26_backfill_children", """SELECT * FROM (VALUES (1, 'group:hku#a', 'FullTime 12|PartTime 24', '1 2025-03-01'), (2, 'group:hku#a', 'FullTime 18', ''), (3, 'name:ma-b', '', ''), (4, 'name:unnamed-program', '', '2 2025-06-01')) v(program, catalog_key, options, deadlines)""")
def backfill_children(spark, d):
    """Legacy programmes get a catalogue key (code, else name) and child rows out of their JSON, options only where the
    programme has none yet."""
    p, old = LEGACY.df(spark), STORED_OPTIONS.df(spark)
    key = F.when(~T.blank(F.col("code")), F.concat(F.lit("group:"), F.lower(F.trim("code")))).otherwise(F.concat(F.lit("name:"), T.slug(F.col("name_en"), "unnamed-program")))
    fresh = p.join(old, "program", "left_anti").select("program", F.posexplode(F.from_json("options", "array<struct<mode:string,duration_months:int>>")).alias("pos", "o")).select("program", "pos", "o.mode", F.col("o.duration_months").alias("months"))
    options = old.withColumn("pos", F.lit(0)).unionByName(fresh).groupBy("program").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("pos", "mode", "months"))), lambda x: F.concat_ws(" ", x["mode"], x["months"]))).alias("options"))
    dates = p.select("program", F.explode(F.from_json("deadlines", "array<struct<round:int,cutoff_date:string>>")).alias("x")).where("x.cutoff_date is not null").groupBy("program").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(" ", x["round"], x["cutoff_date"]))).alias("deadlines"))
    return p.select("program", key.alias("catalog_key")).join(options, "program", "left").join(dates, "program", "left").fillna("", ["options", "deadlines"])


LEGACY_REQS = Rows("id int, program int, subject string, framework string, text string, url string", [(1, 1, "English", "IELTS scale", "IELTS 6.5", "u1"), (2, 1, "english ", None, "IELTS 6.5", "u1"), (3, 2, "Maths", "A-Level", "A in maths", None), (4, 2, None, None, "a satisfactory degree", None)])


@query("w27_backfill_dimensions", """SELECT id, subject_key, framework_key, exam, version_no, CASE WHEN e IS NOT NULL THEN sha256(e) END AS evidence FROM (VALUES (1, 'english', 'ielts-scale', 'IELTS', 1, 'u1|IELTS 6.5|url|u1'), (2, 'english', NULL, 'IELTS', 1, 'u1|IELTS 6.5|url|u1'),
 (3, 'maths', 'a-level', 'A-Level', 1, '|A in maths|text|Maths'), (4, NULL, NULL, NULL, 1, '|a satisfactory degree|text|')) v(id, subject_key, framework_key, exam, version_no, e)""")
def backfill_dimensions(spark, d):
    """Legacy requirements: distinct subjects and frameworks become dimensions that rows are joined back to, exams are
    inferred, evidence is addressed by its content, and every programme's set is version 1."""
    r, empty = LEGACY_REQS.df(spark), F.lit("")
    for c in ("subject", "framework"):
        dim = r.where(~T.blank(F.col(c))).select(F.trim(c).alias("name")).withColumn(f"{c}_key", T.slug(F.col("name"), c)).groupBy(f"{c}_key").agg(F.min("name").alias("display"), F.collect_set("name").alias("names"))
        r = r.join(dim.select(f"{c}_key", F.explode("names").alias("n")), F.trim(c) == F.col("n"), "left").drop("n")
    exam = F.coalesce(M.inferred_exam(F.concat_ws(" ", "framework", "text"))["name"], F.lit(None))
    place = F.coalesce("url", F.trim("subject"), "framework", empty)
    content = F.concat_ws("|", F.coalesce("url", empty), F.trim(F.coalesce("text", empty)), F.when(F.col("url").isNull(), "text").otherwise("url"), place)
    return r.select("id", "subject_key", "framework_key", exam.alias("exam"), F.lit(1).alias("version_no"), F.sha2(content, 256).alias("evidence"))


CATALOG = Rows("catalog int, university int, catalog_key string, name string", [(10, 1, "name:msc-law", "MSc Law"), (11, 1, "url:https://x.edu/a", "MA Art"), (12, 2, "name:msc-law", "MSc Law"), (13, 1, "group:x", "MBA")])
ARRIVING = Rows("id int, university int, catalog_key string, name string", [(1, 1, "name:msc-law", "MSc Law"), (2, 1, "name:ma-art", "ma art"), (3, 1, "group:hku#mba", "MBA"), (4, 1, "url:https://x.edu/b", "MA Art"), (5, 2, "name:ma-art", "MA Art"), (6, 1, "group:x", "Other")])


@query("w3_legacy_name_merge", "SELECT * FROM (VALUES (1, 10, 'key'), (2, 11, 'name'), (3, NULL, 'new'), (4, NULL, 'new'), (5, NULL, 'new'), (6, 13, 'key')) v(id, catalog, how)")
def legacy_name_merge(spark, d):
    """A programme finds its catalogue entry by key; only name keys may fall back to an entry of the university with the
    same name."""
    c = CATALOG.df(spark)
    by_key = ARRIVING.df(spark).join(c.select("university", "catalog_key", F.col("catalog").alias("k")), ["university", "catalog_key"], "left")
    named = c.groupBy("university", F.lower(F.trim("name")).alias("n")).agg(F.min("catalog").alias("by_name"))
    out = by_key.withColumn("n", F.when(F.startswith("catalog_key", F.lit("name:")) & F.col("k").isNull(), F.lower(F.trim("name")))).join(named, ["university", "n"], "left")
    return out.select("id", F.coalesce("k", "by_name").alias("catalog"), F.when(F.col("k").isNotNull(), "key").when(F.col("by_name").isNotNull(), "name").otherwise("new").alias("how"))


@query("f46_payload_hash", """SELECT event_id, sha256('{"event_type":"' || event_type || '","stage_input":' || replace(props, ' ', '') || ',"user_id":"' || user_id || '"}') AS key FROM events""")
def payload_hash(spark, d):
    """The digest of each event's payload as JSON with sorted keys: equal payloads have equal keys, whatever their order."""
    inner = F.map_from_entries(F.array_sort(F.map_entries(F.from_json("props", "map<string,int>"))))
    payload = F.struct("event_type", inner.alias("stage_input"), F.col("user_id").cast("string").alias("user_id"))
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(payload), 256).alias("key"))


NINE = "coalesce(CAST(amount AS VARCHAR), '') || '/HKD/' || basis || '/' || mode || '/' || scope || '//' || line || '/' || (basis <> 'per_programme')::VARCHAR || '/fee ' || line"


@query("f47_fee_records", CTE + f"SELECT program_id, count(*) AS n, string_agg({NINE}, '|' ORDER BY scope, mode, basis, line, amount) AS fees FROM fee GROUP BY program_id")
def fee_records(spark, d):
    """A programme's fees as records of nine fields by scope, mode, basis and place."""
    f = star.fee(spark, d).select(
        "program_id", "amount", F.lit("HKD").alias("currency"), "basis", F.col("mode").alias("study_mode"), F.col("scope").alias("applicant_scope"), F.lit(None).cast("string").alias("scope_label"), F.col("line").alias("credits"),
        (F.col("basis") != "per_programme").alias("is_derived"), F.concat(F.lit("fee "), F.col("line")).alias("source_text"),
    )
    nine = [c for c in f.columns if c != "program_id"]
    order = ["applicant_scope", "study_mode", "basis", "credits", "amount"]
    records = F.array_sort(F.collect_list(F.struct(*order, F.struct(*nine).alias("fee"))))
    text = F.transform(F.transform(records, lambda x: x["fee"]), lambda x: F.concat_ws("/", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in nine]))
    return f.groupBy("program_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", text).alias("fees"))


PICKS = Rows("id int, raw string, listed array<int>, onhold array<int>", [(1, "1,3-4 x", [7, 3], [None, None, 3, None]), (2, None, [2], [5, 6]), (3, "9", None, []), (4, "", [], [0, -1, None])])


@query("u14_selection_union", "SELECT * FROM (VALUES (1, '1,3,4,7', 'x', '1,2,3,4'), (2, '2', '', '5,6'), (3, '9', '', ''), (4, '', '', '1,3')) v(id, selected, invalid, known)")
def selection_union(spark, d):
    """Indices from the text and from the list together, and the indices on hold: their own, else their position; none below one."""
    parts = F.filter(F.split(F.coalesce("raw", F.lit("")), "[, ]+"), lambda x: x != "")
    low, high = (lambda x: F.regexp_extract(x, "^([0-9]+)", 1).try_cast("int")), (lambda x: F.regexp_extract(x, "([0-9]+)$", 1).try_cast("int"))
    ok = lambda x: x.rlike("^[0-9]+(-[0-9]+)?$") & (low(x) <= high(x))
    numbers = F.flatten(F.transform(F.filter(parts, ok), lambda x: F.sequence(low(x), high(x))))
    both = F.array_sort(F.array_union(numbers, F.coalesce("listed", F.array().cast("array<int>"))))
    known = F.array_sort(F.array_distinct(F.filter(F.transform("onhold", lambda x, i: F.coalesce(F.nullif(x, F.lit(0)), i + 1)), lambda x: x > 0)))
    return PICKS.df(spark).select("id", F.concat_ws(",", both.cast("array<string>")).alias("selected"), F.concat_ws(" ", F.filter(parts, lambda x: ~ok(x))).alias("invalid"), F.concat_ws(",", known.cast("array<string>")).alias("known"))


@query("w15_w16_audit_fan_out", """
WITH a AS (SELECT user_id AS audit, list(event_id ORDER BY event_id) AS dropped FROM events GROUP BY 1), l AS (SELECT audit, unnest(dropped) AS link FROM a)
SELECT audit % 3 AS university, count(DISTINCT audit) AS audits_deleted, count(link) AS links_deleted, CAST(count(link) FILTER (link % 5 = 0) AS BIGINT) AS quarantine_deleted, (SELECT count(*) FROM l WHERE audit % 3 <> 1) AS links_left FROM l WHERE audit % 3 = 1 GROUP BY 1""")
def audit_fan_out(spark, d):
    """Audits with their dropped links as rows; clearing one university's diagnostics counts what goes and leaves the rest."""
    links = table(spark, d, "events").select(F.col("user_id").alias("audit"), (F.col("user_id") % 3).alias("university"), F.col("event_id").alias("link"))
    gone, left = links.where("university = 1"), links.where("university <> 1")
    counts = gone.groupBy("university").agg(F.count_distinct("audit").alias("audits_deleted"), F.count("link").alias("links_deleted"), F.count_if(F.col("link") % 5 == 0).alias("quarantine_deleted"))
    return counts.crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("links_left"))))
