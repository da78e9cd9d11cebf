"""Queries of exports, snapshots, schema stores and whole-database checks: what is written is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import text as T
from curation.operators import joins, merge
from curation.plans import star
from curation.plans.registry import Rows, query, table
from curation.plans.star import CTE
from curation.sources import tables

#: All tables of a data folder, parents before children.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations"]
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES)


def counts(spark, d, names=TABLES):
    return reduce(lambda a, b: a.unionByName(b), [table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in names])


@query("a3_row_counts", COUNTS_SQL)
def row_counts(spark, d):
    return counts(spark, d)


@query("p19_all_tables_empty", f"SELECT bool_and(n = 0) AS is_empty FROM ({COUNTS_SQL})")
def all_tables_empty(spark, d):
    """One row of each table is enough to tell."""
    some = reduce(lambda a, b: a.union(b), [table(spark, d, t).limit(1).agg(F.count(F.lit(1)).alias("n")) for t in TABLES])
    return some.agg(F.bool_and(F.col("n") == 0).alias("is_empty"))


OPTIONS = Rows("id int, pos int, mode string, months int", [(1, 1, "FullTime", 12), (1, 2, "PartTime", 24), (1, 3, "Unknown", None), (2, 1, None, 6), (4, 1, "FullTime", 0)])
DEADLINES = Rows("id int, pos int, round int, description string, cutoff string", [(1, 1, 1, "Main", "2025-03-01"), (1, 2, 2, "", "2025-06-01"), (2, 1, None, "Rolling", None), (2, 2, 0, "Late", "2025-07-01")])
NEEDS = Rows("id int, sort_order int, req int, subject string, exam string, framework string, minimum string, unit string, text string, scope string", [
    (1, 2, 7, None, "IELTS", None, "6.5", "band", "IELTS 6.5", "all"), (1, 1, 9, "Maths", None, "A-Level", "A", None, None, None), (1, 1, 3, None, None, None, None, None, "A degree", ""), (2, 1, 4, None, None, "IB", "38", "points", None, "local"), (3, 1, 5, "", None, None, None, None, None, None),
])


def listed(rows, order, text, sep):
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"]), sep).alias("text"))


def option_texts(rows):
    text = F.concat(F.coalesce("mode", F.lit("")), F.when(F.coalesce("months", F.lit(0)) != 0, F.concat(F.lit(" ("), "months", F.lit("mo)"))).otherwise(""))
    return listed(rows, ["pos"], text, ", ")


def spaced(*columns):
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])


def deadline_texts(rows):
    label = F.when(F.coalesce("round", F.lit(0)) != 0, F.concat(F.lit("R"), F.col("round").cast("string")))
    return listed(rows, ["pos"], spaced(label, F.col("description"), F.col("cutoff")), " | ")


def requirement_texts(rows):
    """Subject, exam or framework with threshold and unit, then text and scope; by sort order and id."""
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("subject", "exam", "framework")], F.lit("Requirement"))
    tail = F.concat_ws(" | ", F.nullif("text", F.lit("")), F.nullif("scope", F.lit("")))
    return listed(rows, ["sort_order", "req"], F.concat_ws(" - ", spaced(name, F.col("minimum"), F.col("unit")), F.nullif(tail, F.lit(""))), " || ")


@query("k2_list_formats", """SELECT * FROM (VALUES (1, 'FullTime (12mo), PartTime (24mo), Unknown', 'R1 Main 2025-03-01 | R2 2025-06-01', 'Requirement - A degree || Maths A || IELTS 6.5 band - IELTS 6.5 | all'), (2, ' (6mo)', 'Rolling | Late 2025-07-01', 'IB 38 points - local'), (3, '', '', 'Requirement'), (4, 'FullTime', '', '')) v(id, options, deadlines, requirements)""")
def list_formats(spark, d):
    """Options, deadlines and requirements of a programme as readable lists."""
    ids = spark.range(1, 5).select(F.col("id").cast("int"))
    parts = {"options": option_texts(OPTIONS.df(spark)), "deadlines": deadline_texts(DEADLINES.df(spark)), "requirements": requirement_texts(NEEDS.df(spark))}
    return reduce(lambda a, kv: a.join(kv[1].withColumnRenamed("text", kv[0]), "id", "left"), parts.items(), ids).fillna("")


@query("t4_requirements_ordered", "SELECT l_orderkey AS program_id, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_linenumber % 3, l_partkey, l_linenumber) AS requirements FROM lineitem GROUP BY 1")
def requirements_ordered(spark, d):
    """A programme's requirements by sort order, then id."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("program_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") % 3).alias("s"), "l_partkey", "l_linenumber"))).alias("r"))
    return rows.select("program_id", F.concat_ws(",", F.transform("r", lambda x: F.concat_ws(":", x["l_partkey"], x["l_linenumber"]))).alias("requirements"))


FIXED = [
    "University", "Academic Year", "Program Name (EN)", "Program Name (ZH)", "Group Code", "Faculty", "Tuition", "Currency", "Tuition Fees (JSON)", "Study Options", "Deadlines", "Subject Requirements", "Requirement Version",
    "Requirement Effective At", "Requirement Valid From", "Requirement Valid To", "Requirement Change Summary", "Source URL", "Active", "Discontinued", "Updated At",
]


@query("k1_k2_flat_export", CTE + """,
f AS (SELECT program_id, '[' || string_agg('{"amount":"' || amount || '","basis":"' || basis || '","mode":"' || mode || '","scope":"' || scope || '"}', ',' ORDER BY scope, mode, basis, amount, line) || ']' AS fees,
 string_agg(CASE WHEN mode = 'F' THEN 'FullTime' ELSE 'PartTime' END || ' (' || (line * 6) || 'mo)', ', ' ORDER BY line, mode) AS options, string_agg('R' || line || ' fee ' || cutoff, ' | ' ORDER BY line, cutoff) AS deadlines FROM fee GROUP BY program_id),
v AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY updated_at, program_id) AS version_no, lead(updated_at) OVER (PARTITION BY catalog_id ORDER BY updated_at, program_id) AS valid_to FROM program)
SELECT university AS "University", academic_year AS "Academic Year", catalog_name AS "Program Name (EN)", '' AS "Program Name (ZH)", slug || '#' || catalog_id AS "Group Code", '' AS "Faculty", CAST(tuition AS VARCHAR) AS "Tuition", 'HKD' AS "Currency",
 coalesce(fees, '[]') AS "Tuition Fees (JSON)", coalesce(options, '') AS "Study Options", coalesce(deadlines, '') AS "Deadlines", 'Requirement ' || status AS "Subject Requirements", version_no AS "Requirement Version",
 strftime(updated_at, '%Y-%m-%d') AS "Requirement Effective At", strftime(updated_at, '%Y-%m-%d') AS "Requirement Valid From", coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS "Requirement Valid To", '' AS "Requirement Change Summary",
 'https://' || slug || '/' || program_id AS "Source URL", CASE WHEN status = 'F' THEN 'No' ELSE 'Yes' END AS "Active", CASE WHEN status = 'P' THEN 'Yes' ELSE 'No' END AS "Discontinued", strftime(updated_at, '%Y-%m-%d %H:%M') AS "Updated At",
 status AS "Extra: status", coalesce(CASE WHEN program_id % 2 = 0 THEN 'even' END, '') AS "Extra: parity" FROM v JOIN catalog USING (catalog_id) JOIN university USING (university_id) LEFT JOIN f USING (program_id)""")
def flat_export(spark, d):
    """Every programme as one row: the 21 fixed columns, then a column for each key of its metadata."""
    fee = star.fee(spark, d)
    records = F.transform(F.array_sort(F.collect_list(F.struct("scope", "mode", "basis", "amount", "line"))), lambda x: F.struct(x["amount"].cast("string").alias("amount"), x["basis"].alias("basis"), x["mode"].alias("mode"), x["scope"].alias("scope")))
    mode = F.when(F.col("mode") == "F", "FullTime").otherwise("PartTime")
    fees = fee.groupBy(F.col("program_id").alias("id")).agg(F.to_json(records).alias("fees"))
    options = option_texts(fee.select(F.col("program_id").alias("id"), F.col("line").alias("pos"), mode.alias("mode"), (F.col("line") * 6).alias("months"))).withColumnRenamed("text", "options")
    deadlines = deadline_texts(fee.select(F.col("program_id").alias("id"), F.col("line").alias("pos"), F.col("line").alias("round"), F.lit("fee").alias("description"), F.col("cutoff").cast("string").alias("cutoff"))).withColumnRenamed("text", "deadlines")
    w = W.partitionBy("catalog_id").orderBy("updated_at", "program_id")
    p = star.program(spark, d).withColumns({"version_no": F.row_number().over(w).cast("long"), "valid_to": F.lead("updated_at").over(w), "id": F.col("program_id")})
    p = p.join(star.catalog(spark, d), "catalog_id").join(star.university(spark, d), "university_id").join(fees, "id", "left").join(options, "id", "left").join(deadlines, "id", "left")
    day = lambda c, f="yyyy-MM-dd": F.coalesce(F.date_format(c, f), F.lit(""))
    need = F.concat(F.lit("Requirement "), "status")
    c, empty = F.col, F.lit("")
    values = [
        c("university"), c("academic_year"), c("catalog_name"), empty, F.concat("slug", F.lit("#"), "catalog_id"), empty, c("tuition").cast("string"), F.lit("HKD"), F.coalesce("fees", F.lit("[]")), F.coalesce("options", empty), F.coalesce("deadlines", empty),
        need, c("version_no"), day("updated_at"), day("updated_at"), day("valid_to"), empty, F.concat(F.lit("https://"), "slug", F.lit("/"), "program_id"), F.when(c("status") == "F", "No").otherwise("Yes"), F.when(c("status") == "P", "Yes").otherwise("No"), day("updated_at", "yyyy-MM-dd HH:mm"),
    ]
    extra = F.create_map(F.lit("status"), c("status"), F.lit("parity"), F.when(c("program_id") % 2 == 0, "even"))
    return tables.with_extra_columns(p.select(*[v.alias(n) for v, n in zip(values, FIXED)], extra.alias("_extra")), "_extra", ["status", "parity"])


@query("k1_extra_keys", "SELECT * FROM (VALUES (1, 'x', ''), (2, '', ''), (3, '', 'z')) v(id, \"Extra: a\", \"Extra: b c\")")
def extra_keys(spark, d):
    """The keys themselves are found in the data: one column each, blank where a row lacks it."""
    rows = spark.createDataFrame([(1, {"a": "x"}), (2, {}), (3, {"b c": "z", "a": None})], "id int, extra map<string,string>")
    return tables.with_extra_columns(rows, "extra", tables.extra_keys(rows, "extra"))


@query("k3_s10_export_import", f"SELECT name, n AS rows, true AS typed FROM ({COUNTS_SQL}) WHERE name IN ('nation', 'orders', 'lineitem', 'labels')")
def export_import(spark, d):
    """Tables written as JSON with a manifest, refused by a target that has rows, and read back typed: equal to what was written."""
    held = {t: table(spark, d, t) for t in ("nation", "orders", "lineitem", "labels")}
    path = tables.scratch(spark)
    tables.export_tables(held, path)
    back = tables.import_tables(spark, path, {t: df.schema.simpleString()[7:-1].replace(":", " ") for t, df in held.items()}, {t: df.where("false") for t, df in held.items()})
    manifest = spark.read.json(f"{path}/manifest")
    same = [joins.same_rows(df, back[t], t) for t, df in held.items()]
    return manifest.select("name", "rows").join(F.broadcast(reduce(lambda a, b: a.union(b), same)), "name").select("name", "rows", F.col("same").alias("typed"))


@query("s10_import_guard", "SELECT * FROM (VALUES ('full', false, 'tables that are not empty: nation'), ('forced', true, NULL), ('empty', true, NULL)) v(target, imported, error)")
def import_guard(spark, d):
    """An import is refused where a target has rows, unless it is forced."""
    nation, path = table(spark, d, "nation"), tables.scratch(spark)
    tables.export_tables({"nation": nation}, path)
    out = []
    for target, existing, force in (("full", nation, False), ("forced", nation, True), ("empty", nation.where("false"), False)):
        try:
            tables.import_tables(spark, path, {"nation": nation.schema.simpleString()[7:-1].replace(":", " ")}, {"nation": existing}, force)
            out.append((target, True, None))
        except ValueError as e:
            out.append((target, False, str(e)))
    return spark.createDataFrame(out, "target string, imported boolean, error string")


ENTRIES = Rows("normalized string, name string, source string, confidence double", [("b", "B", "seed", None), ("a", "A", "learned", 0.95), ("c", "C", "learned", 0.5), ("d", "D", "learned", None), ("e", "E", None, 0.1)])


@query("k4_taxonomy_export", "SELECT * FROM (VALUES ('seeds', 'b', 1), ('seeds', 'e', 2), ('all', 'a', 1), ('all', 'b', 2), ('all', 'd', 3), ('all', 'e', 4)) v(export, normalized, pos)")
def taxonomy_export(spark, d):
    """Learned names only if asked for, and then from the least confidence on (unknown confidence stays); sorted by normalized
    name, written as JSON and read back in order."""
    e = ENTRIES.df(spark).withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("seed")))
    sure = F.col("confidence").isNull() | (F.col("confidence") >= 0.9)
    out = []
    for name, rows in (("seeds", e.where("source <> 'learned'")), ("all", e.where((F.col("source") != "learned") | sure))):
        path = tables.scratch(spark)
        rows.withColumn("pos", F.row_number().over(W.orderBy("normalized"))).orderBy("normalized").write.json(path)
        out.append(spark.read.schema("normalized string, pos int").json(path).select(F.lit(name).alias("export"), "normalized", "pos"))
    return out[0].unionByName(out[1])


@query("k5_snapshots", "SELECT n_nationkey, n_name, 3 AS snapshots FROM nation")
def snapshots(spark, d):
    """Four snapshots of two tables of which the newest three are kept; the restored one is that from before the loss."""
    path = tables.scratch(spark)
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    for version in (1, 2, 3):
        tables.snapshot({"nation": nation, "region": region}, path, version)
    tables.snapshot({"nation": nation.where("n_regionkey = 0"), "region": region}, path, 4)
    left = tables.retained(spark, path, 3)
    back = tables.restored(spark, path, left[1], ["nation", "region"])
    return back["nation"].select("n_nationkey", "n_name", F.lit(len(left)).alias("snapshots"))


@query("k6_diagnostic_report", "SELECT page_id, length(html) AS html_chars, sha256(html) AS html_digest, 'page ' || page_id AS title, 2 AS log_lines FROM pages")
def diagnostic_report(spark, d):
    """A report per page that could not be handled: HTML, markdown, parameters and log as one JSON row each, written and read back."""
    path = tables.scratch(spark)
    report = table(spark, d, "pages").select("page_id", "url", "html", T.html_text(F.col("html")).alias("markdown"), F.create_map(F.lit("title"), F.concat(F.lit("page "), "page_id")).alias("params"), F.array(F.lit("fetched"), F.lit("unsupported")).alias("log"))
    report.write.json(path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("page_id", F.length("html").cast("long").alias("html_chars"), F.sha2("html", 256).alias("html_digest"), F.col("params.title").alias("title"), F.size("log").alias("log_lines"))


@query("k7_quality_report", CTE + "SELECT status AS case_id, count(*) AS n, round(avg(CAST(tuition AS DOUBLE)), 2) AS mean_score, avg(CAST(tuition AS DOUBLE)) >= 150000 AS passed FROM program GROUP BY status")
def quality_report(spark, d):
    """Scores per case as one JSON document with a list of cases, written and read back."""
    path = tables.scratch(spark)
    t = F.col("tuition").cast("double")
    cases = star.program(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(t), 2).alias("mean_score"), (F.avg(t) >= 150000).alias("passed"))
    report = cases.agg(F.count(F.lit(1)).alias("case_count"), F.array_sort(F.collect_list(F.struct(F.col("status").alias("case_id"), "n", "mean_score", "passed"))).alias("cases"))  # one row per status
    report.write.json(path)
    return spark.read.schema(report.schema).json(path).select(F.inline("cases"))


SCHEMAS = Rows("pos int, slug string, pattern string, op string, body string", [
    (1, "hku", "prog/{N}", "save", '{"name":"h1","baseline":0.9}'), (2, "hku", "prog/{N}", "save", '{"name":"h2","baseline":0.8}'), (3, "ln", "p/{N}", "save", "{corrupt"), (4, "cu", "c/{N}", "save", '{"name":"h1","baseline":0.7}'), (5, "cu", "c/{N}", "deprecate", None),
    (6, "cu", "d/{N}", "save", '{"name":"h3","baseline":0.5}'), (7, "ust", "x", "save", '{"name":"a","baseline":1}'), (8, "ust", "x", "deprecate", None), (9, "ust", "x", "save", '{"name":"b","baseline":0.6}'),
])


@query("k8_selector_schemas", """SELECT * FROM (VALUES ('hku', 'prog/{N}', 'active', 'h2', 0.8), ('ln', 'p/{N}', 'corrupt', NULL, NULL), ('cu', 'c/{N}', 'deprecated', 'h1', 0.7), ('cu', 'd/{N}', 'active', 'h3', 0.5), ('ust', 'x', 'active', 'b', 0.6)) v(slug, pattern, status, name, baseline)""")
def selector_schemas(spark, d):
    """The schema of each site and page pattern: the last one saved, deprecated by a later mark, discarded if it can't be parsed."""
    rows = SCHEMAS.df(spark)
    saved = F.col("op") == "save"
    g = rows.groupBy("slug", "pattern").agg(F.max_by("body", F.when(saved, F.col("pos"))).alias("body"), F.max_by("op", "pos").alias("last"))
    read = F.from_json("body", "name string, baseline double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    g = g.withColumn("s", read)
    bad = F.col("s._bad").isNotNull()
    status = F.when(bad, "corrupt").when(F.col("last") == "deprecate", "deprecated").otherwise("active")
    return g.select("slug", "pattern", status.alias("status"), F.when(~bad, F.col("s.name")).alias("name"), F.when(~bad, F.col("s.baseline")).alias("baseline"))


@query("k9_schema_health", "SELECT * FROM (VALUES ('before', false, 'requirement_version'), ('failed', false, 'requirement_version'), ('migrated', true, '')) v(state, ok, missing)")
def schema_health(spark, d):
    """Required tables that are missing; a migration that fails leaves the tables as they were, one that works adds its own."""
    path, required = tables.scratch(spark), ["nation", "region", "requirement_version"]
    current = {t: table(spark, d, t) for t in ("nation", "region")}
    tables.snapshot(current, path, 1)

    def broken(held):
        raise ValueError("no such column")

    def added(held):
        return held | {"requirement_version": spark.createDataFrame([], "program_id long, version_no int")}

    states = [("before", 1), ("failed", tables.migrated(spark, path, 1, broken)), ("migrated", tables.migrated(spark, path, 1, added))]
    found = [(s, sorted(set(required) - set(tables.snapshot_tables(spark, path, v)))) for s, v in states]
    return spark.createDataFrame([(s, not m, ",".join(m)) for s, m in found], "state string, ok boolean, missing string")


@query("w14_merge_first_per_key", CTE + "SELECT catalog_id, min(program_id) AS program_id FROM program GROUP BY catalog_id")
def first_programme(spark, d):
    return merge.first_per_key(star.program(spark, d), ["catalog_id"], [F.asc("program_id")]).select("catalog_id", "program_id")
