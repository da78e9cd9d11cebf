"""Queries of the quality gate, circuit breaker and golden-sample scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.functions import text as T
from curation.plans.registry import Rows, query, table
from curation.plans.text import NOISE_SQL

ROWS = Rows("name string, url string, tuition double, deadlines int, requirements int", [
    ("", "u", 1.0, 0, 0), ("AB", "u", 1.0, 0, 0), ("News", "u", 1.0, 0, 0), ("MSc Law", "/x/phd-law", 1.0, 0, 0), ("MSc Law", "/x/msc-law", None, 0, 0), ("MSc Law", "/x/msc-law", None, 1, 0), (None, None, None, 0, 0), ("Law", None, 2.0, 0, 3),
])


@query("p5_quality_gate", f"""
SELECT name, url, length(trim(coalesce(name, ''))) AS name_length, CASE WHEN trim(coalesce(name, '')) = '' THEN 'empty_name' WHEN length(trim(name)) < 3 THEN 'name_too_short' WHEN {NOISE_SQL.replace('{c}', 'name')} THEN 'noise_name'
 WHEN regexp_extract(lower(coalesce(url, '')), '(?:^|/)(ma|msc|phd)-', 1) <> '' AND regexp_extract(lower(name), '^(ma|msc|phd)\\b', 1) <> '' AND regexp_extract(lower(url), '(?:^|/)(ma|msc|phd)-', 1) <> regexp_extract(lower(name), '^(ma|msc|phd)\\b', 1) THEN 'degree_type_mismatch'
 WHEN tuition IS NULL AND deadlines = 0 AND requirements = 0 THEN 'empty_shell' END AS reason FROM {ROWS.sql}""")
def quality_gate(spark, d):
    """First failing rule of a record: names before content."""
    name = F.trim(F.coalesce("name", F.lit("")))
    content = F.col("tuition").isNotNull() | (F.col("deadlines") > 0) | (F.col("requirements") > 0)
    reason = F.when(name == "", "empty_name").when(F.length(name) < 3, "name_too_short").when(T.noise_name(F.col("name")), "noise_name")
    reason = reason.when(T.degree_conflict(F.col("name"), F.col("url")), "degree_type_mismatch").when(~content, "empty_shell")
    return ROWS.df(spark).select("name", "url", F.length(name).cast("long").alias("name_length"), reason.alias("reason"))


SCORED = """
d AS (SELECT source, doc_id, n_chars, quality, lang FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) AS n, avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0 END) AS c FROM d GROUP BY source),
m AS (SELECT source, max(k) AS top FROM (SELECT source, lang, count(*) AS k FROM d GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT source, n, least(greatest((a + b + c) / 3 * CASE WHEN top / n > 0.9 THEN 0.5 ELSE 1 END, 0), 1) AS score FROM g JOIN m USING (source))"""


@query("a8_a9_batch_quality", f"WITH {SCORED} SELECT source, n, round(score, 4) AS score, CASE WHEN score >= 0.7 THEN 'pass' WHEN score < 0.4 THEN 'fail' ELSE 'review' END AS verdict FROM s")
def batch_quality(spark, d):
    """Mean of three indicators per batch, halved where one value prevails, and its verdict."""
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), share(F.col("n_chars") > 200).alias("a"), share(F.col("quality") == 1).alias("b"), share(F.col("lang").isNotNull()).alias("c"))
    top = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.max("k").alias("top"))
    raw = (F.col("a") + F.col("b") + F.col("c")) / 3 * F.when(F.col("top") / F.col("n") > 0.9, 0.5).otherwise(1.0)
    score = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    s = g.join(top, "source").withColumn("s", score)
    return s.select("source", "n", F.round("s", 4).alias("score"), F.when(F.col("s") >= 0.7, "pass").when(F.col("s") < 0.4, "fail").otherwise("review").alias("verdict"))


@query("a10_manifest_scores", f"WITH {SCORED} SELECT count(*) AS cases, count(*) FILTER (score >= 0.6) AS passed, round(avg(score), 4) AS mean_score, avg(score) >= 0.6 AND count(*) FILTER (score < 0.6) = 0 AS global_pass FROM s")
def manifest_scores(spark, d):
    s = batch_quality(spark, d).select("score")
    return s.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("score") >= 0.6).alias("passed"), F.round(F.avg("score"), 4).alias("mean_score"), ((F.avg("score") >= 0.6) & (F.count_if(F.col("score") < 0.6) == 0)).alias("global_pass"))


@query("a13_keyword_coverage", "SELECT doc_id, round((contains(lower(text), ' the ')::INT + contains(lower(text), ' der ')::INT + contains(lower(text), ' que ')::INT) / 3, 4) AS coverage FROM documents WHERE text IS NOT NULL")
def keyword_coverage(spark, d):
    words = F.array(F.lit(" the "), F.lit(" der "), F.lit(" que "))
    low = F.lower("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(F.size(F.filter(words, lambda w: F.contains(low, w))) / 3, 4).alias("coverage"))


CASES = Rows("case_id string, name double, complete double, normal double, evidence double, threshold double", [("a", 1.0, 0.5, 1.0, None, 0.6), ("b", 0.2, 0.2, 0.4, 0.5, 0.6), ("c", 0.85, 1.0, 1.0, 1.0, 0.9)])


@query("a14_a15_case_scores", f"SELECT case_id, round_even(0.35 * name + 0.25 * complete + 0.20 * normal + 0.20 * coalesce(evidence, 0), 4) AS score, round_even(0.35 * name + 0.25 * complete + 0.20 * normal + 0.20 * coalesce(evidence, 0), 4) >= threshold AS passed FROM {CASES.sql}")
def case_scores(spark, d):
    s = F.bround(0.35 * F.col("name") + 0.25 * F.col("complete") + 0.20 * F.col("normal") + 0.20 * F.coalesce("evidence", F.lit(0.0)), 4)
    return CASES.df(spark).select("case_id", s.alias("score"), (s >= F.col("threshold")).alias("passed"))


@query("a16_selector_coverage", "SELECT p_partkey, (CASE WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END + 1 + 1) / 4 AS coverage, CASE (CASE WHEN p_size > 10 THEN 0 ELSE 1 END + CASE WHEN p_retailprice > 1000 THEN 0 ELSE 1 END) WHEN 0 THEN 'none' ELSE 'field' END AS fallback FROM part")
def selector_coverage(spark, d):
    fields = F.create_map(F.lit("size"), F.when(F.col("p_size") > 10, "1"), F.lit("price"), F.when(F.col("p_retailprice") > 1000, "1"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    missing = F.size(F.map_filter(fields, lambda k, v: v.isNull()))
    fallback = F.when(missing == 0, "none").when(missing <= 3, "field").otherwise("full")
    return table(spark, d, "part").select("p_partkey", ((F.size(fields) - missing) / F.size(fields)).alias("coverage"), fallback.alias("fallback"))


LABELLED = Rows("name string, noise boolean", [("News", True), ("About us", True), ("MSc Law", False), ("MSc Research", False), ("Faculty of Arts", True), ("MA History", False)])


@query("a17_name_smoke", f"""
WITH p AS (SELECT *, {NOISE_SQL.replace('{c}', 'name')} AS said FROM {LABELLED.sql}) SELECT count(*) FILTER (noise AND said) / count(*) FILTER (noise) AS recall, count(*) FILTER (NOT noise AND NOT said) / count(*) FILTER (NOT noise) AS valid_kept FROM p""")
def name_smoke(spark, d):
    said, noise = T.noise_name(F.col("name")), F.col("noise")
    return LABELLED.df(spark).agg((F.count_if(noise & said) / F.count_if(noise)).alias("recall"), (F.count_if(~noise & ~said) / F.count_if(~noise)).alias("valid_kept"))


PAGES = Rows("schema string, page int, coverage double, baseline double", [("a", 1, 0.5, 0.9), ("b", 1, 0.9, 0.9), ("b", 2, 0.5, 0.9), ("b", 3, 0.4, 0.9), ("c", 1, 0.9, 0.9), ("c", 2, 0.1, 0.9), ("d", 1, 0.85, 0.9), ("d", 2, 0.9, 0.9), ("d", 3, 0.8, 0.9)])


@query("a23_selector_degradation", f"SELECT schema, CASE WHEN min(coverage) FILTER (page = 1) < 0.8 * max(baseline) THEN 'relearn' WHEN count(*) >= 3 AND avg(coverage) < 0.8 * max(baseline) THEN 'deprecate' ELSE 'keep' END AS action FROM {PAGES.sql} GROUP BY schema")
def selector_degradation(spark, d):
    first = F.min(F.when(F.col("page") == 1, F.col("coverage")))
    limit = 0.8 * F.max("baseline")
    action = F.when(first < limit, "relearn").when((F.count(F.lit(1)) >= 3) & (F.avg("coverage") < limit), "deprecate").otherwise("keep")
    return PAGES.df(spark).groupBy("schema").agg(action.alias("action"))


@query("f40_t15_relevant_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, trim(line, ' ') AS line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE length(trim(line, ' ')) >= 4 AND regexp_matches(lower(line), 'license|copyright|worthless'))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM k WHERE n <= 12""")
def relevant_lines(spark, d):
    """Lines with a keyword, twelve per document at most, as the report shows them."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line"))).alias("l"))
    good = F.filter("l", lambda x: (F.length(x["line"]) >= 4) & F.lower(x["line"]).rlike("license|copyright|worthless"))
    return lines.select("doc_id", F.inline(F.slice(good, 1, 12)))
