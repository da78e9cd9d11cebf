"""Queries of amounts, durations, dates and coercions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.functions import money as M
from curation.functions import vocabulary as V
from curation.plans.registry import Rows, query, table
from curation.plans.text import quoted

FEES = Rows("raw string", [("HK$ 350,000 per year",), ("RMB100000",), ("£9,250",), ("AUD 42,000",), ("US$1,200.50 or HKD 9,400",), ("free",), (None,), ("hk$ 12",), ("GBP ,",), ("Tuition fee: HKD 5",), ("deposit HKD 5",)])
MAPPED = "CASE lower({c}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CURRENCIES.items()) + " ELSE 'OTHER' END"
PAT = r"([A-Z]{3}|HK\$|US\$|£|RMB)[ \t]*([0-9,]+)"


@query("f24_parse_tuition", f"""
WITH p AS (SELECT raw, regexp_extract(coalesce(raw, ''), '{PAT}', 1) AS c, TRY_CAST(replace(regexp_extract(coalesce(raw, ''), '{PAT}', 2), ',', '') AS DECIMAL(12,2)) AS amount FROM {FEES.sql})
SELECT raw, amount, CASE WHEN amount IS NOT NULL THEN {MAPPED.replace('{c}', 'c')} END AS currency FROM p""")
def parse_tuition(spark, d):
    return FEES.df(spark).select("raw", M.tuition_amount(F.col("raw")).alias("amount"), M.tuition_currency(F.col("raw")).alias("currency"))


@query("f24_documents_with_amounts", f"""
WITH p AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '{PAT}', 1) AS c, TRY_CAST(replace(regexp_extract(coalesce(text, ''), '{PAT}', 2), ',', '') AS DECIMAL(12,2)) AS amount FROM documents)
SELECT doc_id, amount, {MAPPED.replace('{c}', 'c')} AS currency FROM p WHERE amount IS NOT NULL""")
def documents_with_amounts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", M.tuition_amount(F.col("text")).alias("amount"), M.tuition_currency(F.col("text")).alias("currency"))
    return rows.where("amount is not null")


CAND = r"(hk\$|us\$|£|rmb|cny|hkd|usd|gbp)[ \t]*([0-9][0-9,]*(?:\.[0-9]+)?)"


@query("f25_tuition_candidates", f"""
WITH p AS (SELECT raw, unnest(regexp_extract_all(lower(coalesce(raw, '')), '{CAND}', 1)) AS c, unnest(regexp_extract_all(lower(coalesce(raw, '')), '{CAND}', 2)) AS a FROM {FEES.sql})
SELECT raw, {MAPPED.replace('{c}', 'c')} AS currency, CAST(replace(a, ',', '') AS DOUBLE) AS amount FROM p""")
def tuition_candidates(spark, d):
    return FEES.df(spark).select("raw", F.inline(M.tuition_candidates(F.col("raw"))))


@query("f26_line_priority", f"""
SELECT raw, CASE WHEN regexp_matches(lower(coalesce(raw, '')), 'deposit|scholarship') THEN -1 ELSE CASE WHEN contains(lower(coalesce(raw, '')), 'tuition') THEN 3 ELSE 0 END
 + CASE WHEN regexp_matches(lower(coalesce(raw, '')), 'fee|cost') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(coalesce(raw, '')), 'international|uk |home ') THEN 1 ELSE 0 END END AS priority FROM {FEES.sql}""")
def line_priority(spark, d):
    return FEES.df(spark).select("raw", M.tuition_priority(F.col("raw"), ["deposit", "scholarship"]).alias("priority"))


SHORT = Rows("raw string", [("14k",), ("1.5m",), ("350,000",), ("12 000",), ("abc",), ("2K",), (None,), ("0.25M",)])


@query("f27_shorthand", f"""
SELECT raw, CAST(TRY_CAST(regexp_replace(t, '[km]$', '') AS DECIMAL(14,4)) * CASE WHEN t LIKE '%k' THEN 1000 WHEN t LIKE '%m' THEN 1000000 ELSE 1 END AS DECIMAL(18,2)) AS amount
FROM (SELECT raw, lower(regexp_replace(raw, '[, ]', '', 'g')) AS t FROM {SHORT.sql})""")
def shorthand(spark, d):
    return SHORT.df(spark).select("raw", M.shorthand_amount(F.col("raw")).alias("amount"))


DUR = Rows("raw string", [("Full-time 1 year",), ("PT 2 years part-time",), ("18 months",), ("1.5-year full time",), ("0.05 year, 3 months",), ("全日制 2年",), ("none",), (None,)])


@query("f28_durations", f"""
SELECT raw, nullif(coalesce(nullif(CAST(floor(TRY_CAST(regexp_extract(l, '([0-9]+(?:\\.[0-9]+)?)[ \\-]*(?:year|yr|年)', 1) AS DOUBLE) * 12) AS INTEGER), 0), TRY_CAST(regexp_extract(l, '([0-9]+)[ \\-]*(?:month|mth|个月)', 1) AS INTEGER)), 0) AS months,
 CASE WHEN regexp_matches(l, 'full-time|full time|全日制') THEN 'FullTime' WHEN regexp_matches(l, 'part-time|part time|兼读制|非全日制') THEN 'PartTime' ELSE 'Unknown' END AS mode FROM (SELECT raw, lower(coalesce(raw, '')) AS l FROM {DUR.sql})""")
def durations(spark, d):
    return DUR.df(spark).select("raw", M.duration_months(F.col("raw")).alias("months"), M.duration_mode(F.col("raw")).alias("mode"))


MODES = Rows("raw string", [("Full Time",), ("pt",), (" blended ",), ("online",), (None,), ("FULL_TIME",)])


@query("f31_study_modes", f"SELECT raw, CASE lower(trim(coalesce(raw, ''))) {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in V.STUDY_MODES.items())} ELSE 'Unknown' END AS mode FROM {MODES.sql}")
def study_modes(spark, d):
    return MODES.df(spark).select("raw", M.study_mode(F.col("raw")).alias("mode"))


LABELS = Rows("raw string", [("local and non-local students",), ("All students",), ("UK/EU",), ("Home and EU",), ("Overseas",), ("local",), ("self-financed",), ("UGC-funded local",), ("",), (None,), ("EU",), ("非本地",)])


@query("f32_applicant_scope", f"SELECT raw, CASE {' '.join(f'WHEN regexp_matches(lower(coalesce(raw, {chr(39) * 2})), {quoted(p)}) THEN {quoted(s)}' for p, s in V.SCOPES)} ELSE 'all' END AS scope FROM {LABELS.sql}")
def applicant_scope(spark, d):
    return LABELS.df(spark).select("raw", M.applicant_scope(F.col("raw")).alias("scope"))


HEAD = Rows("id int, scope string, mode string, basis string, amount double, months int, credits int", [
    (1, "local", "FullTime", "per_programme", 90000.0, 12, None), (1, "non_local", "PartTime", "per_programme", 150000.0, 24, None), (1, "non_local", "FullTime", "per_year", 70000.0, 18, None),
    (2, "all", "FullTime", "per_credit", 5000.0, 12, 30), (3, "local", "PartTime", "per_year", 100.0, None, None), (4, "all", "Unknown", "per_credit", 10.0, None, None),
])


@query("f33_headline_tuition", f"""
WITH v AS (SELECT *, CASE basis WHEN 'per_programme' THEN amount WHEN 'per_year' THEN amount * ceil(months / 12) WHEN 'per_credit' THEN amount * credits END AS total FROM {HEAD.sql}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE scope WHEN 'non_local' THEN 0 WHEN 'all' THEN 1 ELSE 2 END, CASE mode WHEN 'FullTime' THEN 0 WHEN 'PartTime' THEN 1 ELSE 2 END, CASE basis WHEN 'per_programme' THEN 0 WHEN 'per_year' THEN 1 ELSE 2 END) AS n FROM v WHERE total IS NOT NULL)
SELECT id, total, basis <> 'per_programme' AS derived FROM r WHERE n = 1""")
def headline_tuition(spark, d):
    """One figure per programme: by scope, mode and basis; yearly and credit prices are multiplied out where that can be done."""
    total = F.when(F.col("basis") == "per_programme", F.col("amount")).when(F.col("basis") == "per_year", F.col("amount") * F.ceil(F.col("months") / 12)).when(F.col("basis") == "per_credit", F.col("amount") * F.col("credits"))
    rank = F.struct(*[F.array_position(F.array(*map(F.lit, order)), F.col(c)) for c, order in (("scope", ["non_local", "all", "local"]), ("mode", ["FullTime", "PartTime", "Unknown"]), ("basis", ["per_programme", "per_year", "per_credit"]))])
    best = F.min_by(F.struct("total", "basis"), rank)
    out = HEAD.df(spark).withColumn("total", total).where("total is not null").groupBy("id").agg(best.alias("b"))
    return out.select("id", "b.total", (F.col("b.basis") != "per_programme").alias("derived"))


STAMPS = Rows("raw string", [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+08:00",), ("2024-01-02",), ("soon",), (None,)])


@query("f30_iso_timestamps", f"SELECT raw, strftime(TRY_CAST(replace(raw, 'Z', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM {STAMPS.sql}")
def iso_timestamps(spark, d):
    return STAMPS.df(spark).select("raw", F.date_format(M.iso_timestamp(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


DATES = Rows("id int, line string", [(1, "Round 2: 2025-03-01; round 1: 2024-12-01"), (2, "Deadline 5 May 2025"), (3, "deposit of 2,500 by the deadline"), (4, None), (5, "1999-01-01"), (6, "1st March 2026 or Apr 2, 2026; 2026/5/3"), (7, "截止 2026年6月4日; 31 February 2026"), (8, "3 Sept 2101; 12 Dec 2026")])


@query("f29_deadlines", """SELECT * FROM (VALUES (1, 1, DATE '2024-12-01'), (1, 2, DATE '2025-03-01'), (2, 1, DATE '2025-05-05'), (6, 1, DATE '2026-03-01'), (6, 2, DATE '2026-04-02'), (6, 3, DATE '2026-05-03'), (7, 1, DATE '2026-06-04'), (8, 1, DATE '2026-12-12')) v(id, round, cutoff)""")
def deadlines(spark, d):
    rows = DATES.df(spark).select("id", F.posexplode(M.dates_in(F.coalesce("line", F.lit("")))).alias("p", "cutoff"))
    return rows.select("id", (F.col("p") + 1).alias("round"), "cutoff")


@query("f34_backoff", "SELECT CAST(i AS INTEGER) AS attempt, CAST(least(pow(2, greatest(i - 1, 0)), 30) AS INTEGER) AS seconds FROM range(0, 9) t(i)")
def backoff(spark, d):
    return spark.range(9).select(F.col("id").cast("int").alias("attempt"), M.backoff_seconds(F.col("id")).alias("seconds"))


RAWS = Rows("raw string", [("yes",), ("0",), ("12",), ("x",), (None,), (" TRUE ",), ("500",)])


@query("f35_coercers", f"SELECT raw, CASE WHEN lower(trim(raw)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(raw)) IN ('0', 'false', 'no', 'off', '') THEN false END AS flag, least(greatest(coalesce(TRY_CAST(raw AS INTEGER), 3), 1), 10) AS clamped FROM {RAWS.sql}")
def coercers(spark, d):
    return RAWS.df(spark).select("raw", M.as_bool(F.col("raw")).alias("flag"), M.clamped_int(F.col("raw"), 1, 10, 3).alias("clamped"))


STEPS = Rows("done int, total int, low int, high int", [(0, 10, 10, 60), (5, 10, 10, 60), (20, 10, 10, 60), (1, 0, 60, 90), (1, 3, 0, 100)])


@query("f59_progress", f"SELECT done, total, CAST(floor(low + (high - low) * CASE WHEN total > 0 THEN least(greatest(done / total, 0), 1) ELSE 0 END) AS INTEGER) AS percent FROM {STEPS.sql}")
def progress(spark, d):
    return STEPS.df(spark).select("done", "total", M.stage_progress(F.col("done"), F.col("total"), F.col("low"), F.col("high")).alias("percent"))


REQ = Rows("raw string", [("IELTS 6.5",), ("a degree with capacity",), ("SAT or ACT",), ("A-Level maths",), ("IB diploma",), ("satisfactory",), (None,)])


@query("w9_exam_inference", f"""
SELECT raw, CASE {' '.join(f"WHEN regexp_matches(lower(coalesce(raw, '')), '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)') THEN '{n}'" for t, n, _ in V.EXAMS)} END AS exam,
 CASE {' '.join(f"WHEN regexp_matches(lower(coalesce(raw, '')), '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)') THEN '{f}'" for t, _, f in V.EXAMS)} END AS family FROM {REQ.sql}""")
def exam_inference(spark, d):
    e = M.inferred_exam(F.col("raw"))
    return REQ.df(spark).select("raw", e["name"].alias("exam"), e["family"].alias("family"))
