"""Queries of extraction, parsing of sheets and the remaining write and record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.functions import money as M
from curation.functions import text as T
from curation.plans.registry import Rows, query, table

SHEET = Rows("row int, name string, fee string, duration string, deadline string", [(1, "MSc A", "HK$ 350,000", "1 year full-time", "2025-03-01"), (2, None, "x", "y", "z"), (3, " ", None, None, None), (4, "MA B", "£9,250", "18 months", "none"), (5, "MA C", None, None, None)])


@query("s4_sheet_rows", """SELECT * FROM (VALUES (1, 'MSc A', 350000.00, 'HKD', 12, 'FullTime', 1), (4, 'MA B', 9250.00, 'GBP', 18, 'Unknown', 0), (5, 'MA C', NULL, NULL, NULL, 'Unknown', 0)) v(row, name, amount, currency, months, mode, deadlines)""")
def sheet_rows(spark, d):
    """Typed rows of a sheet; rows without a name are dropped."""
    c = F.col
    return SHEET.df(spark).where(~T.blank(c("name"))).select(
        "row", "name", M.tuition_amount(c("fee")).alias("amount"), M.tuition_currency(c("fee")).alias("currency"), M.duration_months(c("duration")).alias("months"),
        M.duration_mode(c("duration")).alias("mode"), F.size(M.dates_in(F.coalesce("deadline", F.lit("")))).alias("deadlines"),
    )


@query("s13_case_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS case_id FROM part")
def case_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name"), "case").alias("case_id"))


MECH = Rows("url string, mode string", [("https://x.edu/l?page=3", "server"), ("https://x.edu/l", "client_wait"), ("https://x.edu/l", "server")])


@query("f55_paging_mechanism", f"SELECT url, mode, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN 'url_pages' WHEN mode = 'client_wait' THEN 'scroll' ELSE 'none' END AS mechanism FROM {MECH.sql}")
def paging_mechanism(spark, d):
    return MECH.df(spark).select("url", "mode", F.when(F.col("url").rlike("[?&]page=[0-9]+"), "url_pages").when(F.col("mode") == "client_wait", "scroll").otherwise("none").alias("mechanism"))


RESULTS = Rows("id int, body string", [(1, '{"status":"ok","count":3,"items":[1,2]}'), (2, '{"error":"x"}'), (3, "text")])


@query("f56_result_placeholder", """SELECT * FROM (VALUES (1, '[result status=ok count=3]'), (2, '[result error=x]'), (3, '[result]')) v(id, placeholder)""")
def result_placeholder(spark, d):
    parts = [F.concat(F.lit(f"{k}="), F.get_json_object("body", f"$.{k}")) for k in ("status", "count", "error")]
    return RESULTS.df(spark).select("id", F.concat(F.lit("["), F.concat_ws(" ", F.lit("result"), *parts), F.lit("]")).alias("placeholder"))


HREFS = Rows("href string", [("?page=2&sort=a",), ("/l?start=20",), ("#",)])


@query("f57_page_params", """SELECT * FROM (VALUES ('?page=2&sort=a', 'page', 2), ('/l?start=20', 'start', 20)) v(href, param, value)""")
def page_params(spark, d):
    pairs = F.str_to_map(F.regexp_extract("href", r"\?(.*)$", 1), F.lit("&"), F.lit("="))
    rows = HREFS.df(spark).select("href", F.explode(pairs).alias("param", "raw")).withColumn("value", F.col("raw").try_cast("int"))
    return rows.where(F.col("value").isNotNull()).select("href", "param", "value")


BYTES = Rows("id int, raw string", [(1, "plain"), (2, "é"), (3, None)])


@query("f12_f13_safe_names_and_decoding", f"SELECT id, regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g') AS file, raw AS decoded FROM {BYTES.sql}")
def safe_names_and_decoding(spark, d):
    """File names without odd characters; bytes decoded as UTF-8, else GB18030, else Latin-1."""
    decoded = T.decoded(F.encode("raw", "UTF-8"))
    return BYTES.df(spark).select("id", F.regexp_replace("raw", "[^A-Za-z0-9._-]+", "_").alias("file"), decoded.alias("decoded"))


RAW = [(1, "plain é 中".encode()), (2, "硕士课程 𠀀".encode("gb18030")), (3, "é!".encode("latin-1")), (4, None), (5, b"")]


@query("f13_decoding_ladder", "SELECT * FROM (VALUES (1, 'plain é 中'), (2, '硕士课程 𠀀'), (3, 'é!'), (4, NULL), (5, '')) v(id, decoded)")
def decoding_ladder(spark, d):
    """Bytes that are UTF-8, only GB18030, and only Latin-1."""
    return spark.createDataFrame(RAW, "id int, raw binary").select("id", T.decoded(F.col("raw")).alias("decoded"))


@query("w10_requirements_from_metadata", """SELECT * FROM (VALUES (1, 'english requirement', 'IELTS'), (1, 'other requirements', 'CV')) v(id, key, text)""")
def requirements_from_metadata(spark, d):
    rows = spark.sql("SELECT 1 AS id, map('english requirement', 'IELTS', 'note', 'x', 'other requirements', 'CV') AS extra")
    kept = F.map_filter("extra", lambda k, v: F.contains(F.lower(k), F.lit("requirement")) & (F.trim(v) != ""))
    return rows.select("id", F.explode(kept).alias("key", "text"))


@query("w29_persisted_records", """SELECT * FROM (VALUES (1, 'a'), (1, 'b'), (2, 'c')) v(step, name)""")
def persisted_records(spark, d):
    """Records of a step's result, else those it was given if it upserted any."""
    rows = spark.createDataFrame([(1, '{"records":["a","b"]}', '["x"]'), (2, '{"upserts":1}', '["c"]'), (3, '{"upserts":0}', '["d"]')], "step int, result string, given string")
    own = F.from_json(F.get_json_object("result", "$.records"), "array<string>")
    names = F.when(own.isNotNull(), own).when(F.get_json_object("result", "$.upserts").cast("int") > 0, F.from_json("given", "array<string>"))
    return rows.select("step", F.explode(names).alias("name"))
