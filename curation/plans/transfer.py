"""Queries of exports, imports and formatters."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.plans.registry import Rows, query
from curation.sources import tables


SEEDS = ['["MSc A", "MSc B", ""]', '{"names": ["MSc B", "MSc C"]}', '{"items": ["MSc D"]}', "{bad"]


@query("s11_seed_load", "SELECT * FROM (VALUES ('MSc A'), ('MSc B'), ('MSc C'), ('MSc D')) v(name)")
def seed_load(spark, d):
    return tables.seed_entries(spark, SEEDS)


SHEETS = Rows("sheet string, pos int, cells array<string>", [("Arts", 0, ["Title"]), ("Arts", 1, ["English Name", "Duration"]), ("Arts", 2, ["MA", "1 year"]), ("Law", 0, ["x"]), ("Sci", 3, ["学费"]), ("Sci", 25, ["Duration"])])


@query("s2_header_row", f"SELECT sheet, min(pos) AS header FROM {SHEETS.sql} WHERE pos < 20 AND list_has_any(cells, ['English Name', 'Duration', '学费']) GROUP BY sheet")
def header_rows(spark, d):
    return tables.header_row(SHEETS.df(spark), "sheet", "pos", "cells", ["English Name", "Duration", "学费"])


@query("s3_column_mapping", "SELECT * FROM (VALUES ('English Name', 'name_en'), ('学费 (HKD)', 'tuition'), ('Notes', 'extra_metadata')) v(header, field)")
def column_mapping(spark, d):
    """Exact header, else the first known one that it contains, else the metadata."""
    known = [("English Name", "name_en"), ("学费", "tuition"), ("Duration", "duration")]
    rows = spark.createDataFrame([("English\nName",), ("学费 (HKD)",), ("Notes",)], "raw string").withColumn("header", F.regexp_replace("raw", "\n", " "))
    exact = F.coalesce(*[F.when(F.col("header") == k, v) for k, v in known])
    loose = F.coalesce(*[F.when(F.contains(F.col("header"), F.lit(k)), v) for k, v in known])
    return rows.select("header", F.coalesce(exact, loose, F.lit("extra_metadata")).alias("field"))
