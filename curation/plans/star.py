"""The programme star read from the order tables: nations are universities, customers catalogue entries, orders
programmes of a year, line items fee rows. ``CTE`` is the same star for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.plans.registry import table

CTE = """
WITH university AS (SELECT n_nationkey AS university_id, n_name AS university, lower(n_name) AS slug FROM nation),
catalog AS (SELECT c_custkey AS catalog_id, c_name AS catalog_name, c_nationkey AS university_id FROM customer),
program AS (SELECT o_orderkey AS program_id, o_custkey AS catalog_id, CAST(year(o_orderdate) AS INTEGER) AS academic_year,
                   o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS tuition, o_orderdate AS updated_at FROM orders),
fee AS (SELECT l_orderkey AS program_id, l_linenumber AS line, l_returnflag AS scope, l_linestatus AS mode,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, CAST(l_shipdate AS DATE) AS cutoff,
               CASE WHEN l_linenumber % 3 = 0 THEN 'per_year' ELSE 'per_programme' END AS basis FROM lineitem)
"""


def university(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("university_id"), F.col("n_name").alias("university"), F.lower("n_name").alias("slug"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("catalog_id"), F.col("c_name").alias("catalog_name"), F.col("c_nationkey").alias("university_id"))


def program(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("program_id"), F.col("o_custkey").alias("catalog_id"), F.year("o_orderdate").alias("academic_year"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("tuition"), F.col("o_orderdate").alias("updated_at"),
    )


#: Where a row stands in its table: its file, and its place there.
PLACE = ("file", "place")


def fee(spark: SparkSession, d: str, placed: bool = False) -> DataFrame:
    """Fee rows; ``placed`` adds ``PLACE``, which tells rows of one line number apart."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")] if placed else []
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("program_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("scope"), F.col("l_linestatus").alias("mode"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"), F.to_date("l_shipdate").alias("cutoff"),
        F.when(F.col("l_linenumber") % 3 == 0, "per_year").otherwise("per_programme").alias("basis"), *at,
    )
