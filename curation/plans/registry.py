"""Registered queries of the curation engine and their DuckDB SQL.

A plan module declares each query with ``@query(name, oracle)``; literal inputs are written once with ``Rows`` and
serve the Spark side and the SQL side alike.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Tables of texts of any length.
TEXTS = ("documents", "pages", "benchmark", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts go to Python in Arrow batches of 256 rows and 8 MB at most, which stays so for the session."""
    if name in TEXTS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rows:
    """A small literal table: ``df(spark)`` for Spark, ``sql`` (a parenthesised SELECT) for the oracle."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @staticmethod
    def _value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, dt.datetime):
            return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(Rows._value, v)) + "]"
        if isinstance(v, (int, float, Decimal)):
            return str(v)
        parts = str(v).split("\n")
        return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")"

    @property
    def sql(self) -> str:
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}
        names = ", ".join(n for n, _ in self.fields)
        casts = ", ".join(f"CAST({n} AS {kinds.get(k, k)}) AS {n}" for n, k in self.fields)
        values = ", ".join("(" + ", ".join(map(self._value, r)) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({names}))"


for _module in ("relational", "windows", "text", "urls", "money", "records", "writes", "quality", "jobs", "transfer", "extract", "pages", "merges", "intake", "exports", "storage", "cases"):
    importlib.import_module(f"curation.plans.{_module}")
