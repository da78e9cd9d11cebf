"""Parents and children bucketed by one key, so that joins and groupings on it shuffle nothing; and counts from footers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Colocated:
    """Tables of the warehouse, each bucketed and sorted by ``key`` into as many buckets: one shuffle when they are written, none after."""

    def __init__(self, held: dict[str, DataFrame], key: str, buckets: int = 64):
        self.spark, self.key = next(iter(held.values())).sparkSession, key
        self.names = {name: f"colocated_{uuid.uuid4().hex}_{name}" for name in held}
        for name, df in held.items():
            df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(self.names[name])

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def drop(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which counts of Parquet tables come from the files' footers."""
    session = spark.newSession()
    for key, value in {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true", "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
        session.conf.set(key, value)
    return session


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n) of Parquet tables; no column is read."""
    session = footer_session(spark)
    counts = [session.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
