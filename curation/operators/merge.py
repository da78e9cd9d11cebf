"""MERGE-shaped writes as pure functions (old, new) -> merged rows or actions, and a swap write for Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def applied(new: Column, old: Column, kind: str) -> Column:
    """The new value unless it is null or a blank string."""
    given = F.when(F.trim(new) != "", new) if kind == "string" else new
    return F.coalesce(given, old)


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both tables merged on ``key``; only given values overwrite. ``created`` is true for new keys, null for untouched rows."""
    columns = [c for c in old.columns if c not in key]
    kinds = dict(old.dtypes)
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_old"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    both = o.join(n, [*key], "full_outer")
    merged = [applied(F.col(f"_n_{c}"), F.col(f"_o_{c}"), kinds[c]).alias(c) for c in columns]
    return both.select(*key, *merged, F.when(F.col("_new"), F.col("_old").isNull()).alias("created"))


def child_actions(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``action`` per child key: insert, update, delete (stale) or keep."""
    o = old.select(*key, F.struct(*values).alias("_o"))
    n = new.select(*key, F.struct(*values).alias("_n"))
    both = o.join(n, [*key], "full_outer")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o").eqNullSafe(F.col("_n")), "keep").otherwise("update")
    return both.select(*key, action.alias("action"), F.coalesce("_n", "_o").alias("_v")).select(*key, "action", "_v.*")


def patched(rows: DataFrame, patch: dict[str, object], where: Column, allowed: Sequence[str]) -> DataFrame:
    """Rows with whitelisted fields set where ``where`` holds; an explicit None sets null."""
    refused = [c for c in patch if c not in allowed]
    if refused:
        raise ValueError(f"fields that may not be patched: {', '.join(sorted(refused))}")
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.when(where, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in patch.items()})


def fingerprint(*columns: Column) -> Column:
    """Digest of trimmed, lower-cased fields in fixed order; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in columns]), 256)


def versioned(current: DataFrame, incoming: DataFrame, key: str, mark: str, since: str) -> DataFrame:
    """SCD-2: a changed fingerprint closes the open version at the new start and appends the next number."""
    open_ = current.where("valid_to is null").select(key, F.col(mark).alias("_mark"), F.col("version_no").alias("_no"))
    change = incoming.join(open_, key, "left").where(F.col("_mark").isNull() | (F.col("_mark") != F.col(mark)))
    added = change.select(key, mark, since, (F.coalesce("_no", F.lit(0)) + 1).alias("version_no"), F.lit(None).cast(dict(current.dtypes)["valid_to"]).alias("valid_to"))
    ends = change.where("_mark is not null").select(key, F.col(since).alias("_end"))
    closed = current.join(ends, key, "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("_end")).otherwise(F.col("valid_to"))).drop("_end")
    return closed.select(key, mark, since, "version_no", "valid_to").unionByName(added)


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def deleted(parents: DataFrame, children: dict[str, DataFrame], doomed: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents and children left after a delete that cascades."""
    gone = doomed.select(key).distinct()
    return parents.join(gone, key, "left_anti"), {name: c.join(gone, key, "left_anti") for name, c in children.items()}


def swap_write(df: DataFrame, path: str) -> None:
    """Replace a Parquet table, through Hadoop's file system of the path.

    The new one is written beside the old one, which may be read for it; then the old one is renamed aside, the new one
    renamed in, and only then the old one deleted. A crash in between leaves the old rows in ``path`` or in
    ``path.<id>.old``.
    """
    spark: SparkSession = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    target, source, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, fresh, f"{fresh}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, aside) or not fs.rename(source, target):
        raise OSError(f"could not swap {path}")
    if had:
        fs.delete(aside, True)
