"""Window-shaped operators: versions, runs, stops, retention, and the expiry of cache entries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def validity(rows: DataFrame, key: Sequence[str], since: str) -> DataFrame:
    """Version numbers from 1 and the end of each version: the start of the next, null for the current one."""
    w = W.partitionBy(*key).orderBy(since)
    return rows.withColumn("version_no", F.row_number().over(w)).withColumn("valid_to", F.lead(since).over(w))


def islands(rows: DataFrame, key: Sequence[str], position: str, member: str, blank: str) -> DataFrame:
    """Run number of member rows; blank rows bridge a run, any other row ends it. Null outside runs."""
    w = W.partitionBy(*key).orderBy(position)
    ends = F.sum(F.when(~F.col(member) & ~F.col(blank), 1).otherwise(0)).over(w)
    return rows.withColumn("run", F.when(F.col(member) | F.col(blank), ends))


def drop_long_islands(rows: DataFrame, key: Sequence[str], position: str, member: str, blank: str, least: int = 3) -> DataFrame:
    """Rows but those of runs with at least ``least`` member rows."""
    marked = islands(rows, key, position, member, blank)
    n = F.count_if(F.col(member)).over(W.partitionBy(*key, "run"))
    return marked.withColumn("_n", n).where(F.col("run").isNull() | (F.col("_n") < least)).drop("_n", "run")


def decreasing_yield(rows: DataFrame, key: Sequence[str], position: str, value: str, ratio: float = 0.2, least: int = 4) -> DataFrame:
    """``stop``: from the ``least``-th page on less than ``ratio`` of the mean before it, or the last two are all zero."""
    w = W.partitionBy(*key).orderBy(position)
    mean = F.avg(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    two = (F.max(value).over(w.rowsBetween(-1, 0)) == 0) & (F.row_number().over(w) >= 2)
    poor = (F.row_number().over(w) >= least) & (F.col(value) < ratio * mean)
    return rows.withColumn("stop", F.coalesce(poor, F.lit(False)) | F.coalesce(two, F.lit(False)))


def last_n(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_stop(rows: DataFrame, key: Sequence[str], page: str, rules: dict[str, Column]) -> DataFrame:
    """Earliest failing page and its first failing rule in the order given; ``exhausted`` where none fails."""
    reason, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (name, failed) in reversed(list(enumerate(rules.items()))):
        reason, rank = F.when(failed, name).otherwise(reason), F.when(failed, k).otherwise(rank)
    hit = rows.withColumn("_why", reason).withColumn("_rank", rank)
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct(F.col(page), F.col("_rank"), F.col("_why"))))
    out = hit.groupBy(*key).agg(first.alias("_f"), F.max(page).alias("_last"))
    return out.select(*key, F.coalesce(F.col("_f._why"), F.lit("exhausted")).alias("reason"), F.coalesce(F.col(f"_f.{page}"), "_last").alias("page"))


def gap_expired(rows: DataFrame, key: Sequence[str], time: str, seconds: int) -> DataFrame:
    """``expired``: no earlier row of the key within ``seconds``."""
    before = F.lag(time).over(W.partitionBy(*key).orderBy(time))
    return rows.withColumn("expired", before.isNull() | (F.timestamp_diff("SECOND", before, F.col(time)) >= seconds))


def cache_misses(accesses: DataFrame, key: str, at: str, order: str, seconds: int = 300) -> DataFrame:
    """``key``, ``order`` and ``expired`` of each access: it fills the entry anew if ``seconds`` have passed since the last fill.

    A hit doesn't renew an entry, so the answer depends on all accesses before: tasks stream the accesses of their keys in
    order and hold one key and the time of its fill.
    """
    limit = seconds * 1_000_000

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, fill = None, None
        for batch in batches:
            expired = []
            for k, us in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                old = fill is None or entry != k or us - fill >= limit
                if old:
                    entry, fill = k, us
                expired.append(old)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(expired, pa.bool_())], names=[key, order, "expired"])

    kinds = dict(accesses.dtypes)
    rows = accesses.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("_us")).repartition(key).sortWithinPartitions(key, "_us", order)
    return rows.mapInArrow(task, f"{key} {kinds[key]}, {order} {kinds[order]}, expired boolean")
