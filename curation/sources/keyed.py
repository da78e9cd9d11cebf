"""Tables whose rows are dealt to folders by a hash of their key: a merge rewrites only the folders in which keys match.

A pointer file names, for each bucket, the folder that holds its rows. A merge writes the buckets it touches into new
folders and then replaces the pointer by one rename: readers see all of a merge or nothing of it, files of other buckets
keep their names, and a writer that is lost leaves only folders that no pointer names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curation.operators import merge
from curation.sources import files

POINTER = "pointer.json"


class KeyedTable:
    """The table at ``path``; ``key`` deals its rows to ``buckets`` folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.pointer = files.get_json(spark, f"{path}/{POINTER}")
        self.key, self.buckets = self.pointer["key"], self.pointer["buckets"]
        self.schema = StructType.fromJson(self.pointer["schema"])

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: Sequence[str], buckets: int = 64) -> KeyedTable:
        spark = rows.sparkSession
        pointer = {"key": [*key], "buckets": buckets, "schema": rows.schema.jsonValue(), "at": {}}
        pointer["at"] = cls._written(rows, path, cls._bucket([*key], buckets), range(buckets))
        files.put_json(spark, f"{path}/{POINTER}", pointer)
        return cls(spark, path)

    @staticmethod
    def _bucket(key: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    @staticmethod
    def _written(rows: DataFrame, path: str, bucket: Column, of: Sequence[int]) -> dict[str, str]:
        """The folders, relative to ``path``, that now hold the rows of the buckets in ``of``; a bucket without rows has none."""
        new = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", bucket).repartition(max(1, len(of)), "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{path}/{new}")
        found = files.folders(rows.sparkSession, f"{path}/{new}")
        return {f.removeprefix("_bucket="): f"{new}/{f}" for f in found if f.startswith("_bucket=")}

    def read(self, of: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        at = self.pointer["at"]
        paths = [f"{self.path}/{at[b]}" for b in (at if of is None else map(str, of)) if b in at]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that ``keys`` fall in; at most as many rows as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(self.key, self.buckets)).distinct().collect())

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the buckets that ``keys`` fall in by ``change`` of them; the buckets that were rewritten.

        What ``change`` returns must have the table's columns and keys of these buckets only.
        """
        touched = self.buckets_of(keys)
        if touched:
            new = self._written(change(self.read(touched)).select(self.schema.names), self.path, self._bucket(self.key, self.buckets), touched)
            left = {b: f for b, f in self.pointer["at"].items() if int(b) not in touched}
            self.pointer = self.pointer | {"at": left | new}
            files.put_json(self.spark, f"{self.path}/{POINTER}", self.pointer)
        return touched

    def upsert(self, new: DataFrame) -> list[int]:
        """Insert or update by key; only given values overwrite."""
        return self.rewrite(new, lambda old: merge.upserted(old, new, self.key).drop("created"))

    def delete(self, keys: DataFrame) -> list[int]:
        """Delete the rows of the given keys; of parents and children that are dealt by the same key, call it for each."""
        return self.rewrite(keys, lambda old: old.join(keys.select(*self.key).distinct(), self.key, "left_anti"))

    def sync(self, new: DataFrame, parent: Sequence[str]) -> list[int]:
        """The rows of the parents in ``new`` become those of ``new``: stale ones go, others are inserted or updated.

        The table must be dealt by ``parent``.
        """
        assert [*parent] == self.key, self.key
        return self.rewrite(new, lambda old: old.join(new.select(*parent).distinct(), [*parent], "left_anti").unionByName(new))

    def recompute(self, column: str, value: Column) -> list[int]:
        """Set ``column`` to ``value`` where it differs; buckets without such a row keep their files."""
        rows = self.read()
        stale = rows.where(~value.eqNullSafe(F.col(column)))
        return self.rewrite(stale, lambda old: old.withColumn(column, value.cast(dict(old.dtypes)[column])))

    def vacuum(self) -> int:
        """Delete folders that the pointer doesn't name; how many there were. No merge may run meanwhile."""
        named = {f.split("/")[1] for f in self.pointer["at"].values()}
        partly = {f.split("/")[1]: set() for f in self.pointer["at"].values()}
        for f in self.pointer["at"].values():
            partly[f.split("/")[1]].add(f.split("/")[2])
        gone = 0
        for folder in files.folders(self.spark, f"{self.path}/data"):
            if folder not in named:
                files.delete(self.spark, f"{self.path}/data/{folder}")
                gone += 1
                continue
            for part in files.folders(self.spark, f"{self.path}/data/{folder}"):
                if part not in partly[folder]:
                    files.delete(self.spark, f"{self.path}/data/{folder}/{part}")
                    gone += 1
        return gone
