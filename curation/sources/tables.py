"""Whole-database export and import as JSON per table with a manifest, snapshots with retention, and seed files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Timestamps as ISO texts that keep microseconds.
ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def export_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as gzipped JSON lines below ``path`` and a manifest of row counts; timestamps are ISO, decimals strings."""
    for name, df in tables.items():
        plain = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind.startswith("decimal")})
        plain.write.mode("overwrite").options(**ISO, ignoreNullFields="false", compression="gzip").json(f"{path}/{name}")
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    manifest = reduce(lambda a, b: a.union(b), counts)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def import_tables(spark: SparkSession, path: str, schemas: dict[str, str | StructType], existing: dict[str, DataFrame] | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Tables of an export, typed; refused where a target has rows, unless forced."""
    full = [name for name, df in (existing or {}).items() if not df.isEmpty()]
    if full and not force:
        raise ValueError(f"tables that are not empty: {', '.join(sorted(full))}")
    return {name: spark.read.schema(schema).options(**ISO).json(f"{path}/{name}") for name, schema in schemas.items()}


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="curation-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def extra_keys(rows: DataFrame, column: str) -> list[str]:
    """The distinct keys of a metadata column, sorted; each becomes a column of an export, so there are few."""
    return sorted(r["k"] for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().collect())


def with_extra_columns(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``rows`` with the metadata spread over columns named after its keys, blank where there is no value."""
    spread = [F.coalesce(F.try_element_at(F.col(column), F.lit(k)), F.lit("")).alias(f"Extra: {k}") for k in keys]
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != column], *spread)


def _folders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory())


def snapshot(tables: dict[str, DataFrame], path: str, version: int) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version:06d}/{name}")


def snapshot_tables(spark: SparkSession, path: str, version: int) -> list[str]:
    return _folders(spark, f"{path}/version={version:06d}")


def retained(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Drop all but the newest ``keep`` snapshots; the versions left, newest first."""
    found = sorted((int(f.removeprefix("version=")) for f in _folders(spark, path) if f.startswith("version=")), reverse=True)
    jvm = spark.sparkContext._jvm
    for version in found[keep:]:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/version={version:06d}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return found[:keep]


def restored(spark: SparkSession, path: str, version: int, order: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot, parents before children."""
    names = snapshot_tables(spark, path, version)
    return {t: spark.read.parquet(f"{path}/version={version:06d}/{t}") for t in [*[o for o in order if o in names], *[n for n in names if n not in order]]}


def migrated(spark: SparkSession, path: str, version: int, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
    """Apply ``change`` to a snapshot's tables into the next version and return it; if that fails the old version stands."""
    try:
        snapshot(change(restored(spark, path, version, [])), path, version + 1)
    except ValueError:
        return version
    return version + 1


def seed_entries(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Seed names from JSON texts: lists of strings or objects, bare or under a known key."""
    from pyspark.sql.types import StringType

    raw = spark.createDataFrame(lines, StringType()).withColumn("v", F.try_parse_json("value"))
    wrapped = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<string>") for k in ("program_names", "names", "items", "data")])
    return raw.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<string>"), wrapped)).alias("name")).where(F.trim("name") != "").distinct()


def header_row(rows: DataFrame, sheet: str, position: str, cells: str, markers: list[str]) -> DataFrame:
    """Per sheet the first of its first 20 rows that holds a header marker."""
    hit = F.arrays_overlap(F.col(cells), F.array(*map(F.lit, markers)))
    return rows.where((F.col(position) < 20) & hit).groupBy(sheet).agg(F.min(position).alias("header"))
