"""A whole database of tables with foreign keys: export, checked import, and snapshots by content.

Snapshots hold each version of a table once, in a folder named by a digest of its rows; a manifest names the versions that
a snapshot consists of, and one pointer file the snapshot that is current. An unchanged table costs a read and no write,
retention deletes what no manifest names, and a restore replaces the pointer by one rename.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from graphlib import TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curation.sources import files, tables


class Key(NamedTuple):
    """``child.column`` refers to ``parent.parent_column``; null refers to nothing."""

    child: str
    column: str
    parent: str
    parent_column: str


def parents_first(names: list[str], keys: list[Key]) -> list[str]:
    """``names`` so that every table comes after those it refers to; as given where nothing decides."""
    graph = TopologicalSorter({n: [] for n in names})
    for k in keys:
        if k.child != k.parent and {k.child, k.parent} <= {*names}:
            graph.add(k.child, k.parent)
    return [*graph.static_order()]


def broken_keys(held: dict[str, DataFrame], keys: list[Key]) -> list[tuple[Key, int, str]]:
    """Keys with child rows whose parent is missing: their number and the least of them. One anti-join a key."""
    checks = []
    for i, k in enumerate(keys):
        if {k.child, k.parent} <= held.keys():
            child = held[k.child].select(F.col(k.column).alias("k")).where("k is not null")
            missing = child.join(held[k.parent].select(F.col(k.parent_column).alias("k")), "k", "left_anti")
            checks.append(missing.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n"), F.min("k").cast("string").alias("least")))
    found = reduce(lambda a, b: a.unionByName(b), checks).where("n > 0").collect() if checks else []
    return [(keys[r["i"]], r["n"], r["least"]) for r in sorted(found)]


def export_database(held: dict[str, DataFrame], path: str, keys: list[Key]) -> DataFrame:
    """Every table as JSON, parents first, and the manifest of row counts."""
    return tables.export_tables({n: held[n] for n in parents_first([*held], keys)}, path)


def import_database(spark: SparkSession, path: str, target: str, schemas: dict[str, StructType], keys: list[Key], force: bool = False) -> dict[str, DataFrame]:
    """The tables of an export, typed, as the snapshot store at ``target``; nothing is committed unless all of it holds.

    Refused where ``target`` has rows (unless forced), where a manifest's row count differs from what is read, and where a
    child row has no parent: the message names table, column and value. The JSON is read once, into a folder beside the
    store's parts; what is checked there is renamed in, or deleted.
    """
    store = SnapshotStore(spark, target)
    full = [n for n, df in store.tables().items() if not df.isEmpty()]
    if full and not force:
        raise ValueError(f"tables that are not empty: {', '.join(sorted(full))}")
    order = parents_first([*schemas], keys)
    stage = f"{target}/staged-{uuid.uuid4().hex}"
    staged = {n: f"{stage}/{n}" for n in order}
    try:
        for name, df in tables.import_tables(spark, path, {n: schemas[n] for n in order}).items():
            df.write.parquet(staged[name])
        read = {n: spark.read.schema(schemas[n]).parquet(at) for n, at in staged.items()}
        said = {r["name"]: r["rows"] for r in spark.read.schema("name string, rows long").json(f"{path}/manifest").collect()}
        counts = reduce(lambda a, b: a.union(b), [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, df in read.items()])
        differ = [f"{r['name']} ({r['rows']} of {said.get(r['name'])} rows)" for r in counts.collect() if said.get(r["name"]) != r["rows"]]
        if differ:
            raise ValueError(f"tables that differ from the manifest: {', '.join(sorted(differ))}")
        broken = broken_keys(read, keys)
        if broken:
            raise ValueError("rows without parent: " + "; ".join(f"{k.child}.{k.column} = {least} ({n} rows, no {k.parent}.{k.parent_column})" for k, n, least in broken))
        store.snapshot(read, order, staged)
    finally:
        files.delete(spark, stage)
    return store.tables()


class SnapshotStore:
    """Snapshots of a database below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, table: str, digest: str) -> str:
        return f"{self.path}/parts/{table}/{digest}"

    @staticmethod
    def digest(df: DataFrame) -> str:
        """Of the schema and the rows, in any order: their number and two independent sums of row hashes."""
        hashes = [F.sum(F.xxhash64(F.lit(salt), *df.columns).cast("decimal(38,0)")).cast("string") for salt in (0, 1)]
        n, *sums = df.agg(F.count(F.lit(1)), *hashes).first()
        return hashlib.sha256(f"{df.schema.json()}|{n}|{sums}".encode()).hexdigest()[:32]

    def versions(self) -> list[int]:
        """Numbers of the snapshots, oldest first."""
        return [int(f.removeprefix("version=")) for f in files.folders(self.spark, f"{self.path}/manifests") if f.startswith("version=")]

    def manifest(self, version: int) -> dict:
        return files.get_json(self.spark, f"{self.path}/manifests/version={version:09d}/manifest.json")

    def snapshot(self, held: dict[str, DataFrame], order: list[str] | None = None, staged: dict[str, str] | None = None) -> int:
        """A new snapshot, which becomes the current one; its number. Tables of known content are not written again, and
        of ``staged`` folders that hold a table as it is to be kept, each is renamed in."""
        version = max(self.versions(), default=0) + 1
        named = {}
        for name in order or held:
            digest = named[name] = self.digest(held[name])
            if not files.exists(self.spark, f"{self._at(name, digest)}/_SUCCESS"):
                if name in (staged or {}):
                    files.move(self.spark, staged[name], self._at(name, digest))
                else:
                    held[name].write.mode("overwrite").parquet(self._at(name, digest))
        manifest = {"order": [*(order or held)], "tables": {n: {"digest": d, "schema": held[n].schema.jsonValue()} for n, d in named.items()}}
        files.put_json(self.spark, f"{self.path}/manifests/version={version:09d}/manifest.json", manifest)
        self.restore(version)
        return version

    def current(self) -> int | None:
        pointer = f"{self.path}/current.json"
        return files.get_json(self.spark, pointer)["version"] if files.exists(self.spark, pointer) else None

    def restore(self, version: int) -> None:
        """All tables of the database are those of the snapshot, from one moment to the next."""
        if version not in self.versions():
            raise ValueError(f"no snapshot {version}")
        files.put_json(self.spark, f"{self.path}/current.json", {"version": version})

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot, or of the current one, parents before children."""
        version = version or self.current()
        if version is None:
            return {}
        manifest = self.manifest(version)
        own = manifest["tables"]
        return {n: self.spark.read.schema(StructType.fromJson(own[n]["schema"])).parquet(self._at(n, own[n]["digest"])) for n in manifest["order"]}

    def retain(self, keep: int) -> list[int]:
        """Drop all but the newest ``keep`` snapshots and the current one, and parts that no manifest names; what is left, newest first."""
        found = self.versions()[::-1]
        left = [v for i, v in enumerate(found) if i < keep or v == self.current()]
        for v in found:
            if v not in left:
                files.delete(self.spark, f"{self.path}/manifests/version={v:09d}")
        named = {(n, own["digest"]) for v in left for n, own in self.manifest(v)["tables"].items()}
        for table in files.folders(self.spark, f"{self.path}/parts"):
            for digest in files.folders(self.spark, f"{self.path}/parts/{table}"):
                if (table, digest) not in named:
                    files.delete(self.spark, self._at(table, digest))
        return left
