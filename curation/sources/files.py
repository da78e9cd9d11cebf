"""Small files and renames through Hadoop's file system of a path, so that any store Spark reaches will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``, sorted; none where it doesn't exist."""
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below ``path``, relative to it, sorted."""
    fs, at = _file_system(spark, path)
    found, root = [], at.toUri().getPath().rstrip("/")
    walk = fs.listFiles(at, True)
    while walk.hasNext():
        found.append(walk.next().getPath().toUri().getPath()[len(root) + 1 :])
    return sorted(f for f in found if not f.rsplit("/", 1)[-1].startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the one above ``target`` is made, and a ``target`` that is there already goes."""
    fs, at = _file_system(spark, source)
    _, to = _file_system(spark, target)
    fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"could not move {source} to {target}")


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace the file at ``path`` by one rename: readers find the old document or the new one, never a part."""
    jvm, fresh = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    fs, source = _file_system(spark, fresh)
    out = fs.create(source, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(target), how)


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
