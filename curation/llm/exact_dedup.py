"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each round counts small keys and hands the next one only the rows whose key is shared. Who survives is told by a
bitmap of bounded size (see ``common``), so no text is shuffled to find the groups and a hot group is only ever a key with
a count. A bit shared by two keys merely lets a row into a later round; groups are formed on SHA-256 alone. Columns
that are carried along go through a join only for rows that reach the last round; the groups are written before that
join, so nothing but an exchange stands below it and Spark may split a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import KeyFilter, table, written


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: list[str] | None = None, prefix_chars: int = 64, digest_all: bool = False
) -> DataFrame:
    """Every row's ``carry`` columns (default: the id) with ``full_hash, keep_id, group_size, kept``.

    Of equal texts the largest id stays. Null and empty text are equal. Rows that repeat an id and a text share
    one verdict; a null id never wins against another and is kept only if its whole group has none. An empty table
    gives no rows. Carried columns named like a result column are replaced by it. ``full_hash`` is null for a row
    that earlier rounds proved unique, unless ``digest_all``.
    """
    names = ["full_hash", "keep_id", "group_size", "kept"]
    carried = [c for c in (carry or [id_col]) if c not in names]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_len", F.octet_length("_text"))

    total = docs.count()

    lengths = rows.groupBy("_len").count().where("count > 1")
    by_length = KeyFilter(lengths, ["_len"], total)

    def second_round(df: DataFrame) -> DataFrame:
        df = by_length.marked(df, ["_len"], "_shared_length")
        return df.withColumn("_prefix", F.when(F.col("_shared_length"), F.xxhash64(F.substring("_text", 1, prefix_chars))))

    prefixes = second_round(rows).where("_prefix is not null").groupBy("_len", "_prefix").count().where("count > 1")
    by_prefix = KeyFilter(prefixes, ["_len", "_prefix"], total)

    survives: Column = F.col("_shared_length") & F.col("_shared_prefix")
    third = by_prefix.marked(second_round(rows), ["_len", "_prefix"], "_shared_prefix")
    hashed = third.withColumn("_full", F.when(survives, F.sha2("_text", 256)))
    groups = written(
        hashed.where("_full is not null")
        .groupBy("_full")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    # rows that earlier rounds proved unique don't go through the join
    lone_hash = F.sha2("_text", 256) if digest_all else F.lit(None).cast("string")
    lone = hashed.where("_full is null").select(
        "_row.*", lone_hash.alias("full_hash"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    joined = hashed.where("_full is not null").select("_row", "_id", "_full").join(groups, "_full", "left")
    return lone.unionByName(
        joined.select(
            "_row.*",
            F.col("_full").alias("full_hash"),
            F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
            (F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns."""
    kept = exact_duplicates(docs.select(F.struct("*").alias("_own"), F.col(id_col).alias("_key_id"), F.col(text_col).alias("_key_text")), "_key_id", "_key_text", carry=["_own"])
    return kept.where("kept").select("_own.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
