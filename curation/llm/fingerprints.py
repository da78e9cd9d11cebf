"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's word shingles. The sketch of a
union is the bottom-k of the parts' sketches, so sketches merge across parts in any order. While a text has no more
than k distinct shingles its sketch is its whole shingle set and every estimate is exact.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.llm.common import table

K = 128
SHINGLE_WORDS = 5
#: Runs of ids that the rows are dealt to for finding each row's successor, per shuffle partition.
RUNS_PER_PARTITION = 8
_LOWEST = -(1 << 63)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def shingle_hashes(word_array: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hash of each run of ``size`` words; fewer words make one shingle, none make no shingle."""
    n = F.size(word_array)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(word_array, i, size)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(runs)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets; two empty sketches are alike (1), one empty is unlike (0)."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in 0..1."""
    place = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; an empty a is contained in anything."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.concat_ws(",", F.transform(a, lambda h: F.lower(F.hex(h))))


def with_sketch(docs: DataFrame, text_col: str = "text", out: str = "sketch", k: int = K) -> DataFrame:
    """``docs`` with the sketch of each whole text (null: empty) in ``out``."""
    held = docs.select(F.struct("*").alias("_own"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    return held.select("_own.*", bottom(shingle_hashes(F.col("_words")), k).alias(out))


def merged_by(sketches: DataFrame, key: str, sketch_col: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per ``key`` for any number of parts.

    Only the k smallest hashes of a key and salt, then of a key, ever stand together, so a hot key stays small.
    """
    hashes = sketches.select(F.col(key), F.explode(sketch_col).alias("_h")).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)))
    few = hashes.distinct().withColumn("_n", F.row_number().over(W.partitionBy(key, "_salt").orderBy("_h"))).where(F.col("_n") <= k)
    last = few.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_h"))).where(F.col("_n") <= k)
    return last.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _run_of(key: Column, splits: list[int]) -> Column:
    """How many of the sorted ``splits`` are at most ``key``, found in two short scans."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    heads, blocks = splits[::step], [splits[i : i + step] for i in range(0, len(splits), step)]
    block = F.size(F.filter(_literal(heads, "array<bigint>"), lambda x: x <= key))
    inside = F.size(F.filter(F.element_at(_literal(blocks, "array<array<bigint>>"), block), lambda x: x <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def with_edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next row's
    text in ascending id; after the last row comes the first. Null text is empty, a null id comes before all others,
    rows of one id are ordered by text. A single row follows itself. An empty table gives no rows; other columns are
    not read.

    Rows are dealt to runs of ids by quantiles, which keeps runs even whatever the ids are; the first row of a run is
    also sent, marked, to the end of the run before it. So every row meets its successor after one shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col), F.lit(_LOWEST)).cast("long").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = RUNS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    found = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"]
    run = _run_of(F.col("_key"), sorted(set(found or [])))
    # at most n rows: the first id of each run that has any
    first = {r["run"]: r["key"] for r in rows.select(run.alias("run"), "_key").groupBy("run").agg(F.min("_key").alias("key")).collect()}
    full = sorted(first)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    starts = [first.get(b) for b in range(max(full, default=0) + 1)]
    targets = [before.get(b, 0) for b in range(len(starts))]
    dealt = rows.withColumn("_run", run)
    start = F.element_at(_literal(starts, "array<bigint>"), F.col("_run") + 1)
    target = F.element_at(_literal(targets, "array<int>"), F.col("_run") + 1)
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("sent"))
    sent = F.struct(target.alias("run"), F.lit(1).alias("sent"))
    dealt = dealt.select("_id", "_key", "_text", F.explode(F.when(F.col("_key") == start, F.array(own, sent)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select("_id", "_key", "_text", "_to.run", "_to.sent")

    order = W.partitionBy("run").orderBy("sent", "_key", "_text")
    half = F.floor(F.char_length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.char_length("_text") - half), F.substring(F.col("_next"), F.lit(1), half))
    rows = dealt.withColumn("_next", F.lead("_text").over(order)).withColumn("_edited", F.coalesce(edited, F.col("_text"))).drop("_next")
    rows = rows.withColumn("_w", words(F.col("_text"))).withColumn("_we", words(F.col("_edited")))
    rows = rows.select(
        "_id", "_key", "_text", "run", "sent", F.char_length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        bottom(shingle_hashes(F.col("_w")), k).alias("_f"), bottom(shingle_hashes(F.col("_we")), k).alias("_fe"),
    )
    rows = rows.withColumn("_fn", F.lead("_f").over(order)).where("sent = 0")
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("_f")).alias("fingerprint"), as_text(F.col("_fe")).alias("edited_fingerprint"),
        resemblance(F.col("_f"), F.col("_fe"), k).alias("near_edited"), resemblance(F.col("_f"), F.col("_fn"), k).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
