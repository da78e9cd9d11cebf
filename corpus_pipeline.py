"""The corpus pipeline: quality classifier, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from curation.llm.common import small_batches, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; those it rejects go.

    Null and empty texts score 0.5 under any model, as they have no feature, and go; rows that repeat a text are judged alike, a row
    without id like any other. Without labels of good documents all scores are 0.5, and all rows go. An empty table
    gives none. Other columns, whatever their names, are handed on.
    """
    small_batches(spark)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = docs.select(F.struct("*").alias("_own"), F.col("text").alias("_text"))
    scored = quality.score_texts(held, weights, "_text", "_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select("_own.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null and empty text are equal; rows that repeat the id and the text share its verdict, a row without id stays only
    where its whole group has none. An empty table gives no rows; other columns are handed on.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a likeness of 0.8 or more, directly or not, that of the smallest id stays.

    Texts without words (null, empty) are linked with nothing and stay; rows that repeat an id share one verdict, rows
    without id stay. An empty table gives no rows; other columns are handed on.
    """
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, shingle_words=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id has go from the text.

    A document of which nothing is left goes too; ``n_chars`` follows the text where it changed. Null and empty texts
    stay as they are, rows that repeat an id lose nothing to each other but each what smaller ids have, a row without id none.
    An empty table gives no rows; other columns are handed on.
    """
    small_batches(spark)
    before = docs.select(F.struct("*").alias("_own"), "doc_id", "text")
    cut = substring_dedup.drop_repeated_passages(before, window=PASSAGE_WORDS)
    changed = ~F.col("text").eqNullSafe(F.col("_own.text"))
    kept = cut.where(~changed | (F.length("text") > 0))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("_own.n_chars"))}
    return kept.select(*[new.get(c, F.col(f"_own.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, in sequences of at most 4096 tokens.

    Null and empty texts are the end token alone; repeated rows are packed each for itself, a null id is handed through.
    An empty table gives no pieces; other columns are not read.
    """
    import public_tokenizers

    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Length from which a repeated passage goes, in words.
PASSAGE_WORDS = 50

STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: The classifier, the near-duplicate components and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
