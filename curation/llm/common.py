"""What the corpus operators share: table access, Arrow limits, shared storage and a row pre-filter of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key filter for each row that may hold a key, and the least and most bits it has: 128 KB to 128 MB.
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Bound an Arrow batch by rows and by bytes; very long texts would else fill a worker's memory.

    Spark reads both settings when a plan is run, so they stay set for the session's later queries.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Until it ends, Spark broadcasts a side of a join by its measured size only, or where it is told to.

    The size of a Parquet table is estimated by its files, and a compressed one can be many times as large in the driver.
    """
    name, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {c: spark.conf.get(c, None) for c in (name, adaptive)}
    try:
        spark.conf.set(adaptive, before[adaptive] or spark.conf.get(name))
        spark.conf.set(name, "-1")
        yield
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Where that is unset, a temporary one serves in local mode, whose executors are the driver; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="curation-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/curation-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again: cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    """Bits for the keys of ``rows`` rows: a power of two between the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, bits_per_row * rows - 1).bit_length()))


def bitmap(keys: DataFrame, position: Column) -> DataFrame:
    """Bits at the positions (from 1) that ``keys`` fill, in rows of 4 KB (2**15 bits) each."""
    return (
        keys.select(position.alias("_s"))
        .groupBy(F.bitmap_bucket_number("_s").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    )


class KeyFilter:
    """The hashes of ``keys`` as a bitmap: of ``rows``, those that are surely not among the keys can be told without a shuffle.

    Its size follows from ``rows``, a bound of the number of keys, and ends at MOST_BITS; where it is too full to tell,
    all rows are "maybe", so results never depend on it.
    """

    def __init__(self, keys: DataFrame, columns: list[str], rows: int):
        self.bits = filter_bits(rows)
        self.bitmap = bitmap(keys, self.place([F.col(c) for c in columns]))

    def place(self, columns: list[Column]) -> Column:
        """1..bits, as the bitmap functions count from one."""
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits)) + 1

    def marked(self, df: DataFrame, columns: list[str], out: str) -> DataFrame:
        """Add boolean ``out``: false is certain, true may be another key of that bit. The broadcast side is the bitmap."""
        bits = self.bitmap.select(F.col("_bucket").alias(f"_b_{out}"), F.col("_bits").alias(f"_v_{out}"))
        position = F.bitmap_bit_position(F.col(f"_s_{out}")).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_v_{out}"), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))).cast("int"), F.lit(2)) == 1
        return (
            df.withColumn(f"_s_{out}", self.place([F.col(c) for c in columns]))
            .join(F.broadcast(bits), F.bitmap_bucket_number(F.col(f"_s_{out}")) == F.col(f"_b_{out}"), "left")
            .withColumn(out, F.coalesce(hit, F.lit(False)))
            .drop(f"_s_{out}", f"_b_{out}", f"_v_{out}")
        )
