"""Top-k similarity join of names: the best entries of each name, scored only where they can still be among them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curation.functions import text as T
from curation.operators import fuzzy

#: Entries that a key of the first round may have; commoner keys are left to the second.
RARE = 32
#: Tokens of a name whose pairs and triples are keys of the first round.
KEY_TOKENS = 6
#: Occurrences of a character that the bitmap tells apart, in longs of nine characters each.
OCCURRENCES, CHARACTERS = 7, "abcdefghijklmnopqrstuvwxyz0123456789"


def character_bits(squashed: Column) -> tuple[list[Column], Column]:
    """Four longs with bit (c, i) set if ``c`` stands in the name more than i times, and how many occurrences are beyond that."""
    counts = [F.length(squashed) - F.length(F.replace(squashed, F.lit(c), F.lit(""))) for c in CHARACTERS]
    filled, longs = F.array(*(F.lit((1 << n) - 1).cast("long") for n in range(OCCURRENCES + 1))), []
    for at in range(0, len(CHARACTERS), 9):
        ones = [F.element_at(filled, F.least(n, F.lit(OCCURRENCES)) + 1) * (1 << OCCURRENCES * i) for i, n in enumerate(counts[at : at + 9])]
        longs.append(reduce(add, ones))
    return longs, reduce(add, (F.greatest(n - OCCURRENCES, F.lit(0)) for n in counts))


def prepared(names: DataFrame, name: str, mark: str) -> DataFrame:
    """Distinct names with their tokens, squashed form and character bitmap; columns end with ``mark``."""
    squashed = T.squashed(F.col(name))
    longs, beyond = character_bits(F.col("_s"))
    rows = names.select(F.col(name).alias(f"name_{mark}"), squashed.alias("_s"), F.array_distinct(T.tokens(F.col(name))).alias(f"tokens_{mark}")).where("_s <> ''").distinct()
    return rows.select(f"name_{mark}", F.col("_s").alias(f"squashed_{mark}"), f"tokens_{mark}", F.array(*longs).alias(f"bits_{mark}"), beyond.alias(f"beyond_{mark}"))


def bound(a: str = "a", b: str = "b") -> Column:
    """No less than the score of two names: the sequence ratio is at most that of the characters they have in common."""
    bits = reduce(add, (F.bit_count(F.col(f"bits_{a}")[i].bitwiseAND(F.col(f"bits_{b}")[i])) for i in range(4)))
    common = bits + F.least(f"beyond_{a}", f"beyond_{b}")
    x, y = F.col(f"squashed_{a}"), F.col(f"squashed_{b}")
    ratio = 2.0 * common / (F.length(x) + F.length(y))
    inside = F.when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(0.0)
    return F.greatest(ratio, inside, 0.95 * T.jaccard(F.col(f"tokens_{a}"), F.col(f"tokens_{b}")))


def keyed(rows: DataFrame, mark: str) -> DataFrame:
    """Every token, and every pair and triple of the first tokens in alphabetical order, as a key of the name."""
    own = F.slice(F.array_sort(F.col(f"tokens_{mark}")), 1, KEY_TOKENS)
    pairs = F.flatten(F.transform(own, lambda x: F.transform(F.filter(own, lambda y: y > x), lambda y: F.concat_ws(" ", x, y))))
    triples = F.flatten(F.transform(own, lambda x: F.flatten(F.transform(F.filter(own, lambda y: y > x), lambda y: F.transform(F.filter(own, lambda z: z > y), lambda z: F.concat_ws(" ", x, y, z))))))
    return rows.withColumn("key", F.explode(F.concat(F.col(f"tokens_{mark}"), pairs, triples)))


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.bround(fuzzy.taxonomy_score(F.col("name_a"), F.col("name_b")), 4)).where("score > 0")


def best_entries(signals: DataFrame, signal: str, entries: DataFrame, entry: str, k: int = 3, itself: bool = True) -> DataFrame:
    """signal, entry, score, n: the ``k`` best of the entries that share a token with a signal, or are equal to it when squashed.

    Scores are those of ``fuzzy.taxonomy_score`` rounded to four places; ties go by name. Blank names have no entries.

    1. Keys of few entries (rare tokens, pairs and triples of tokens) give candidates in proportion to the names; the k-th
       best score among them is a floor for what can still enter.
    2. Names meet on common tokens too, but leave the join only if an upper bound of their score reaches the signal's
       floor: characters in common, containment, or overlap of tokens. Only those are scored.
    """
    a, b = prepared(signals, signal, "a"), prepared(entries, entry, "b")
    own = F.lit(True) if itself else F.col("name_a") != F.col("name_b")
    names = b.select("name_b", F.explode("tokens_b").alias("token"))
    frequent = names.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > RARE).select("token")

    keys = keyed(b, "b").select("key", "name_b")
    few = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.collect_list("name_b").alias("all")).where(F.col("df") <= RARE)
    near = keyed(a, "a").select("key", "name_a").join(few, "key").select("name_a", F.explode("all").alias("name_b"))
    equal = a.join(b, F.col("squashed_a") == F.col("squashed_b")).select("name_a", "name_b")
    first = scored(near.union(equal).where(own).distinct())
    order = Window.partitionBy("name_a").orderBy(F.desc("score"), "name_b")
    top = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    floors = top.groupBy("name_a").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("floor"))

    common = a.withColumn("token", F.explode("tokens_a")).join(frequent, "token", "left_semi").join(floors, "name_a", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    others = b.withColumn("token", F.explode("tokens_b"))
    met = common.join(others.withColumnRenamed("token", "_token"), (F.col("token") == F.col("_token")) & own & (bound() + 1e-4 >= F.col("floor")))
    second = met.select("name_a", "name_b").distinct().join(first.select("name_a", "name_b"), ["name_a", "name_b"], "left_anti")
    both = top.drop("n").union(scored(second)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return both.select(F.col("name_a").alias("signal"), F.col("name_b").alias("entry"), "score", "n")
