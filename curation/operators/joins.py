"""Join-shaped operators over the programme star."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def having_one_row(parents: DataFrame, children: DataFrame, key: str, child_key: str, conditions: Sequence[Column]) -> DataFrame:
    """Parents with at least one child row that meets all conditions at once; without conditions, all parents.

    The children are filtered first and only their keys go into the semi-join.
    """
    if not conditions:
        return parents
    met = children
    for c in conditions:
        met = met.where(c)
    return parents.join(met.select(F.col(child_key).alias(key)), key, "left_semi")


def fee_conditions(scope=None, mode=None, most=None, basis=None, *, default_basis: str = "per_programme", columns=("scope", "mode", "amount", "basis")) -> list[Column]:
    """Predicates on one fee row; the basis takes its default as soon as any other filter is set."""
    s, m, a, b = columns
    given = [F.col(s) == scope] * (scope is not None) + [F.col(m) == mode] * (mode is not None) + [F.col(a) <= most] * (most is not None)
    if not given and basis is None:
        return []
    return [*given, F.col(b) == (basis or default_basis)]


def with_children(parents: DataFrame, children: dict[str, tuple[DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """Each child table as one sorted array of structs per parent: one grouping per table instead of a query per row."""
    out = parents
    for name, (child, columns) in children.items():
        grouped = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, key, "left")
    return out


def split_by_known(rows: DataFrame, known: DataFrame, canonical: Callable[[Column], Column], column: str = "url") -> DataFrame:
    """``rows`` with boolean ``known``: the canonical form of ``column`` is stored."""
    stored = known.select(canonical(F.col(column)).alias("_key")).where("_key is not null").distinct().withColumn("_hit", F.lit(True))
    return rows.withColumn("_key", canonical(F.col(column))).join(stored, "_key", "left").withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def lookup_with_fallback(rows: DataFrame, entries: DataFrame, canonical: Callable[[Column], Column], key: str, value: str, position: str) -> DataFrame:
    """``value`` by the raw key, else by its canonical form, where the first entry of a canonical key counts."""
    raw = entries.groupBy(key).agg(F.min_by(value, position).alias("_raw"))
    loose = entries.groupBy(canonical(F.col(key)).alias("_c")).agg(F.min_by(value, position).alias("_loose"))
    out = rows.join(raw, key, "left").withColumn("_c", canonical(F.col(key))).join(loose, "_c", "left")
    return out.withColumn(value, F.coalesce("_raw", "_loose")).drop("_c", "_raw", "_loose")


def token_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str) -> DataFrame:
    """Distinct id pairs that share a token; an equi-join on exploded tokens, never a cross join.

    The pairs themselves are the result, so their number is that of the pairs which share a token.
    """
    a = left.select(left_id, F.explode(F.array_distinct(left_tokens)).alias("_t"))
    b = right.select(right_id, F.explode(F.array_distinct(right_tokens)).alias("_t"))
    return a.join(b, "_t").select(left_id, right_id).distinct()


def line_key(line: Column) -> Column:
    """128 bits that stand for a line, so that its text need not be shuffled to find equal ones."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def shared_keys(rows: DataFrame, owner: str, key: str) -> DataFrame:
    """The keys that several owners have; counted with partial aggregation, so a common one is no hot key."""
    ends = rows.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
    return ends.where("_lo < _hi").select(key)


def siblings(rows: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """Other items on the same line of the same page, as a sorted array per item."""
    other = rows.select(*group, F.col(item).alias("_other"))
    pairs = rows.select(*group, item).join(other, [*group]).where(F.col(item) != F.col("_other"))
    return pairs.groupBy(item).agg(F.array_sort(F.collect_set("_other")).alias("siblings"))


def compared(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full comparison of two sets: ``change`` is added, removed or kept."""
    a, b = old.select(*key).distinct().withColumn("_old", F.lit(True)), new.select(*key).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return a.join(b, [*key], "full_outer").withColumn("change", change).drop("_old", "_new")


def in_listed_order(rows: DataFrame, listed: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of the listed keys in list order; a repeated key counts where it stands first."""
    return rows.join(listed.groupBy(key).agg(F.min(position).alias(position)), key).orderBy(position)


def sole_sibling(rows: DataFrame, group: str, name: str, separator: str = " - ") -> DataFrame:
    """A bare name takes on the prefixed form of the only sibling whose last part equals it."""
    squashed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    suffix = squashed(F.element_at(F.split(F.col(name), separator), -1))
    prefixed = rows.where(F.instr(F.col(name), separator) > 0).select(group, suffix.alias("_s"), F.col(name).alias("_full"))
    sole = prefixed.groupBy(group, "_s").agg(F.count_distinct("_full").alias("_n"), F.min("_full").alias("_full")).where("_n = 1").drop("_n")
    bare = F.instr(F.col(name), separator) == 0
    out = rows.withColumn("_s", F.when(bare, squashed(F.col(name)))).join(sole, [group, "_s"], "left")
    return out.withColumn("canonical", F.coalesce("_full", name)).drop("_s", "_full")


def unpivoted(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per non-blank value of ``columns`` with its source column."""
    return rows.unpivot(key, [*columns], "source", "value").where(F.trim(F.coalesce("value", F.lit(""))) != "")


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of ``start``, each at its least depth."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(name, same): both frames have equal schemas and hold the same rows, by their number and the sum of their hashes."""
    def summed(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"{tag}n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias(f"{tag}h"))

    both = summed(a, "a").crossJoin(F.broadcast(summed(b, "b")))
    equal = (F.col("an") == F.col("bn")) & F.col("ah").eqNullSafe(F.col("bh")) & F.lit(a.dtypes == b.dtypes)
    return both.select(F.lit(name).alias("name"), equal.alias("same"))
