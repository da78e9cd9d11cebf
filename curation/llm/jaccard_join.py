"""Jaccard join of word shingle sets, heavy and light sets apart; exact.

1. Each text becomes its set of distinct word-shingle hashes. Texts of equal sets are one class, stood for by its smallest id.
2. Shingles have a global order: by a counter of how common they are, which each shares with others of its hash, then by hash.
   A set's inverted lists are those of its rarest shingles: of two linked sets the larger has one of the shared shingles
   among its rarest n - ceil(p * n) + 1 (where it looks), the smaller among its rarest n - ceil(2p / (1 + p) * n) + 1 (where
   it is found).
3. Light sets, of up to ``boundary`` shingles, need no lists among themselves: two that are linked share a subset of as many
   shingles as their sizes ask for, so all subsets of those fixed sizes are enumerated and equal ones meet. The boundary
   is where the cost is least: rows of subsets against rows of lists and what each row meets there, both counted per size.
   Sets that may be linked with one beyond the boundary stay in the lists.
4. In each list a centre, the set with most mates overall, is compared with all others: candidates in proportion to the rows.
   Links are confirmed on full sets, and components formed.
5. In lists with many members outside the largest component (strangers), these are first compared with PIVOTS members of it,
   which brings in most of a large group of near copies; components are formed anew.
6. In lists that still hold several components, strangers are compared with the members of other components, unless that
   costs far more than splitting the list by a further shingle. Two linked sets share at least l of their rarest
   n - ceil(p * n) + l shingles, so a list may be split by a second and then a third shingle, and unlinked sets that
   share a common shingle no longer meet.
   Before a candidate is confirmed, its sizes must fit, and the parity bitmaps of the two sets must not differ too much;
   where a list has many strangers, both are asked as its members meet, so no other pair leaves the join.
7. Components by alternating stars, as near dedup has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import KeyFilter, measured_broadcasts, small_batches, table, written
from curation.llm.near_dedup import COUNTERS, WordHashes, components, confirmed, labelled, may_link, mixed, parity, same_ids, shingle_sets, summed

#: Largest set that may be light; enumerating subsets of larger ones never pays.
LIGHT_MOST = 16
#: Times a list is split by a further shingle at most, and how many strangers of a list meet the others in any case.
SPLITS, STRANGERS = 2, 32
#: Sets of more shingles also have a parity bitmap of WIDE bits, as that of all sets says little of them.
WIDE_FROM, WIDE = 1000, 1 << 13
#: Members of a list's largest component that many strangers are compared with first.
PIVOTS = 8
#: A list is split where its strangers meet more than so many times the members that splitting makes.
SPLIT_FROM = 64


def ceil_div(a, b):
    return -(-a // b)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Overlaps that a set of ``n`` shingles may need with a linked one of any size; equal sets are one class."""
    partners = [m for m in range(1, n * 100 // percent + 1) if 100 * min(n, m) >= percent * max(n, m)]
    return sorted({ceil_div(percent * (n + m), 100 + percent) for m in partners if (n, m) != (1, 1)})


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def looks(n: Column, percent: int) -> Column:
    """How many of its rarest shingles a set of ``n`` looks at."""
    return (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int")


def found(n: Column, percent: int) -> Column:
    """How many of its rarest shingles a set of ``n`` is found by."""
    return (n - F.ceil(n * (2 * percent) / F.lit(100 + percent)) + 1).cast("int")


def described(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n_shingles, digest of the set (null: empty), its mark; and rows (counter, seen) of each task's counters."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()), ("mark", pa.int64()), ("counter", pa.int64()), ("seen", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), hashes, size)
            if sets:
                seen += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(digest, sets), pa.string()), pa.array(map(mark, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(sets), pa.int64())] * 2], schema=schema)
        often = np.flatnonzero(seen > 1)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(often), f.type) for f in list(schema)[:4]), pa.array(often), pa.array(seen[often])], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, "id long, n_shingles long, digest string, mark long, counter long, seen long")


def digest(s: np.ndarray) -> str | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None


def wide_parity(s: np.ndarray) -> np.ndarray | None:
    """WIDE bits as longs, each shingle flipping one; null for sets of up to WIDE_FROM."""
    if len(s) <= WIDE_FROM:
        return None
    flips = np.bincount((mixed(s) >> np.uint64(64 - WIDE.bit_length() + 1)).astype(np.int64), minlength=WIDE) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def mark(s: np.ndarray) -> int:
    """Tells apart the sets of one id."""
    return int(s.sum(dtype=np.uint64).view(np.int64))


def rarest(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """Of ``docs`` (id, text): id, mark, n, parity bitmaps, rare (the rarest shingles, in order), small (the whole set, where it may be light)."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("bits", "wide", "rare", "small"))])
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order = WordHashes(), shared.value
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), hashes, size)
            rare = []
            for s in sets:
                first = len(s) - ceil_div(percent * len(s), 100) + 1 + SPLITS
                # the set is sorted, so a stable sort by counters leaves equal ones in order of their hashes
                rare.append(s[np.argsort(order[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[:first]].view(np.int64))
            small = [s.view(np.int64) if len(s) <= LIGHT_MOST else None for s in sets]
            columns = [pa.array(map(mark, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (map(parity, sets), map(wide_parity, sets), rare, small))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return docs.mapInArrow(task, "id long, mark long, n long, bits array<long>, wide array<long>, rare array<long>, small array<long>")


def subsets(sets: DataFrame, percent: int) -> DataFrame:
    """Of light ``sets`` (id, n, small): key, id, n of every subset of the sizes that links among them may need."""
    sizes = {n: subset_sizes(n, percent) for n in range(1, LIGHT_MOST + 1)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, s in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.array(sorted(s), np.int64)
                keys = [xxhash.xxh3_64_intdigest(s[list(own)].tobytes(), c) for c in sizes[n] if c <= n for own in combinations(range(n), c)]
                keys = pa.array(np.array(keys, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([keys, pa.array([i] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int64())], names=["key", "id", "n"])

    return sets.select("id", "n", "small").mapInArrow(task, "key long, id long, n long")


def boundary(sets: DataFrame, lists: DataFrame, percent: int) -> int:
    """The size up to which sets are light, at the least cost in rows made and met."""
    # at most LIGHT_MOST rows each
    count = {r["n"]: r["c"] for r in sets.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    met = {r["n"]: r["c"] for r in lists.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.sum("size").alias("c")).collect()}
    prefix = {n: n - ceil_div(percent * n, 100) + 1 for n in range(1, LIGHT_MOST + 1)}

    def cost(at: int) -> int:
        light = sum(c * subset_count(n, percent) for n, c in count.items() if n <= at)
        heavy = sum(c * prefix[n] + met.get(n, 0) for n, c in count.items() if 100 * n >= percent * (at + 1))
        return light + heavy

    return min(range(LIGHT_MOST + 1), key=cost)


def paired(left: DataFrame, right: DataFrame, percent: int, bits: bool = False) -> DataFrame:
    """Pairs (a, b) of unlike components from ``left`` and ``right`` (key, id, n, component, found) whose sizes fit and whose smaller set is found by the key.

    With ``bits`` both have that column, and it must not rule the pair out.
    """
    names = {"key": "_key", "id": "a", "n": "na", "component": "ca", "found": "fa"} | ({"bits": "bits_a"} if bits else {})
    one = left.select(*(F.col(c).alias(own) for c, own in names.items()))
    fits = may_link(F.col("na"), F.col("bits_a"), F.col("n"), F.col("bits"), percent) if bits else 100 * F.least("na", "n") >= percent * F.greatest("na", "n")
    seen = F.when(F.col("na") < F.col("n"), F.col("fa")).when(F.col("na") > F.col("n"), F.col("found")).otherwise(F.col("fa") & F.col("found"))
    pairs = right.join(one, (F.col("key") == F.col("_key")) & (F.col("ca") != F.col("component")) & seen & fits)
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))


def placed_in(members: DataFrame, found_: DataFrame) -> DataFrame:
    """``members`` with the component of each."""
    return members.join(found_, "id", "left").withColumn("component", F.coalesce("component", "id"))


def mixed_lists(placed: DataFrame, percent: int) -> DataFrame:
    """Per key with several components: the largest (main), strangers, all, looked (rows that splitting it would make)."""
    looked = F.col("n") * (100 - percent) / 100 + 1
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum(looked).alias("looked"))
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), F.sum("looked").alias("looked"), F.max(F.struct("size", "component")).alias("top")).where("parts > 1")
    return several.select("key", F.col("top.component").alias("main"), (F.col("all") - F.col("top.size")).alias("strangers"), "all", "looked")


def with_pivots(members: DataFrame, found_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): the strangers of lists that have many of them with PIVOTS members of the list's largest component."""
    placed = placed_in(members, found_)
    lists = mixed_lists(placed, percent).where(F.col("strangers") > STRANGERS).select("key", "main")
    crowded = written(placed.join(lists, "key"))
    own = crowded.where("component = main").groupBy("key")
    least = own.agg(*(F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), F.col("id").alias("a"), F.col("n").alias("na"))).alias(f"p{j}") for j in range(PIVOTS)))
    pivots = written(least.select("key", F.explode(F.array_distinct(F.array(*(F.struct(f"p{j}.a", f"p{j}.na") for j in range(PIVOTS))))).alias("p")).select("key", "p.*"))
    pairs = crowded.where("component <> main").join(pivots, "key").where(100 * F.least("na", "n") >= percent * F.greatest("na", "n"))
    return pairs.select("a", F.col("id").alias("b")).distinct()


def plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that sizes and bitmaps in ``facts`` (id, n, bits, wide) don't rule out."""
    first = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"), F.col("wide").alias("wide_a"))
    second = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"), F.col("wide").alias("wide_b"))
    differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    alike = F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")), F.lit(True))
    fits = may_link(F.col("na"), F.col("bits_a"), F.col("nb"), F.col("bits_b"), percent) & alike
    return pairs.join(first, "a").join(second, "b").where(fits).select("a", "b").distinct()


def between_components(members: DataFrame, rare: DataFrame, facts: DataFrame, found_: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of list mates of unlike components, but for those that were ``tried``.

    ``members``: key, id, n, at (place of the list's last shingle in the set's order), found; ``rare``: id, n, rare;
    ``facts``: id, n, bits.
    """
    columns = ["key", "id", "n", "at", "found", "component"]
    placed = placed_in(members, found_).select(columns)
    pairs, splits = [], 0
    while True:
        few = F.col("strangers") <= STRANGERS
        direct = few | (F.col("strangers") * F.col("all") <= SPLIT_FROM * F.col("looked"))
        lists = written(mixed_lists(placed, percent).select("key", "main", few.alias("few"), (direct if splits < SPLITS else F.lit(True)).alias("direct")))
        unsettled = written(placed.join(lists, "key"))
        here = unsettled.where("few")
        pairs.append(paired(here.where("component <> main"), here, percent).where("a <> b"))
        many = unsettled.where("direct and not few")
        if not many.isEmpty():
            many = written(many.join(facts.select("id", "bits"), "id"))
            pairs.append(paired(many.where("component <> main"), many, percent, bits=True).where("a <> b"))
        crowded = unsettled.where("not direct")
        if splits == SPLITS or crowded.isEmpty():
            break
        splits += 1
        further = crowded.select(*columns).join(rare.select("id", "rare"), "id")
        last = F.least(F.size("rare"), looks(F.col("n"), percent) + splits)
        next_ = F.explode(F.sequence(F.col("at") + 1, last - 1)).alias("next")
        split = further.where(F.col("at") + 1 < last).select("key", "id", "n", "component", "rare", next_)
        placed = split.select(F.xxhash64("key", F.element_at("rare", F.col("next") + 1)).alias("key"), "id", "n", F.col("next").alias("at"), F.lit(True).alias("found"), "component")
    union = pairs[0]
    for more in pairs[1:]:
        union = union.union(more)
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return union.distinct().join(known, ["a", "b"], "left_anti")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, percent: int = 80, costs: dict | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Null and wordless texts have an empty set and are linked with nothing. Rows that repeat an id are one node, linked
    with whatever any of their texts is linked with. A row without an id is a component of its own if nothing equals
    it. An empty table gives no rows; other columns are not read. ``costs`` takes the boundary that was chosen.
    """
    with measured_broadcasts(docs.sparkSession):
        return _joined(docs, id_col, text_col, shingle_words, percent, costs)


def _joined(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, costs: dict | None) -> DataFrame:
    source = (docs, id_col, text_col, shingle_words, percent)
    both = written(described(docs, id_col, text_col, shingle_words))
    counts = summed(both.where("counter is not null"), "counter", "seen")
    sig = both.where("counter is null").select("id", "n_shingles", "digest", "mark")
    total = sig.count()
    classes = sig.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    nodes = sig.join(classes.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep")), "left_semi").drop("digest")
    nodes = written(nodes.dropDuplicates(["id", "mark"]))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = KeyFilter(nodes.select("id"), ["id"], total).marked(texts, ["id"], "_wanted").where("_wanted").select("id", "text")
    sets = rarest(wanted, counts, shingle_words, percent).join(nodes.select("id", "mark"), ["id", "mark"], "left_semi")
    sets = written(sets.dropDuplicates(["id", "mark"]).drop("mark"))
    facts = sets.select("id", "n", "bits", "wide")

    listed = sets.select("id", "n", F.posexplode(F.slice("rare", F.lit(1), looks(F.col("n"), percent))).alias("at", "key"))
    listed = listed.select("key", "id", "n", "at", (F.col("at") < found(F.col("n"), percent)).alias("found"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("found").alias("any")).where("size > 1 and any").select("key", "size")
    lists = written(listed.join(sizes, "key"))

    at = boundary(sets, lists, percent)
    if costs is not None:
        costs["boundary"] = at
    enumerated = subsets(sets.where(F.col("n") <= at), percent).distinct()
    shared = enumerated.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    light = enumerated.join(shared, "key").select("key", "id", "n", F.lit(-1).alias("at"), F.lit(True).alias("found"), "size")
    heavy = lists.where(100 * F.col("n") >= percent * (at + 1)).select("key", "id", "n", "at", "found", "size")
    members = written(heavy.unionByName(light))

    degrees = members.groupBy("id").agg(F.sum("size").alias("degree"))
    top = F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n")).alias("top")
    centres = written(members.join(degrees, "id").groupBy("key").agg(top).select("key", (-F.col("top.minus")).alias("a"), F.col("top.n").alias("na")))
    stars = members.join(centres, "key").where((F.col("id") != F.col("a")) & (100 * F.least("na", "n") >= percent * F.greatest("na", "n")))
    first = written(plausible(stars.select("a", F.col("id").alias("b")).distinct(), facts, percent))
    links = written(confirmed(first, *source, total).unionByName(same_ids(sig, classes)))
    linked = components(links)

    members = members.drop("size")
    pivots = written(plausible(with_pivots(members, linked, percent), facts, percent))
    if not pivots.isEmpty():
        links = written(links.union(confirmed(pivots, *source, total)))
        linked = components(links)
    tried = first.union(pivots)
    rest = written(plausible(between_components(members, sets, facts, linked, tried, percent), facts, percent))
    if not rest.isEmpty():
        linked = components(links.union(confirmed(rest, *source, total)))
    return labelled(sig, classes, linked, id_col).select(id_col, "n_shingles", "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs)
