"""Near duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

1. Each text becomes its set of distinct word-shingle hashes. Texts of equal sets are one class, stood for by its
   smallest id; only these go on, so exact copies never multiply anything.
2. A set of more than SHORT_FROM shingles is hashed once into ROWS * BANDS bins; each empty bin borrows from a bin that a fixed
   random sequence reaches first (optimal densification). Each band of bins is a bucket key. Sets of up to SHORT_TO
   shingles get keys by pigeonhole: dealt to d + 1 groups, two sets that differ in at most d elements have an equal
   group, and d follows from the size and the threshold. Empty groups give no key, so the sets of a level are dealt
   as often as it takes for the chance that all equal groups are empty to be below MISS. The two ranges overlap so that any two sets that may be linked share one kind of key.
3. In each bucket a centre, the member with the most bucket mates overall, is compared with every other member: at most
   as many candidate edges as members. Links are confirmed on full sets, and components formed.
4. Only in buckets that still hold several components, the members outside the largest of them are strangers there. Up to
   STRANGERS of them are further centres, for members of other components: rows in proportion to the members. The
   members of a bucket with more go to an exact prefix filter instead: linked sets share one of their rarest
   n - ceil(p * n) + 1 shingles, and only shingles that stand in several components are joined. So no pair of bucket mates
   that could join two components is left out, and unlinked members of a hot bucket don't meet in pairs.
   In all, a candidate edge must first pass two tests that no linked pair fails: the sizes fit, and the parity bitmaps
   of the two sets (each shingle flips one of BITS bits) differ in no more bits than the sets may differ in shingles.
5. Components by alternating large and small stars.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import KeyFilter, small_batches, table, written

#: Bins of a signature at most, and the chance of no common key that bands and deals are chosen for, at the threshold.
BINS, MISS = 200, 3e-7
ROWS, BANDS = 6, 32
SHORT_FROM, SHORT_TO = 64, 128
#: Members of a star that one group of the confirming pass compares with their centre.
STAR_PART = 32
#: Members outside a bucket's largest component that are compared with its other members one by one.
STRANGERS = 32
#: Counters of shingles that order them by how common they are.
COUNTERS = 1 << 17
#: Bits of the parity bitmap.
BITS = 1024
CACHE_WORDS = 100_000
#: Words of the texts that are hashed at once.
RUN_WORDS = 1 << 15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept in a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    h = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)])
    return h


def shingle_sets(texts: Iterable[bytes | None], hashes: WordHashes, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct hashes of runs of ``size`` words, in ASCII lower case; fewer words are one shingle.

    Runs are hashed for many texts at once, which are laid end to end; those that cross an end are left out.
    """
    out: list[np.ndarray] = []
    waiting: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        h = run_hashes(np.concatenate(waiting), size)
        at = 0
        for words in waiting:
            own = h[at : at + len(words) - size + 1] if len(words) >= size else run_hashes(words, len(words)) if len(words) else words
            out.append(np.unique(own))
            at += len(words)

    for text in texts:
        words = hashes.of((text or b"").lower().split())
        waiting.append(words)
        held += len(words)
        if held >= RUN_WORDS:
            settle()
            waiting, held = [], 0
    if waiting:
        settle()
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """BITS bits as longs, each shingle flipping one; two bitmaps differ in at most as many bits as the sets in shingles."""
    flips = np.bincount((mixed(s) >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def may_link(na: Column, bits_a: Column, nb: Column, bits_b: Column, percent: int) -> Column:
    """False only for sets that are surely less alike than ``percent``."""
    differ = reduce(add, (F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(BITS // 64)))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * differ <= (100 - percent) * (na + nb))


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands: the most rows with which so many bands as MISS needs at the threshold fit into BINS."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if rows * bands <= BINS:
            return rows, bands
    raise ValueError(f"no bands for {percent} %")


def deal_miss(percent: int, low: int, high: int) -> float:
    """The largest chance that one deal gives two linked sets, the larger of over ``low`` to ``high`` shingles, no common key."""
    g = 2 * high * (100 - percent) // (100 + percent) + 1
    # chance of m occupied groups after so many throws
    occupied = [np.eye(1, g + 1)[0]]
    for _ in range(g - 1):
        last, m = occupied[-1], np.arange(g + 1)
        occupied.append(last * m / g + np.concatenate([[0], (last * (g - m) / g)[:-1]]))
    worst = 0.0
    for total in range(low + 1 + -(-percent * (low + 1) // 100), 2 * high + 1):
        shared = -(-percent * total // (100 + percent))
        worst = max(worst, float(occupied[total - 2 * shared] @ (np.arange(g + 1) / g) ** shared))
    return worst


@lru_cache
def deals(percent: int, low: int, high: int) -> int:
    miss = deal_miss(percent, low, high)
    return max(1, math.ceil(math.log(MISS) / math.log(miss))) if miss > 0 else 1


class Keys:
    """Bucket keys of a shingle set."""

    def __init__(self, percent: int, rows: int, bands: int):
        self.percent, self.rows, self.bands, self.bins = percent, rows, bands, rows * bands
        draw = np.random.default_rng(20240917)
        self.detours = draw.integers(0, self.bins, (self.bins, 256))
        self.salts = draw.integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
        # sizes up to levels[i] are of level i; linked sets are of the same level or of adjacent ones
        self.levels = [1]
        while self.levels[-1] < 2 * SHORT_TO:
            self.levels.append(max(self.levels[-1] + 1, self.levels[-1] * 100 // percent))
        self.deals = [deals(percent, low, high) for low, high in zip([0, *self.levels], self.levels)]

    def of(self, s: np.ndarray) -> np.ndarray:
        found = []
        if 0 < len(s) <= SHORT_TO:
            level = int(np.searchsorted(self.levels, len(s)))
            found += [self.groups(s, at, deal) for at in (level, level + 1) for deal in range(self.deals[at])]
        if len(s) > SHORT_FROM:
            found.append(self.banded(s))
        return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)

    def groups(self, s: np.ndarray, level: int, deal: int) -> np.ndarray:
        # |A| + |B| = union + intersection and union - intersection <= (1 - p) * union bound the elements that differ
        p = self.percent
        differ = 2 * self.levels[level] * (100 - p) // (100 + p)
        g = differ + 1
        m = mixed(s ^ self.salts[10_000 + level + 500 * deal])
        at = (m >> np.uint64(33)) % np.uint64(g)
        order = np.argsort(at, kind="stable")
        full, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(mixed(m)[order], first)
        return mixed(sums ^ self.salts[2000 + ((deal * 64 + level) * 311 + full.astype(np.int64)) % 60_000])

    def signature(self, s: np.ndarray) -> np.ndarray:
        sig = np.full(self.bins, _NONE, np.uint64)
        np.minimum.at(sig, ((s >> np.uint64(32)) % np.uint64(self.bins)).astype(np.int64), mixed(s))
        empty = np.flatnonzero(sig == _NONE)
        if len(empty):
            filled = sig != _NONE
            reached = filled[self.detours[empty]]
            source = self.detours[empty, np.argmax(reached, axis=1)]
            none = ~reached.any(axis=1)
            source[none] = np.flatnonzero(filled)[0]
            sig[empty] = sig[source]
        return sig

    def banded(self, s: np.ndarray) -> np.ndarray:
        sig = self.signature(s).reshape(self.bands, self.rows)
        key = self.salts[1500 + np.arange(self.bands)].copy()
        for j in range(self.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
        return key


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, rows: int, bands: int) -> DataFrame:
    """id, n_shingles, digest of the shingle set (null: empty set), a short form of it that tells apart the sets of one id, parity
    bitmap, bucket keys."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()), ("mark", pa.int64()), ("bits", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys = WordHashes(), Keys(percent, rows, bands)
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), hashes, size)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            mark = [int(d[:15], 16) if d else 0 for d in digests]
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.string()), pa.array(mark, pa.int64()), *(pa.array(map(f, sets), pa.list_(pa.int64())) for f in (parity, keys.of))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, "id long, n_shingles long, digest string, mark long, bits array<long>, keys array<long>")


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, total: int) -> DataFrame:
    """id and text of the rows that may be among ``ids``; those of other rows are not shuffled by what follows."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return KeyFilter(ids, ["id"], total).marked(texts, ["id"], "_wanted").where("_wanted").drop("_wanted")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, total: int) -> DataFrame:
    """Of ``pairs`` (a: centre, b) those whose whole shingle sets are alike enough.

    Large stars are cut in parts, each with its own copy of the centre's text, and a part is streamed: its centre's
    set is the only thing that is held.
    """
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, id_col, text_col, total)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    members = pairs.join(parts, "a").select("a", part.cast("int").alias("part"), F.col("b").alias("id"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    rows = members.unionByName(centres).join(texts, "id")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, star, held = WordHashes(), None, []
        for batch in batches:
            links = []
            ids, stars, parts_, texts_ = (batch.column(n) for n in ("id", "a", "part", "text"))
            sets = shingle_sets(texts_.cast(pa.binary()).to_pylist(), hashes, size)
            for i, a, k, s in zip(ids.to_pylist(), stars.to_pylist(), parts_.to_pylist(), sets):
                if star != (a, k):
                    star, held = (a, k), []
                if i == a:
                    if not any(np.array_equal(s, c) for c in held):
                        held.append(s)
                    continue
                for centre in held:
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(s) - both):
                        links.append((a, i))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return dealt.select("id", "a", "part", "text").mapInArrow(task, "a long, b long").distinct()


def summed(rows: DataFrame, counter: str, seen: str) -> np.ndarray:
    """Per counter the sum of ``seen``; at most COUNTERS rows, which reach the driver as Arrow columns and not as objects."""
    sums = rows.groupBy(counter).agg(F.sum(seen)).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return counts


def rare_shingles(open_: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, total: int) -> DataFrame:
    """Per set of the ids of ``open_`` (id, component): its rarest shingles, of which it shares one with any set it is linked with.

    id, component, n_shingles, bits, shingle; only shingles that stand in several components are left. Any one order of
    all shingles will do: they are ordered by a counter that each shares with others of its hash, then by hash.
    """
    schema = pa.schema([("id", pa.int64()), ("component", pa.int64()), ("n_shingles", pa.int64()), ("bits", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), hashes, size)
            columns = [batch.column("id"), batch.column("component"), pa.array(map(len, sets), pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (map(parity, sets), (x.view(np.int64) for x in sets)))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counters that were met twice or more; the others say nothing of what is common."""
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        often = np.flatnonzero(found > 1)
        yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.array(found[often], pa.int64())], names=["c", "n"])

    texts = open_.join(texts_of(open_.select("id"), docs, id_col, text_col, total), "id").select("id", "component", "text")
    sets = written(texts.mapInArrow(task, "id long, component long, n_shingles long, bits array<long>, shingles array<long>"))
    counts = summed(sets.select("shingles").mapInArrow(counted, "c long, n long"), "c", "n")
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = []
            for x in batch.column("shingles"):
                s = x.values.to_numpy()
                n = len(s) - -(-percent * len(s) // 100) + 1
                first.append(s[np.lexsort((s, shared.value[s & (COUNTERS - 1)]))[:n]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first, pa.list_(pa.int64()))], schema=schema)

    rows = written(sets.mapInArrow(prefixes, "id long, component long, n_shingles long, bits array<long>, shingles array<long>")).withColumn("shingle", F.explode("shingles")).drop("shingles")
    several = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    return rows.join(several, "shingle", "left_semi").distinct()


def across(rows: DataFrame, others: DataFrame, key: str, percent: int, once: Column) -> DataFrame:
    """Pairs (a, b) of unlike components from ``rows`` and ``others`` (id, component, n_shingles, bits, key) that may be linked."""
    left = rows.select(F.col(key).alias("_key"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a"))
    fits = may_link(F.col("na"), F.col("bits_a"), F.col("n_shingles"), F.col("bits"), percent) & (F.col("ca") != F.col("component"))
    return others.join(left, (F.col(key) == F.col("_key")) & fits & once).select("a", F.col("id").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches over ``links`` (a, b).

    Alternates large stars (bind greater neighbours to the least one) and small stars (bind the others too) until
    nothing changes; each round is written to shared storage.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = least(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return leaves.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, percent: int = 80, rows: int | None = None, bands: int | None = None
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest linked id, itself included), kept (it is that id).

    Null and wordless texts have an empty set and are linked with nothing. Rows that repeat an id are one node, linked
    with whatever any of their texts is linked with. A row without an id is a component of its own if nothing equals
    it. An empty table gives no rows; other columns are not read.
    """
    if rows is None or bands is None:
        rows, bands = banding(percent)
    source = (docs, id_col, text_col, shingle_words, percent)
    sig = written(signatures(*source, rows, bands))
    total = sig.count()
    classes = sig.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    nodes = sig.join(classes.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep")), "left_semi")
    keyed = nodes.select("id", "mark", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    mates = written(keyed.join(buckets, "key"))
    degrees = mates.groupBy("id").agg(F.sum("size").alias("degree"))
    facts = nodes.dropDuplicates(["id", "mark"]).select("id", "mark", "n_shingles", "bits")
    members = written(mates.join(degrees, "id").join(facts, ["id", "mark"]).drop("size", "mark"))
    centres = written(members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n_shingles", "bits")).alias("top")).withColumnRenamed("key", "_key"))
    near = may_link(F.col("n_shingles"), F.col("bits"), F.col("top.n_shingles"), F.col("top.bits"), percent) & (F.col("id") != -F.col("top.minus"))
    stars = members.join(centres, (F.col("key") == F.col("_key")) & near)
    first = written(stars.select((-F.col("top.minus")).alias("a"), F.col("id").alias("b")).distinct())
    links = written(confirmed(first, *source, total).unionByName(same_ids(sig, classes)))
    found = components(links)

    rest = written(_between_components(members, found, first, source, total))
    if not rest.isEmpty():
        found = components(links.union(confirmed(rest, *source, total)))
    return labelled(sig, classes, found, id_col)


def labelled(sig: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Every row of ``sig`` with the component of its class, from those of linked classes (``found``)."""
    named = written(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")))
    lone = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    # the classes are written before the join, so Spark may split that of a text that very many rows have
    out = sig.select("id", "n_shingles", F.coalesce("digest", lone).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def same_ids(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that several sets share; mostly none."""
    several = sig.where("digest is not null and id is not null").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("id", "low")
    texts = sig.where("digest is not null").select("id", "digest").join(several, "id").where("digest <> low").select("digest", "low").distinct()
    ends = texts.join(classes, "digest").select(F.col("rep").alias("a"), F.col("low").alias("digest")).join(classes, "digest")
    return ends.select("a", F.col("rep").alias("b")).where("a <> b")


def _between_components(members: DataFrame, found: DataFrame, tried: DataFrame, source: tuple, total: int) -> DataFrame:
    """Candidate edges (a, b) between bucket mates of unlike components, but for those that were ``tried``."""
    percent = source[4]
    placed = members.join(found, "id", "left").select("key", "id", "n_shingles", "bits", F.coalesce("component", "id").alias("component"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    several = written(several.select("key", F.col("top.component").alias("main"), (F.col("all") - F.col("top.n")).alias("strangers")))
    unsettled = written(placed.join(several, "key"))
    few, many = unsettled.where(F.col("strangers") <= STRANGERS), unsettled.where(F.col("strangers") > STRANGERS)
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("id"))
    pairs = across(few.where("component <> main"), few, "key", percent, once)
    if not many.isEmpty():
        rare = written(rare_shingles(many.select("id", "component").distinct(), *source, total))
        pairs = pairs.unionByName(across(rare, rare, "shingle", percent, F.col("a") < F.col("id")))
    known = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).dropDuplicates(["x", "y"])
    return pairs.join(known, ["x", "y"], "left_anti").select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns; texts are shuffled only where a row may have to go."""
    verdicts = written(near_duplicates(docs, id_col, text_col, **options))
    gone = verdicts.where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_own"), F.col(id_col).cast("long").alias("_id"))
    flagged = KeyFilter(gone.select(F.col("_gone").alias("_id")), ["_id"], verdicts.count()).marked(rows, ["_id"], "_maybe")
    left = flagged.where("_maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return flagged.where("not _maybe").select("_own.*").unionByName(left.select("_own.*"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle_words=3, percent=85)


def links_sql(size: int, percent: int) -> str:
    """DuckDB's answer: shingles as texts, all pairs that share one, and what is reached over links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= {size} THEN list_distinct(list_transform(range(1, len(ws) - {size} + 2), lambda i: array_to_string(ws[i:i + {size - 1}], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)"""
