"""Audit of how sources diverge from each other and from their language, by a recount over minimal perfect hashes.

1. The exact filter: tasks count in how many documents each term of a language stands, in tables that they hand on when full;
   the sums decide which terms are kept.
2. The kept terms of a language are dealt by hash to shards of about SHARD_TERMS. For each, a task builds a minimal perfect
   hash (levels of bits: a term alone on its bit rests there, those that collide go to the next level; a term's slot is the rank
   of its bit) and stores the terms themselves in slot order.
3. The recount: shards are broadcast, and every document's terms looked up: slot first, then the stored term must be equal, as
   a perfect hash gives any unknown term a slot too. Occurrences fill dense slots per group (language and source).
   One broadcast holds PASS_BYTES of shards; where there are more, the documents are read once for every PASS_BYTES of them.
4. Shares of a group's terms are compared in blocks of slots and tiles of sources: what a task holds is bounded, and every
   kept term takes part, also those that neither source has.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from curation.llm.common import small_batches, table, written

#: Documents a kept term stands in at least, and ranks of the part ``term``.
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
#: What is added to every count, and what a share of 1 is.
SMOOTHING, WHOLE = 5, 1_000_000_000
#: Terms of a shard on average; bytes of the shards of one broadcast.
SHARD_TERMS, PASS_BYTES = 1 << 16, 64 << 20
#: Entries and bytes at which a task hands on its table of terms; bytes of slots at which it hands on its counts.
TABLE_TERMS, TABLE_BYTES, SLOT_BYTES = 400_000, 64 << 20, 128 << 20
#: Slots of a block (a power of two) and sources of a tile.
BLOCK_BITS, TILE = 12, 64
#: Slots are numbered within their shard, which is in the bits above.
SHARD_BITS = 32

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Byte -> lower-case letter, itself (beyond ASCII), or a space.
_FOLD = bytes(b if b in _LETTERS else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of ``keys`` (distinct), which also holds them in slot order."""

    LEVELS, BITS_PER_KEY = 40, 2

    def __init__(self, keys: list[bytes]):
        self.seed = 0
        while not self._build(keys):
            self.seed += 1
        ordered: list = [b""] * len(keys)
        for key, slot in zip(keys, self._places(keys).tolist()):
            ordered[slot] = key
        self.blob = b"".join(ordered)
        self.ends = np.cumsum([0, *map(len, ordered)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def _build(self, keys: list[bytes]) -> bool:
        left = np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        self.levels, rank = [], 0
        while len(left) and len(self.levels) < self.LEVELS:
            words = max(1, -(-self.BITS_PER_KEY * len(left) // 64))
            place = (mixed(left + np.uint64(len(self.levels))) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            self.levels.append((bits, rank + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])))
            rank = int(self.levels[-1][1][-1])
            left = left[~alone[place]]
        return not len(left)

    def _places(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, if it is one of those the hash was built for, else any slot or -1."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            place = mixed(h[left] + np.uint64(level)) % np.uint64(64 * len(bits))
            at, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            word = bits[at]
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (ranks[at] + below)[hit]
            left = left[~hit]
        return out

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; -1 where the key that is stored there is another one."""
        out = self._places(keys)
        start, end = self.ends[out], self.ends[out + 1]
        out[(out >= 0) & (end - start != np.fromiter(map(len, keys), np.int64, len(keys)))] = -1
        for i in np.flatnonzero(out >= 0).tolist():
            if self.blob[start[i] : end[i]] != keys[i]:
                out[i] = -1
        return out


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term (UTF-8), n: documents of the language that have the term; parts, to be summed."""

    def handed_on(counts: dict) -> pa.RecordBatch:
        parts = [(pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64())) for lang, terms in counts.items()]
        columns = [pa.concat_arrays(c) for c in zip(*parts)] or [pa.nulls(0, t) for t in (pa.string(), pa.binary(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                counts.setdefault(lang, Counter()).update(set(terms_of(text)))
                size += len(text)
            if sum(map(len, counts.values())) > TABLE_TERMS or size > TABLE_BYTES:
                yield handed_on(counts)
                counts, size = {}, 0
        yield handed_on(counts)

    return docs.mapInArrow(task, "lang string, term binary, n long")


def sharded(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Of ``kept`` (lang, term): per shard one row with its perfect hash (hash, n terms), and one per term (term, slot)."""
    shards = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_terms).cast("long").alias("shards"))
    dealt = kept.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("term", pa.binary()), ("slot", pa.int64()), ("shards", pa.int64()), ("n", pa.int64()), ("hash", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        terms, (lang, shard, shards) = group.column("term").to_pylist(), (group.column(c)[0].as_py() for c in ("lang", "shard", "shards"))
        perfect = PerfectHash(terms)
        slots = [shard << SHARD_BITS | s for s in perfect.slots(terms).tolist()]
        n = len(terms)
        columns = [[lang] * (n + 1), [shard] * (n + 1), [*terms, None], [*slots, None], [None] * n + [shards], [None] * n + [n], [None] * n + [pickle.dumps(perfect)]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return dealt.select("lang", "shard", "shards", "term").groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, term binary, slot long, shards long, n long, hash binary")


class Slots:
    """The occurrences of a group: a dense array of slots, and what is not yet added to it."""

    def __init__(self) -> None:
        self.waiting, self.dense = [], None

    def add(self, slots: np.ndarray) -> int:
        """How many bytes more are held."""
        self.waiting.append(slots)
        return slots.nbytes

    def settle(self, size: int) -> int:
        """Adds what waits to the dense slots once it is as large as they are."""
        waits = sum(w.nbytes for w in self.waiting)
        if waits < 8 * size:
            return 0
        more = np.bincount(np.concatenate(self.waiting), minlength=size)
        self.waiting, new = [], self.dense is None
        self.dense = more if new else self.dense + more
        return (self.dense.nbytes if new else 0) - waits

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        slots = np.concatenate([np.empty(0, np.int64), *self.waiting])
        own, n = np.unique(slots, return_counts=True)
        if self.dense is None:
            return own, n
        self.dense[own] += n
        own = np.flatnonzero(self.dense)
        return own, self.dense[own]


def recount(docs: DataFrame, shards: dict) -> DataFrame:
    """lang, source, slot, n: occurrences of the terms in ``shards`` ({lang: (shards in all, {shard: perfect hash})}); parts, to be summed."""
    shared = docs.sparkSession.sparkContext.broadcast(shards)

    class Known(dict):
        """term -> slot among the shards of this pass of a language, -1 for others; emptied when full."""

        def __init__(self, lang: str):
            self.all, self.own = shared.value[lang]
            sizes = {s: len(h) for s, h in sorted(self.own.items())}
            self.base = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
            self.size = sum(sizes.values())
            self.number = np.concatenate([np.arange(n) + (s << SHARD_BITS) for s, n in sizes.items()])

        def learn(self, terms: set[bytes]) -> None:
            new = [t for t in terms if t not in self]
            if len(self) + len(new) > TABLE_TERMS:
                self.clear()
                new = list(terms)
            # the hash that dealt the terms to shards, as a signed 64-bit number
            dealt = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in new), np.uint64, len(new)).view(np.int64) % self.all
            self.update(dict.fromkeys(new, -1))
            for shard, perfect in self.own.items():
                own = [new[i] for i in np.flatnonzero(dealt == shard).tolist()]
                slots = perfect.slots(own)
                self.update((own[i], self.base[shard] + int(slots[i])) for i in np.flatnonzero(slots >= 0).tolist())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, groups, held = {}, {}, 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in groups.items():
                slots, n = own.counts()
                names = [pa.repeat(pa.scalar(x, pa.string()), len(slots)) for x in (lang, source)]
                columns = [*names, pa.array(known[lang].number[slots]), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "slot", "n"])

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist())
            rows = [(lang, source, terms_of(text)) for lang, source, text in rows if lang in shared.value]
            for lang in {r[0] for r in rows}:
                if lang not in known:
                    known[lang] = Known(lang)
                known[lang].learn(set().union(*(terms for own, _, terms in rows if own == lang)))
            for lang, source, terms in rows:
                slots = np.fromiter(map(known[lang].__getitem__, terms), np.int64, len(terms))
                own = groups.setdefault((lang, source), Slots())
                held += own.add(slots[slots >= 0])
                held += own.settle(known[lang].size)
            if held > SLOT_BYTES:
                yield from handed_on()
                groups, held = {}, 0
        yield from handed_on()

    return docs.mapInArrow(task, "lang string, source string, slot long, n long")


def passes(index: DataFrame, pass_bytes: int) -> Iterator[dict]:
    """The shards of ``index``, as many at a time as have ``pass_bytes``, or a single one."""
    sizes = index.select("lang", "shard", F.length("hash").alias("bytes")).orderBy("lang", "shard")
    ranges, held = [], 0
    # one small row per SHARD_TERMS terms
    for r in sizes.collect():
        if not ranges or held + r["bytes"] > pass_bytes:
            ranges.append([])
            held = 0
        ranges[-1].append((r["lang"], r["shard"]))
        held += r["bytes"]
    for own in ranges:
        (lang, shard), (last, last_shard) = own[0], own[-1]
        from_ = (F.col("lang") > lang) | ((F.col("lang") == lang) & (F.col("shard") >= shard))
        to = (F.col("lang") < last) | ((F.col("lang") == last) & (F.col("shard") <= last_shard))
        shards: dict = {}
        for r in index.where(from_ & to).collect():
            shards.setdefault(r["lang"], (r["shards"], {}))[1][r["shard"]] = pickle.loads(r["hash"])
        yield shards


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(WHOLE * (n + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    return F.expr(f"1 + (cast({WHOLE} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(19,0))) div cast({total} + {SMOOTHING} * {terms} as decimal(19,0))")


def distances(counts: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item, value: for two sources of a language that has terms, the sum of their shares' differences over all its terms."""
    block = F.shiftright("slot", BLOCK_BITS).alias("block")
    blocks = terms.groupBy("lang", block).agg(F.count(F.lit(1)).alias("size"))
    place = F.col("slot").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    own = counts.join(groups, ["lang", "source"]).select("lang", "source", block, F.struct(place.alias("at"), share("n", "total", "terms").alias("p")).alias("x"))
    vectors = own.groupBy("lang", "source", "block").agg(F.collect_list("x").alias("x"))
    all_ = groups.where("terms > 0").withColumn("none", share("0", "total", "terms")).join(blocks, "lang").join(vectors, ["lang", "source", "block"], "left")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    tiled = all_.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = tiled.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "source", "tile", "size", "none", F.col("x.at").alias("at"), F.col("x.p").alias("p"))

    def compared(group: pa.Table) -> pa.Table:
        n, size = group.num_rows, group.column("size")[0].as_py()
        shares = np.repeat(group.column("none").to_numpy()[:, None], size, axis=1)
        for row, (at, p) in enumerate(zip(group.column("at").combine_chunks(), group.column("p").combine_chunks())):
            if at.is_valid:
                shares[row, at.values.to_numpy()] = p.values.to_numpy()
        tile, names = group.column("tile").to_numpy(), group.column("source").combine_chunks()
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        source, item, value = [], [], []
        for a in range(n):
            others = np.flatnonzero(tile != tile[a] if across else np.arange(n) != a)
            source += [a] * len(others)
            item += others.tolist()
            value += np.abs(shares[others] - shares[a]).sum(axis=1).tolist()
        lang = pa.array([group.column("lang")[0].as_py()] * len(source), pa.string())
        return pa.Table.from_arrays([lang, names.take(pa.array(source, pa.int64())), names.take(pa.array(item, pa.int64())), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    parts = dealt.groupBy("lang", "block", "i", "j").applyInArrow(compared, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and which terms it has too many of.

    Null text, language and source are empty strings, groups like any other; rows that repeat an id are documents each
    for themselves (ids are not read). Groups without kept terms have value 0 in part ``pair`` and no rows in part
    ``term``; ties go by the item's UTF-8 order. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(document_frequencies(rows).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    index = written(sharded(kept, shard_terms))
    terms = index.where("term is not null").select("lang", "slot", F.col("term").cast("string").alias("term"))
    spark = docs.sparkSession
    counts = spark.createDataFrame([], "lang string, source string, slot long, n long")
    for shards in passes(index.where("hash is not null"), pass_bytes):
        counts = counts.unionByName(written(recount(rows, shards).groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))))

    group = rows.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = group.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    named = group.join(sources, "lang").join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = written(named.select("lang", "source", "tiles", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")))

    found = distances(counts, groups, terms)
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(found, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    langs = counts.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n")).join(terms, ["lang", "slot"]).join(whole, "lang")
    shares = counts.where("n > 0").join(langs, ["lang", "slot"]).join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms")).withColumn("q", share("lang_n", "lang_total", "terms"))
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, over)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tok AS MATERIALIZED (SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM found),
kept AS MATERIALIZED (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM tok) GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
dense AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
