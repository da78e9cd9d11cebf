"""Removal of repeated passages by suffix automata of reference shards.

A window is ``window`` consecutive words. A word goes if a window that covers it also starts in a document of smaller
id. The reference of a window is the smallest id that has it.

1. documents that repeat a whole word sequence are settled at once and not looked at again;
2. of the rest, each window's least run of GRAM words is hashed; a run held by several documents sets a bit in a filter,
   which can only let too much through;
3. windows that pass are counted by hash. Those that stand for over 1/SHARE of all (so fewer than SHARE windows, whatever
   the corpus) make the broadcast shard: its automaton goes to every task and all documents are streamed through it, so
   a passage that a third of all rows share is no join key anywhere;
4. the others are grouped by hash: the smallest id is the reference, the documents that repeat it are routed to its shard,
   the set of passages that one document is the first to hold. That shard's automaton streams the routed stretches of
   text; one with many visitors is handed out in copies, each for a part of them. (To broadcast these shards too would
   take time with the square of the corpus, as their number grows with it.)

In both, matching statistics of ``window`` words or more, compared word by word, are the spans that go. Windows are told
apart by 64-bit hashes, so two unlike ones meet in one group with a chance of one in 10**19 a pair, and a removal of the
rarer might then be missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import KeyFilter, bitmap, filter_bits, small_batches, table, written
from curation.llm.near_dedup import WordHashes, mixed

WINDOW = 13
#: A window of over 1/SHARE of all candidates belongs to the broadcast shard, unless it is longer than WINDOW_BYTES.
SHARE, WINDOW_BYTES = 1 << 14, 2048
#: Stretches of text that one copy of a shard is matched with.
SHARD_PART = 128


class SuffixAutomaton:
    """All substrings of a sequence of words; passages are kept apart by marks that no text holds."""

    def __init__(self, passages: Iterable[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        for k, words in enumerate(passages):
            for word in (*words, k):
                self._append(word)

    def _append(self, word) -> None:
        new = self._state({}, self.length[self.last] + 1, 0)
        p = self.last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = clone
                    p = self.link[p]
                self.link[q] = self.link[new] = clone
        self.last = new

    def _state(self, following: dict, length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest match that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                length = 0
            yield length

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal stretches [start, end) that matches of ``least`` words or more cover."""
        out: list[tuple[int, int]] = []
        for end, length in enumerate(self.matching(words), 1):
            if length >= least:
                start = end - length
                if out and start <= out[-1][1]:
                    out[-1] = (min(out[-1][0], start), end)
                else:
                    out.append((start, end))
        return out


class Windows:
    """Hashes of a text's windows, and for each the least hash of the runs in its ``gram`` first places."""

    def __init__(self, window: int):
        self.window, self.gram, self.hashes = window, window // 2 + 1, WordHashes()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words) - self.window + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        w = self.hashes.of(words)
        g = np.full(len(w) - self.gram + 1, self.gram, np.uint64)
        for j in range(self.gram):
            g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(g)])
        places = self.window - self.gram + 1
        least = np.lib.stride_tricks.sliding_window_view(g, places).min(axis=1)
        # the first and the last run of a window have all its words, as twice a run is no shorter than a window
        return mixed(g[:n] * np.uint64(0xD1B54A32D192ED03) + g[places - 1 : places - 1 + n]), least


class BroadcastShard:
    """The automaton of the most repeated windows, given as (hash, owner, mark of the owner's text, place in it, words)."""

    def __init__(self, found: list[tuple[int, int, int, int, bytes]], window: int):
        self.window, self.owner = window, {h: owner for h, owner, *_ in found}
        self.owners = set(self.owner.values())
        passages, before = [], None
        for owner, mark, at, words in sorted({tuple(own) for _, *own in found}):
            if before == (owner, mark, at - 1):
                passages[-1].append(words.split()[-1])
            else:
                passages.append(words.split())
            before = owner, mark, at
        self.automaton = SuffixAutomaton(passages)

    def spans(self, i: int, words: list[bytes], windows: Windows) -> list[tuple[int, int]]:
        """Stretches of document ``i`` to remove: matches, but for windows that it is itself the first to hold."""
        found = self.automaton.spans(words, self.window)
        if i not in self.owners:
            return found
        # stretches that touch are one, so it may hold windows that are not in the shard
        starts = [(s + k, h) for s, e in found for k, h in enumerate(windows.of(words[s:e])[0].view(np.int64).tolist())]
        return [(k, k + self.window) for k, h in starts if self.owner.get(h, i) != i]


def words_of(column: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def long_array(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _sequences(docs: DataFrame) -> DataFrame:
    """id, mark, n_words, digest of the word sequence."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(2))
            digests = [hashlib.blake2b(b" ".join(ws), digest_size=16).hexdigest() for ws in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], long_array(map(len, words)), pa.array(digests, pa.string())], names=["id", "mark", "n_words", "digest"])

    return docs.mapInArrow(task, "id long, mark long, n_words long, digest string")


def marked_rows(docs: DataFrame, id_col: str, text_col: str, total: int) -> DataFrame:
    """id, mark, text of the rows that have an id; the mark tells apart the texts of one id and is 0 for nearly all others."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mark = F.xxhash64("text").alias("mark")
    several = rows.select("id", mark).groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("id")
    flagged = KeyFilter(written(several), ["id"], total).marked(rows, ["id"], "_several")
    return flagged.select("id", F.when(F.col("_several"), mark).otherwise(F.lit(0).cast("long")).alias("mark"), "text")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per text that loses words its id, its ``mark`` (0, or the text's xxhash64, which tells apart the texts of one id) and
    ``spans``, an array of [start, end) word positions (they may overlap); a document whose whole word sequence is that of a
    smaller id has the span from 0 to its length.

    Windows are judged on the input. Null text has no words; a row without id loses nothing and is no reference. Rows that
    repeat an id lose what smaller ids have, each from its own text, and nothing to each other; each of their texts is a
    reference for larger ids. An empty table gives no rows; other columns are not read. ``share`` sets how many windows the
    broadcast shard may have; the result doesn't depend on it.
    """
    spark, total = docs.sparkSession, docs.count()
    rows = marked_rows(docs, id_col, text_col, total)
    sequences = written(_sequences(rows).where(F.col("n_words") >= window))
    first = written(sequences.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").select("digest", "rep"))
    copies = written(sequences.join(first, "digest").where("id > rep").select("id", "mark", "n_words").distinct())
    flagged = KeyFilter(copies, ["id"], total).marked(rows, ["id"], "_maybe")
    maybe = flagged.where("_maybe").select("id", "mark", "text").join(copies.select("id", "mark"), ["id", "mark"], "left_anti")
    single = flagged.where("not _maybe").select("id", "mark", "text").unionByName(maybe)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        for batch in batches:
            least = [np.unique(windows.of(ws)[1]) for ws in words_of(batch.column(2))]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in least])
            yield pa.RecordBatch.from_arrays([long_array(np.concatenate(least).view(np.int64)), long_array(ids)], names=["run", "id"])

    shared = single.mapInArrow(runs, "run long, id long").groupBy("run").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    size = filter_bits(sequences.agg(F.sum("n_words")).first()[0] or 0, 1)
    bits = np.zeros(size // 8, np.uint8)
    # rows of 4 KB, 128 MB at most
    for r in bitmap(shared, F.pmod("run", F.lit(size)) + 1).toLocalIterator():
        bits[(r["_bucket"] - 1) * 4096 : r["_bucket"] * 4096] = np.frombuffer(r["_bits"], np.uint8)
    passing = spark.sparkContext.broadcast(bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        for batch in batches:
            found, at = [], []
            for ws in words_of(batch.column(2)):
                hashes, least = windows.of(ws)
                bit = (least & np.uint64(size - 1)).astype(np.int64)
                where = np.flatnonzero(passing.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                found.append(hashes[where])
                at.append(where)
            sizes = [len(x) for x in at]
            own = [long_array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([long_array(np.concatenate(found).view(np.int64)), *own, pa.array(np.concatenate(at), pa.int32())], names=["hash", "id", "mark", "at"])

    seen = written(single.mapInArrow(candidates, "hash long, id long, mark long, at int"))
    shard = _broadcast_shard(single, seen, window, share)
    everywhere = spark.sparkContext.broadcast(shard)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, windows = everywhere.value, Windows(window)
        for batch in batches:
            rows_ = zip(*(batch.column(c).to_pylist() for c in (0, 1)), words_of(batch.column(2)))
            out = [(i, mark, s, e) for i, mark, ws in rows_ for s, e in shard.spans(i, ws, windows)]
            yield pa.RecordBatch.from_arrays([*map(long_array, list(zip(*out)) or [()] * 4)], names=["id", "mark", "s", "e"])

    settled = spark.createDataFrame([(h,) for h in shard.owner], "hash long")  # fewer than ``share`` rows
    seen = seen.join(F.broadcast(settled), "hash", "left_anti")
    owners = seen.groupBy("hash").agg(F.min(F.struct("id", "mark")).alias("first"), F.max("id").alias("high")).where("first.id < high")
    # written before the join, so Spark may split that of a window that very many documents have
    owners = written(owners.select("hash", F.col("first.id").alias("owner"), F.col("first.mark").alias("owner_mark")))
    own = seen.join(owners, "hash").where("id <> owner or mark = owner_mark")
    places = own.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "owner", "owner_mark")).alias("places"))  # at most a document's words
    places = written(places)
    texts = KeyFilter(places, ["id"], total).marked(single, ["id"], "_maybe").where("_maybe").select("id", "mark", "text")
    routed = texts.join(places, ["id", "mark"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows of one owner: a passage of the shard where the owner is the document itself, else a visit."""
        for batch in batches:
            out = []
            for i, mark, ws, found in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), words_of(batch.column("text")), batch.column("places")):
                inner = found.values
                at, owner, owner_mark = (inner.field(c).to_numpy() for c in ("at", "owner", "owner_mark"))
                order = np.argsort(at, kind="stable")
                at, owner, owner_mark = at[order], owner[order], owner_mark[order]
                breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) != 0) | (owner_mark[1:] != owner_mark[:-1])) + 1
                for part in np.split(np.arange(len(at)), breaks):
                    s, e = int(at[part[0]]), int(at[part[-1]]) + window
                    out.append((int(owner[part[0]]), int(owner_mark[part[0]]), i, mark, s, b" ".join(ws[s:e])))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*map(long_array, columns[:5]), pa.array(columns[5], pa.binary())], names=["owner", "owner_mark", "id", "mark", "start", "words"])

    visits = written(routed.select("id", "mark", "text", "places").mapInArrow(stretches, "owner long, owner_mark long, id long, mark long, start long, words binary"))
    parts = visits.groupBy("owner", "owner_mark").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SHARD_PART)).cast("int").alias("parts"))
    dealt = visits.join(parts, ["owner", "owner_mark"])
    mine = F.col("owner") == F.col("id")
    part = F.when(mine, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "start"), F.col("parts")).cast("int")))
    dealt = dealt.select("owner", "owner_mark", F.explode(part).alias("part"), "id", "mark", "start", "words")
    dealt = dealt.repartition("owner", "owner_mark", "part").sortWithinPartitions("owner", "owner_mark", "part", F.col("owner") != F.col("id"), "start")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, passages, automaton = None, [], None
        for batch in batches:
            out = []
            for owner, owner_mark, k, i, mark, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != (owner, owner_mark, k):
                    shard, passages, automaton = (owner, owner_mark, k), [], None
                if owner == i:
                    passages.append(words.split())
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton(passages)
                out += [(i, mark, start + s, start + e) for s, e in automaton.spans(words.split(), window)]
            yield pa.RecordBatch.from_arrays([*map(long_array, list(zip(*out)) or [()] * 4)], names=["id", "mark", "s", "e"])

    spans = dealt.mapInArrow(matched, "id long, mark long, s long, e long").unionByName(copies.select("id", "mark", F.lit(0).cast("long").alias("s"), F.col("n_words").alias("e")))
    if shard.owner:
        spans = spans.unionByName(single.mapInArrow(streamed, "id long, mark long, s long, e long"))
    return spans.groupBy("id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _broadcast_shard(single: DataFrame, seen: DataFrame, window: int, share: int) -> BroadcastShard:
    """The shard of the windows that over 1/``share`` of the rows of ``seen`` stand for, if several documents hold them.

    Counted in two steps, so that only rows of full counters are grouped: eight counters for each window that may be in.
    """
    total = seen.count()
    counter = F.pmod(F.xxhash64("hash"), F.lit(8 * share)).cast("int")
    full = seen.groupBy(counter.alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > total)
    marks = bytearray(8 * share)
    for r in full.collect():  # fewer than ``share`` counters
        marks[r["c"]] = 1
    few = seen.where(F.substring(F.lit(bytes(marks)), counter + 1, F.lit(1)) == F.lit(b"\x01"))
    top = few.groupBy("hash").agg(F.min(F.struct("id", "mark", "at")).alias("first"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    top = written(top.where((F.col("n") * share > total) & (F.col("first.id") < F.col("high"))).select("hash", "first.id", "first.mark", "first.at"))
    wanted = top.groupBy("id", "mark").agg(F.collect_list(F.struct("hash", "at")).alias("windows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, mark, ws, windows in zip(*(batch.column(c).to_pylist() for c in ("id", "mark")), words_of(batch.column("text")), batch.column("windows").to_pylist()):
                out += [(w["hash"], i, mark, w["at"], text) for w in windows if len(text := b" ".join(ws[w["at"] : w["at"] + window])) <= WINDOW_BYTES]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*map(long_array, columns[:4]), pa.array(columns[4], pa.binary())], names=["hash", "id", "mark", "at", "words"])

    texts = single.join(F.broadcast(wanted), ["id", "mark"]).select("id", "mark", "text", "windows").mapInArrow(cut, "hash long, id long, mark long, at long, words binary")
    # fewer than ``share`` windows of at most WINDOW_BYTES
    return BroadcastShard([(r["hash"], r["id"], r["mark"], r["at"], bytes(r["words"])) for r in texts.distinct().collect()], window)


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_own`` (the row) and ``_spans`` (null: none); only rows that may have spans are shuffled."""
    rows = docs.select(F.struct("*").alias("_own"), F.col(id_col).cast("long").alias("_id"))
    flagged = KeyFilter(spans.select(F.col("id").alias("_id")), ["_id"], docs.count()).marked(rows, ["_id"], "_maybe")
    found = spans.select(F.col("id").alias("_i"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    own = (F.col("_mark") == 0) | (F.col("_mark") == F.xxhash64(F.coalesce(F.col(f"_own.{text_col}"), F.lit(""))))
    hit = flagged.where("_maybe").join(found, (F.col("_id") == F.col("_i")) & own, "left").select("_own", "_spans")
    return flagged.where("not _maybe").select("_own", F.lit(None).cast(spans.schema["spans"].dataType).alias("_spans")).unionByName(hit)


def kept_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    keep = np.ones(n, bool)
    for x in () if spans is None else spans:
        keep[x["s"] : x["e"]] = False
    return keep


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with its own columns, repeated words cut out of the text; a text that loses nothing keeps its blanks.

    Nulls, repeated ids and the empty table: as ``repeated_spans`` says; every row stays, if only with an empty text.
    """
    spans = written(repeated_spans(docs, id_col, text_col, window))
    kind = spans.schema["spans"].dataType

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, found):
            if t is not None and spans_ is not None and len(spans_):
                ws = t.encode().split()
                keep = kept_mask(len(ws), spans_)
                t = b" ".join(w for w, k in zip(ws, keep) if k).decode()
            out.append(t)
        return pd.Series(out, dtype="object")

    rows = with_spans(docs, spans, id_col, text_col).withColumn("_spans", F.col("_spans").cast(kind))
    text = F.when(F.col("_spans").isNull(), F.col(f"_own.{text_col}")).otherwise(cut.asNondeterministic()(F.col(f"_own.{text_col}"), F.col("_spans")))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"_own.`{c}`").alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what is left of it: n_words, n_removed, kept_sha256."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_spans(docs, written(repeated_spans(docs))).select(F.col("_own.doc_id").alias("doc_id"), F.col("_own.text").alias("text"), F.col("_spans").alias("spans"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, words = [], [], words_of(batch.column("text"))
            for ws, spans in zip(words, batch.column("spans").to_pylist()):
                keep = kept_mask(len(ws), spans) if spans else None
                left = ws if keep is None else [w for w, k in zip(ws, keep) if k]
                removed.append(len(ws) - len(left))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), long_array(map(len, words)), long_array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: DuckDB's answer: every window as a text, the least id that has it, and the words that no window of a smaller id covers.
ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w)),
first AS (SELECT x, min(doc_id) AS owner FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows JOIN first USING (x) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
