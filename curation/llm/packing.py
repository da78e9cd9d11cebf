"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

A task streams its documents through pools of about a million tokens and packs each pool by itself: documents in
descending length go to the sequence of lowest estimated attention cost (linear plus quadratic in a piece's length)
among those with room, and are cut where none has room for all of them. A pool's sequences are all filled: its last
tokens go to sequences whose lengths are powers of two, which need no padding. Nothing is shuffled, so no key can be
hot, and a lost task repeats its own pools only.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.bpe_counts import has_foreign
from curation.llm.common import small_batches, table

CAPACITY = 4096
END_ID = 2
#: Tokens that a task gathers before it packs them.
POOL_TOKENS = 1 << 20
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Entries of a generation of a worker's cache of words and of their pieces; and where packing has the worker to itself.
CACHE_WORDS, OWN_CACHE_WORDS = 100_000, 250_000
#: Pieces that one call of the library merges.
CALL_PIECES = 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class DocumentIds:
    """Whole texts -> their ids as little-endian unsigned 32-bit bytes, those of the tokenizer; each distinct piece of a
    word goes to the library once, many in one call. The cache of words and pieces has two generations: once the new
    one is full, the one before it is forgotten."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalizer = json.dumps(spec["normalizer"])
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # the same model for text that is normalised and cut already
        bare = {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, letters]}}
        self.merges, self.tokenizer = Tokenizer.from_str(json.dumps(spec | bare)), Tokenizer.from_file(path)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        self.most = most
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: merged side by side, told apart by the tokens that end a word."""
        calls = [" ".join(pieces[i : i + CALL_PIECES]) for i in range(0, len(pieces), CALL_PIECES)]
        ids = np.concatenate([np.empty(0, "<u4"), *(np.asarray(e.ids, "<u4") for e in self.merges.encode_batch_fast(calls, add_special_tokens=False))])
        raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def batch(self, texts: list[str]) -> list[bytes]:
        # special strings, the separators that str.split adds to white space, the letter whose lower case depends on its
        # place and code points that the library treats unlike Python are left to the tokenizer
        whole = {i for i, t in enumerate(texts) if "<|" in t or any(c in t for c in "\x1c\x1d\x1e\x1fΣ") or not t.isascii() and has_foreign(t, self.normalizer)}
        split = [[] if i in whole else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split() for i, t in enumerate(texts)]
        self.learn({w for ws in split for w in ws}.difference(self.known))
        found = [self.library(texts[i]) if i in whole else b"".join(map(self.known.__getitem__, ws)) for i, ws in enumerate(split)]
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        return found

    def learn(self, words: set[str]) -> None:
        """Put words that the newer generation lacks into it."""
        known = self.known
        old = self.before.keys() & words
        known.update(zip(old, map(self.before.__getitem__, old)))
        new = words - old if old else words
        plain = set(filter(str.isalpha, new))
        other = [*new.difference(plain)]
        cut = [*map(self.pattern.findall, other)]
        pieces = [*plain.union(*cut).difference(known)]
        known.update(zip(pieces, self.merged(pieces), strict=True))
        known.update(zip(other, [b"".join([known[p] for p in ps]) for ps in cut]))

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=1)
def ids_of(path: str, most: int = CACHE_WORDS) -> DocumentIds:
    """One tokenizer per worker process, whose word cache its tasks share."""
    return DocumentIds(path, most)


def sequence_sizes(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then one for each power of two in what is left."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def packed(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document's place, start, length, sequence's place, offset) and the sequences' sizes."""
    sizes = sequence_sizes(sum(lengths), capacity)
    room, used, cost = np.array(sizes, np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    heap = [(-min(n - s, capacity), i, s) for i, n in enumerate(lengths) for s in range(0, n, capacity)]
    heapify(heap)
    pieces = []
    while heap:
        n, i, start = heappop(heap)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        k = int(np.argmin(np.where(fits, cost, np.inf)))
        part = min(n, int(room[k]))
        pieces.append((i, start, part, k, int(used[k])))
        room[k] -= part
        used[k] += part
        cost[k] += LINEAR * part + QUADRATIC * part * part
        if part < n:
            heappush(heap, (part - n, i, start + part))
    return pieces, sizes


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all rows of ``docs``; see ``SCHEMA``. Every id lies in exactly one piece.

    A task packs ``pool_tokens`` tokens at a time, so it holds no more than those and a document, and which sequence is
    the cheapest is judged within a pool; a pool leaves no padding, however it is cut.

    Null and empty texts have the end id alone. Repeated rows are packed each for itself, a null id is handed
    through, other columns are not read, and an empty table gives no pieces. ``sequence_id`` holds the task's number
    above bit 40, and is unique within one result.
    """
    schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])

    def pool(ids: list, tokens: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(t) // 4 for t in tokens]
        pieces, sizes = packed(lengths, capacity)
        rows = [(ids[i], s, n, zlib.crc32(tokens[i][4 * s : 4 * (s + n)]), lengths[i], first + k, at, sizes[k]) for i, s, n, k, at in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema), first + len(sizes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, following = ids_of(path, cache_words), TaskContext.get().partitionId() << 40
        end = np.asarray([END_ID], "<u4").tobytes()
        ids, tokens, held = [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, t in zip(batch.column(0).to_pylist(), encode.batch(texts)):
                ids.append(i)
                tokens.append(t + end)
                held += len(t) // 4 + 1
                if held >= pool_tokens:
                    out, following = pool(ids, tokens, following)
                    ids, tokens, held = [], [], 0
                    yield out
        if ids:
            yield pool(ids, tokens, following)[0]

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache_words=OWN_CACHE_WORDS)
