"""Piece encoding and decoding by a lattice pass over a trie of distinct marked words.

The distinct words of a batch, each with the mark of the blanks before it, are sorted; going through them in that
order is a depth-first walk of their trie, and the forward states of a common prefix are kept. The state of a prefix
is the last piece of its best encoding, which words that share the prefix share as well.

Under a unigram model a prefix's state is the best sum of scores and the piece that ends it: a Viterbi pass over the trie.

The vocabulary at hand is a merge model, whose encoding is not the path of the highest sum of scores: a sum-of-scores
Viterbi would differ from the library. What the lattice pass maximises there is merge order: a piece may end a prefix
if it and the piece before it would be left standing when the two are merged by rank, and exactly one does.
Characters outside the vocabulary become byte pieces. Models of other kinds, and those without byte pieces, are refused.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import small_batches, table

MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Entries of the word and pair caches of a worker (emptied when full), and the longest word that is kept in one.
CACHE_WORDS, CACHE_PAIRS, CACHE_LENGTH = 400_000, 500_000, 64


UNIGRAM, MERGES = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def model_kind(path: str) -> int:
    """The kind of a model file; unigram where it doesn't say."""
    with open(path, "rb") as f:
        trainer = next((v for n, v in fields(f.read()) if n == 2), b"")
    return next((v for n, v in fields(trainer) if n == 3), UNIGRAM)


class Pieces:
    """Vocabulary of a model file: ranks of its normal pieces (best first), ids, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        kind, model = model_kind(path), sentencepiece.SentencePieceProcessor(model_file=path)
        everything = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in everything]
        normal = [i for i in everything if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {self.names[i]: -model.get_score(i) for i in normal}
        self.ids = {self.names[i]: i for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i in everything if model.is_byte(i)}
        if kind not in (UNIGRAM, MERGES) or len(self.bytes) < 256:
            raise ValueError(f"{path}: no unigram or merge model with byte pieces")
        self.unigram = kind == UNIGRAM
        if self.unigram and any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError(f"{path}: pieces that go on over a blank")
        # in single precision as the library has them; an unknown character costs ten more than the worst piece
        self.scores = {p: np.float32(-r) for p, r in self.rank.items()}
        self.unknown = min(self.scores.values(), default=np.float32(0)) - np.float32(10)
        values = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([values[i]]) if i in values else name.encode() for i, name in enumerate(self.names)]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}
        # pieces that merging their own characters gives, and by their last two characters the lengths there are
        self.whole = {p for p in self.rank if self.unigram or self.merged(p) == [p]}
        tails = defaultdict(set)
        for p in self.whole:
            if len(p) > 1:
                tails[p[-2:]].add(len(p))
        self.tails = {t: sorted(sizes, reverse=True) for t, sizes in tails.items()}

    def merged(self, text: str) -> list[str]:
        """Pieces left after merging the best adjacent pair, leftmost of equals, while any is known."""
        parts: list[str] = list(text)
        n, rank = len(parts), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ab) for i in range(n - 1) if (r := rank.get(ab := parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, ab = heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != ab:
                continue
            parts[i], parts[j] = ab, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank.get(both := parts[x] + parts[y])) is not None:
                    heappush(heap, (r, x, both))
        return [p for p in parts if p]

    def stands(self, a: str, b: str) -> bool:
        """Merging a and b's characters by rank leaves just these two pieces."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def last_piece(self, word: str, end: int, last: list[str]) -> str:
        """The piece that ends the prefix of length ``end``, from the states of the shorter prefixes."""
        whole, pairs = self.whole, self._pairs
        for size in self.tails.get(word[end - 2 : end], ()) if end > 1 else ():
            if size > end:
                continue
            piece = word[end - size : end]
            if piece in whole:
                before = last[end - size]
                # nothing merges with a character outside the vocabulary
                if not before or before not in whole:
                    return piece
                known = pairs.get((before, piece))
                if known or (known is None and self.stands(before, piece)):
                    return piece
        return word[end - 1]

    def best_piece(self, word: str, end: int, sums: list) -> tuple:
        """Best sum of scores of the prefix of length ``end`` and the piece that ends it; of equal sums the longest piece."""
        best, chosen = None, ""
        for size in (*(self.tails.get(word[end - 2 : end], ()) if end > 1 else ()), 1):
            piece = word[end - size : end]
            if size > end or size > 1 and piece not in self.scores:
                continue
            total = sums[end - size] + self.scores.get(piece, self.unknown)
            if best is None or total > best:
                best, chosen = total, piece
        return best, chosen

    def learn(self, words: set[str]) -> None:
        """Encode new words: in sorted order, the states of the prefix shared with the word before are reused."""
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
        last, sums, previous = [""], [np.float32(0)], ""
        for word in sorted(words.difference(self._words)):
            shared = 0
            most = min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], sums[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.unigram:
                    total, piece = self.best_piece(word, end, sums)
                    sums.append(total)
                    last.append(piece)
                else:
                    last.append(self.last_piece(word, end, last))
            previous = word
            self._words[word] = self.path(last)

    def path(self, last: list[str]) -> bytes:
        found, at = [], len(last) - 1
        while at:
            piece = last[at]
            known = self.ids.get(piece)
            found += [known] if known is not None else [self.bytes[b] for b in reversed(piece.encode())]
            at -= len(piece)
        return array("i", found[::-1]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as 32-bit bytes."""
        split = [MARKED.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        out = [b"".join(map(self._words.__getitem__, ws)) for ws in split]
        for w in {w for ws in split for w in ws if len(w) > CACHE_LENGTH}:
            del self._words[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the blank that encoding put first is taken off."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One vocabulary per worker process, whose caches its tasks share."""
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids``, the whole text's pieces (null and empty: none), and their CRC-32 as little-endian 32-bit
    values. Repeated rows are encoded each for itself, a null id is handed through, other columns are not read, and an
    empty table gives no rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            raw = pieces.encode([t or "" for t in batch.column(1).to_pylist()])
            found = [np.frombuffer(x, "<i4") for x in raw]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(map(zlib.crc32, raw), pa.int64())], names=["doc_id", "ids", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, "doc_id long, ids array<int>, ids_crc32 long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with the text of their ``ids`` in ``text``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            column = batch.column(1)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [pieces.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select("doc_id", "ids", "ids_crc32").mapInArrow(task, "doc_id long, ids array<int>, ids_crc32 long, text string")


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_pieces, the CRC-32 of its ids, and the SHA-256 of the text that they decode to."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
