"""Token counts by byte-pair merging with a heap over a linked list of symbols; no identifier is emitted.

A text is cut at special strings, normalised (NFC, lower case) and cut into words; each distinct word is merged once
per worker and its count kept in a cache of bounded size, so a document costs one look-up per word. A text with a code
point that Python's Unicode tables leave unassigned, or that the library's normaliser treats unlike Python's, is normalised
and cut by the library.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import small_batches, table

TOKEN_LIMIT = 2048
#: Entries of a worker's word cache; it is emptied when full.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def lowered(text: str) -> str:
    """NFC in lower case, each letter for itself: a final sigma is like any other."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


@cache
def foreign(normalizer: str) -> np.ndarray:
    """For each code point whether it is left to the library: Python's tables leave it unassigned, or the library's
    normaliser (given as JSON), whose tables are of other versions, treats it in another way.

    Each is tried alone, taken apart, and between a letter and marks of two kinds: those that would be composed across it
    or put in order with it tell whether its combining class is known.
    """
    from tokenizers import Tokenizer

    bare = {"type": "BPE", "vocab": {}, "merges": [], "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False}
    empty = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": None, "post_processor": None, "decoder": None}
    library = Tokenizer.from_str(json.dumps(empty | {"normalizer": json.loads(normalizer), "model": bare})).normalizer
    out = np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    rest = "".join(chr(i) for i in range(128, sys.maxunicode + 1) if not out[i] and not 0xD800 <= i < 0xE000 and not chr(i).isspace())
    marks = "".join(c for c in rest if unicodedata.combining(c))
    for chars, trial in ((rest, "{}"), (rest, None), (marks, "s{}\u0301"), (marks, "s{}\u0334")):
        for at in range(0, len(chars), 4096):
            part = chars[at : at + 4096]
            tried = list(map(trial.format, part)) if trial else [unicodedata.normalize("NFD", c) for c in part]
            # line ends keep apart what is tried in one call; were one lost or added, each would be tried by itself
            text = "\n".join(tried)
            own, theirs = lowered(text).split("\n"), library.normalize_str(text).split("\n")
            if not len(own) == len(theirs) == len(tried):
                own, theirs = list(map(lowered, tried)), list(map(library.normalize_str, tried))
            out[[ord(c) for c, x, y in zip(part, own, theirs) if x != y]] = True
    return out


def has_foreign(text: str, normalizer: str) -> bool:
    return bool(foreign(normalizer)[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


class WordCounts(dict):
    """White-space separated word -> its number of tokens, worked out on first use."""

    def __init__(self, spec: dict):
        super().__init__()
        self.spec, self.library, self.normalizer = spec, None, json.dumps(spec["normalizer"])
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.vocab, self.end = vocab, model["end_of_word_suffix"]
        end, letters = self.end, byte_alphabet()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pieces: dict[str, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))) or r"(?!)")

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.piece(word) if word.isalpha() else sum(map(self.piece, self.pattern.findall(word)))
        return n

    def piece(self, word: str) -> int:
        n = self.pieces.get(word)
        if n is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            n = self.pieces[word] = self.merged(self.symbols(word))
        return n

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        return [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]

    def merged(self, symbols: list[int]) -> int:
        """Number of symbols left after popping the lowest-rank adjacent pair (leftmost of equals) until none is known.

        The list is merged in place; a symbol that went into the one before it is -1.
        """
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := merges.get((a, b)))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapify(heap)
        left = n
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heappush(heap, (m[0], i, m[1], new, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], new))):
                heappush(heap, (m[0], h, m[1], symbols[h], new))
        return left

    def text(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token, as is that library's default."""
        if "<" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def cut(self, text: str) -> list[str]:
        """The library's pieces of a text, in the printable stand-ins of their bytes."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def plain(self, text: str) -> int:
        if not text.isascii():
            if has_foreign(text, self.normalizer):
                return sum(self.merged([*(self.vocab[c] for c in p[:-1]), self.vocab[p[-1] + self.end]]) for p in self.cut(text))
            text = lowered(text)
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space, the pattern doesn't
            return sum(map(self.piece, self.pattern.findall(text)))
        return sum(map(self.__getitem__, text.split()))


def token_counter(path: str):
    """A column function: text -> its tokens under the vocabulary file at ``path`` (null: 0)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with open(path, encoding="utf-8") as f:
            words = WordCounts(json.load(f))
        for texts in batches:
            yield pd.Series([words.text(t) if t else 0 for t in texts], dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit``; columns of these names are replaced.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted each for itself; an empty table gives
    none. The file must be readable at ``path`` on every executor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("n_tokens", token_counter(path)(text)).withColumn("n_bytes", F.octet_length(text).cast("long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
