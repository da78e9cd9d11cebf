"""Languages of words and documents by a linear-chain conditional random field.

A word is seen by its affixes, character n-grams and membership in word lists learnt per language; transitions
between the languages of neighbouring words are learnt on sequences that switch. Forward-backward gives each word's
posterior, and a document's language is the one with the largest expected share of its words. A run of characters
without a blank that is longer than SEGMENT is read as several words, which overlap so that no n-gram is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from curation.llm.common import small_batches, table
from curation.llm.quality import learnable

#: Bounds of what the model is fitted on, all of them arguments of ``fit``: documents, shared out among the languages,
#: passages drawn from each and the words of one, and switching sequences made of them; and the words of a sequence.
TRAIN_DOCS, PASSAGES, PASSAGE_WORDS, TRAIN_SEQUENCES = 3000, 8, 40, 5000
LENGTH = 64
BUCKETS = 1 << 16
PASSES, BATCH, RATE = 2, 64, 0.3
#: Words of a block in the parallel scan.
BLOCK = 32
#: Characters of a word; of each segment of a longer one, the last OVERLAP are the first of the next.
SEGMENT, OVERLAP = 24, 2
CACHE_WORDS, CACHE_GRAMS = 300_000, 300_000
LETTER = regex.compile(r"\p{L}")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„«»‘’¡¿"


def segments(word: str) -> list[str]:
    """The word, or its segments if it is long; inner ends are marked, so that they are no affixes and keep their signs."""
    if len(word) <= SEGMENT:
        return [word]
    w = word.strip(EDGE)
    cuts = range(0, max(1, len(w) - OVERLAP), SEGMENT - OVERLAP)
    return ["\0" * (i > 0) + w[i : i + SEGMENT] + "\0" * (i + SEGMENT < len(w)) for i in cuts]


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    return words if max(map(len, words), default=0) <= SEGMENT else [s for w in words for s in segments(w)]


class Buckets(dict):
    """Feature -> its hashed bucket, worked out once for each in the cache."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE_GRAMS:
            self.clear()
        n = self[feature] = zlib.crc32(feature.encode()) % BUCKETS
        return n


bucket_of = Buckets().__getitem__


def word_features(word: str, lists: dict[str, int]) -> list[int]:
    """Hashed prefixes and suffixes up to three letters, n-grams of two and three, and the word list that has it."""
    w = word.strip(EDGE)
    if not LETTER.search(w):
        return [0]
    twos = [*map(add, w, w[1:])]
    found = [*map(bucket_of, ("<" + w[:1], "<" + w[:2], "<" + w[:3], ">" + w[-1:], ">" + w[-2:], ">" + w[-3:], *twos, *map(add, twos, w[2:])))]
    if w in lists:
        found.append(zlib.crc32(b"list %d" % lists[w]) % BUCKETS)
    return found


class Field:
    """The model: languages, word lists, weights of features (BUCKETS x languages) and of transitions."""

    def __init__(self, languages: list[str], lists: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.lists, self.weights, self.transitions = languages, lists, weights, transitions
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((0, len(languages)), np.float32)
        self._lettered = np.zeros(0)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "lists": self.lists, "weights": self.weights, "transitions": self.transitions}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, and 1 where a word has a letter; worked out once for each distinct word in the cache."""
        if len(self._rows) > CACHE_WORDS:
            self._rows, self._scores, self._lettered = {}, self._scores[:0], self._lettered[:0]
        new = set(words).difference(self._rows)
        cores = [w.strip(EDGE) for w in new]  # all that a word's features depend on
        fresh = [*set(cores).difference(self._rows)]
        if fresh:
            ids = [word_features(w, self.lists) for w in fresh]
            sizes = [*map(len, ids)]
            flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(sizes))
            scores = np.add.reduceat(self.weights[flat], np.cumsum([0, *sizes[:-1]]), axis=0)
            self._rows.update(zip(fresh, range(len(self._scores), len(self._scores) + len(fresh))))
            self._scores = np.concatenate([self._scores, scores.astype(np.float32)])
            self._lettered = np.concatenate([self._lettered, [float(i != [0]) for i in ids]])
        self._rows.update(zip(new, [self._rows[w] for w in cores]))
        at = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
        return self._scores[at], self._lettered[at]

    def marginals(self, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Posteriors of words in sequences laid end to end; ``first`` is true where one begins.

        Between sequences the step is of rank one, which carries nothing over. Blocks are multiplied out side by
        side, their entries chained, then their inner vectors filled in side by side.
        """
        n, k = unary.shape
        blocks = -(-n // BLOCK)
        e = np.ones((blocks * BLOCK, k))
        e[:n] = np.exp(unary - unary.max(axis=1, keepdims=True))
        e = e.reshape(blocks, BLOCK, k)
        reset = np.ones(blocks * BLOCK, bool)
        reset[:n] = first
        reset = reset.reshape(blocks, BLOCK)
        step = np.exp(self.transitions - self.transitions.max())
        both = np.stack([step, np.ones_like(step)])

        product = np.broadcast_to(np.eye(k), (blocks, k, k))
        for t in range(BLOCK):
            product = (product @ both[reset[:, t].astype(int)]) * e[:, t, None, :]
            product = product / product.max(axis=(1, 2), keepdims=True)
        entry, leave = np.empty((blocks, k)), np.empty((blocks, k))
        a = b = np.full(k, 1 / k)
        for i in range(blocks):
            entry[i] = a
            a = a @ product[i]
            a = a / a.sum()
        for i in reversed(range(blocks)):
            leave[i] = b
            b = product[i] @ b
            b = b / b.sum()
        alpha, beta = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
        for t in range(BLOCK):
            a = entry if t == 0 else alpha[:, t - 1]
            a = np.where(reset[:, t, None], a.sum(axis=1, keepdims=True), a @ step) * e[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        beta[:, -1] = leave
        for t in reversed(range(1, BLOCK)):
            b = e[:, t] * beta[:, t]
            b = np.where(reset[:, t, None], b.sum(axis=1, keepdims=True), b @ step.T)
            beta[:, t - 1] = b / b.sum(axis=1, keepdims=True)
        p = (alpha * beta).reshape(-1, k)[:n]
        return p / p.sum(axis=1, keepdims=True)


def word_lists(words: list[tuple[str, int]], languages: int) -> dict[str, int]:
    """Words that were seen three times or more, nine times in ten in one language."""
    seen = Counter(words)
    totals: Counter = Counter()
    for (w, _), n in seen.items():
        totals[w] += n
    return {w: k for (w, k), n in seen.items() if n >= 3 and n >= 0.9 * totals[w]}


def passages(text: str | None, most: int = PASSAGES, size: int = PASSAGE_WORDS) -> list[str]:
    """At most ``most`` stretches of ``size`` words from anywhere in the whole text; the draw depends on the text alone."""
    words = words_of(text or "")
    if len(words) <= most * size:
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    draw = np.random.default_rng(zlib.crc32(text.encode()))
    return [" ".join(words[i : i + size]) for i in sorted(draw.integers(0, len(words) - size + 1, most).tolist())]


def trained(texts: list[tuple[list[str], str]], sequences: int = TRAIN_SEQUENCES) -> Field:
    """A field from (passages, language) rows, sorted; the draw is seeded, so equal rows give an equal model."""
    languages = sorted({lang for _, lang in texts})
    place = {lang: i for i, lang in enumerate(languages)}
    k, draw = len(languages), np.random.default_rng(11)
    held = [(p.split(" "), place[lang]) for ps, lang in sorted(texts) for p in ps]
    held = [(w, i) for w, i in held if any(w)]
    field = Field(languages, {}, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    if k < 2 or not held:
        return field
    # sequences of segments, each from a passage of a language drawn evenly
    by_language = [[w for w, i in held if i == j] for j in range(k)]
    words, labels = [], []
    for _ in range(sequences):
        ws, ls = [], []
        while len(ws) < LENGTH:
            j = int(draw.integers(k))
            if not by_language[j]:
                continue
            doc = by_language[j][int(draw.integers(len(by_language[j])))]
            at, size = int(draw.integers(max(1, len(doc) - 7))), int(draw.integers(8, 40))
            ws += doc[at : at + size]
            ls += [j] * len(doc[at : at + size])
        words.append(ws[:LENGTH])
        labels.append(ls[:LENGTH])
    field.lists = word_lists([(w.strip(EDGE), j) for ws, ls in zip(words, labels) for w, j in zip(ws, ls)], k)
    ids = {w: np.asarray(word_features(w, field.lists), np.int64) for w in {w for ws in words for w in ws}}
    y = np.asarray(labels)
    squares, t_squares = np.full((BUCKETS, k), 1e-2, np.float32), np.full((k, k), 1e-2)
    for _ in range(PASSES):
        for part in np.array_split(draw.permutation(len(words)), max(1, len(words) // BATCH)):
            rows = [ids[w] for i in part for w in words[i]]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.concatenate(rows)
            unary = np.add.reduceat(field.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            unary = unary.reshape(len(part), LENGTH, k).astype(np.float64)
            e = np.exp(unary - unary.max(axis=2, keepdims=True))
            step = np.exp(field.transitions - field.transitions.max())
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for t in range(LENGTH):
                a = e[:, t] if t == 0 else (alpha[:, t - 1] @ step) * e[:, t]
                alpha[:, t] = a / a.sum(axis=1, keepdims=True)
            for t in reversed(range(1, LENGTH)):
                b = (e[:, t] * beta[:, t]) @ step.T
                beta[:, t - 1] = b / b.sum(axis=1, keepdims=True)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            pairs = alpha[:, :-1, :, None] * step * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            truth = np.eye(k)[y[part]]
            g = np.repeat((truth - p).reshape(-1, k), sizes, axis=0) / len(part)
            used, where = np.unique(flat, return_inverse=True)
            total = np.stack([np.bincount(where, g[:, j], len(used)) for j in range(k)], axis=1)
            squares[used] += total**2
            field.weights[used] += RATE * total / np.sqrt(squares[used])
            seen = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
            t_gain = (seen - pairs.sum(axis=(0, 1))) / len(part)
            t_squares += t_gain**2
            field.transitions += RATE * t_gain / np.sqrt(t_squares)
    return field


def fit(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, most_passages: int = PASSAGES, passage_words: int = PASSAGE_WORDS, sequences: int = TRAIN_SEQUENCES) -> Field:
    """A field from at most ``train_docs`` documents outside the held-out quarter.

    Each language has an equal part of them, in the order of a hash of the id; one with fewer documents has all of its own,
    so a rare language is learnt from what there is. Of each, ``most_passages`` passages of ``passage_words`` words from
    anywhere in the text are drawn by tasks, so the driver gets no whole text, and ``sequences`` training sequences are
    made of these. Of rows that repeat an id the least passages and language count.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(learnable())
    languages = max(1, known.select("lang").distinct().count())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    ranked = known.select("doc_id", "lang").withColumn("rank", F.row_number().over(order))
    # a list of ids of bounded size, broadcast to the scan of the texts
    chosen = ranked.where(F.col("rank") <= max(1, train_docs // languages)).select("doc_id").distinct()

    @F.pandas_udf("array<string>")
    def drawn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: passages(t, most_passages, passage_words))

    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.struct(drawn("text").alias("p"), "lang").alias("row"))
    rows = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*").collect()
    return trained([(r["p"], r["lang"]) for r in rows], sequences)


def label_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, and the expected share of each language's words in ``shares``.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learnt. Other columns are
    not read; repeated rows are labelled each for itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS x languages weights and the word lists

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            split = [words_of(t) if t and LETTER.search(t) else [] for t in texts]
            some = [i for i, ws in enumerate(split) if ws] if k else []
            names, scores, shares = ["und"] * len(texts), [0.0] * len(texts), [[0.0] * k for _ in texts]
            if some:
                words = [w for i in some for w in split[i]]
                starts = np.cumsum([0, *(len(split[i]) for i in some[:-1])])
                first = np.zeros(len(words), bool)
                first[starts] = True
                scores_, lettered = model.looked_up(words)
                p = model.marginals(scores_, first)
                total = np.add.reduceat(p * lettered[:, None], starts, axis=0)
                total /= total.sum(axis=1, keepdims=True)
                for i, row in zip(some, total):
                    best = int(np.argmax(row))
                    names[i], scores[i], shares[i] = model.languages[best], float(row[best]), row.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], names=["id", "lang_pred", "score", "shares"])

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, "id long, lang_pred string, score double, shares array<double>")
    return found.withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = label_documents(docs.drop("lang"), fit(docs))
    return labelled.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")
