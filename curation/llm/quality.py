"""Quality scores by positive-unlabelled learning: a linear model minimises the non-negative unbiased risk.

Trusted positives and unlabelled web text are bounded samples; the class prior is estimated from the two. A text's features are
the shares of its byte classes and of their pairs, so the model sees how a text is written and never what it says,
nor its id, language or source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import small_batches, table

#: Bounds of the samples that the model is fitted on, in rows, arguments of ``fit``: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 6000, 12000
THRESHOLD = 0.7
STEPS, RATE, DECAY = 500, 0.05, 1e-4


def byte_classes() -> np.ndarray:
    """Class of each byte: control, blank, line end, digit, upper, lower, high, and each other ASCII sign by itself."""
    of = np.zeros(256, np.int64)
    of[[9, 11, 12, 32]], of[[10, 13]] = 1, 2
    of[48:58], of[65:91], of[97:123], of[128:] = 3, 4, 5, 6
    signs = [b for b in range(33, 127) if not of[b]]
    of[signs] = 7 + np.arange(len(signs))
    return of


CLASSES = byte_classes()
N = int(CLASSES.max()) + 1
WIDTH = N + N * N + 10


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte classes and of pairs, measures of repetition and of length; zeros if there is no text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    code = CLASSES[np.frombuffer(text.encode(), np.uint8)]
    one = np.bincount(code, minlength=N)
    out[:N] = np.sqrt(one / len(code))
    if len(code) > 1:
        out[N : N + N * N] = np.sqrt(np.bincount(code[:-1] * N + code[1:], minlength=N * N) / (len(code) - 1))
    blanks, lines = one[1] + one[2], one[2] + 1
    words = text.split()
    counts = Counter(words)
    n = max(len(words), 1)
    again = sum(map(eq, words, words[1:])) / n
    marked = sum(not w[-1].isalnum() for w in words) / n
    out[-10:-4] = again, again**0.5, max(counts.values(), default=0) / n, len(counts) / n, marked, min(1.0, len(counts) / n**0.8)
    out[-4:] = 1, np.log1p(len(code)) / 10, min(1.0, len(code) / (10.0 * (blanks + 1))), np.log1p(len(code) / lines) / 10
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk: prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]), logistic loss.

    Where the second part has gone below zero the step instead raises it, which keeps the model from learning the
    trusted positives by heart.
    """
    seen = (positive != 0).any(axis=0) | (unlabelled != 0).any(axis=0)
    positive, unlabelled = (np.ascontiguousarray(x[:, seen], np.float32) for x in (positive, unlabelled))
    w, m, v = (np.zeros(positive.shape[1], np.float32) for _ in range(3))
    for step in range(1, STEPS + 1):
        p, u = positive @ w, unlabelled @ w
        gap = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        gain = unlabelled.T @ sigmoid(u) / len(u) - prior * (positive.T @ sigmoid(p)) / len(p)
        g = (prior * (positive.T @ (sigmoid(p) - 1)) / len(p) + gain if gap >= 0 else -gain) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(RATE) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(len(seen))
    weights[seen] = w
    return weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, weight: float = 0.01) -> float:
    """The share of positives among the unlabelled texts, by best-bin estimation; no negative is needed.

    A model that tells one half of the positives from one half of the unlabelled texts scores the other halves. Above
    a score nearly all are positives if the score is well chosen, so there the unlabelled share over the positives'
    share is the prior; the score is the one with the least upper confidence bound. Both halves take each part once.
    """
    found = []
    for half in (0, 1):
        w = fitted(positive[half::2], unlabelled[half::2], 0.5)
        p, u = np.sort(positive[1 - half :: 2] @ w), np.sort(unlabelled[1 - half :: 2] @ w)
        if not len(p) or not len(u):
            continue
        cuts = u[u <= p[-1]] if u[0] <= p[-1] else u[:1]
        above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
        slack = (1 + weight) * np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
        found.append(above_u[best] / max(above_p[best], 1e-9))
    return float(np.clip(np.mean(found), 0.05, 0.95)) if found else 0.5


def learnable(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled_rows: int = UNLABELLED) -> np.ndarray:
    """Weights from at most ``positives`` trusted rows and ``unlabelled_rows`` rows of ``docs``, taken in the order of a hash.

    Only rows outside the held-out quarter are read; of labels, only which rows are good. Rows that repeat an id count
    once. Without positives all weights are 0 and every score 0.5.
    """
    good = labels.where("doc_id is not null and quality = 1").where(learnable()).groupBy("doc_id").agg(F.lit(1).alias("_one"))
    # two id lists of bounded size, broadcast to the scan of the texts
    trusted = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    web = docs.where("doc_id is not null").where(learnable()).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled_rows)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.float16).tobytes())

    def sample(ids: DataFrame) -> np.ndarray:
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", packed("text").alias("x"))
        found = rows.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
        return np.frombuffer(b"".join(r["x"] for r in found), np.float16).reshape(-1, WIDTH)

    positive, unlabelled = sample(trusted), sample(web)
    weights = np.zeros(WIDTH)
    if len(positive) and len(unlabelled):
        # most pairs of byte classes never occur; only the others are widened
        seen = (positive != 0).any(axis=0) | (unlabelled != 0).any(axis=0)
        positive, unlabelled = (np.ascontiguousarray(x[:, seen], np.float32) for x in (positive, unlabelled))
        weights[seen] = fitted(positive, unlabelled, estimated_prior(positive, unlabelled))
    return weights


def score_texts(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; null and empty texts have no feature and score 0.5 under any model.

    A column named ``out`` is replaced; repeated rows get equal scores; an empty table gives none.
    """
    held = np.asarray(weights, np.float32)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, WIDTH), np.float32)
            yield pd.Series(sigmoid((x @ held).astype(np.float64)))

    return docs.withColumn(out, score(F.col(text_col)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(~learnable(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
