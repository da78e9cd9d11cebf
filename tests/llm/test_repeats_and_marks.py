"""Ids with several texts, code points that tokenizer tables differ on, rare languages, and recall at the threshold."""

from __future__ import annotations

import json
import random
import unicodedata
import zlib

import numpy as np
import pytest

import corpus_pipeline
from curation.llm import bpe_counts, language_id, near_dedup, packing, quality, substring_dedup
from curation.llm.common import small_batches

W60, V20 = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 60), ("v", 20)))


@pytest.mark.parametrize("share", [1, 16, substring_dedup.SHARE])
def test_texts_of_one_id_lose_nothing_to_each_other(spark, share):
    small_batches(spark)
    rows = [(1, W60), (1, "short text"), (2, "x y " + W60), (2, W60 + " tail"), (3, "short text " + V20), (3, "z " + V20), (4, V20 + " end"), (None, W60), (5, None)]
    found = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), share=share).collect()
    removed = sorted((r["id"], sorted({k for x in r["spans"] for k in range(x["s"], x["e"])})) for r in found)
    assert removed == [(2, [*range(60)]), (2, [*range(2, 62)]), (4, [*range(20)])]


def test_passages_go_from_each_text_of_an_id(spark):
    small_batches(spark)
    rows = [(1, W60), (1, "short text"), (2, "x y " + W60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) as long) as n_chars")
    cut = substring_dedup.drop_repeated_passages(docs)
    assert sorted((r["doc_id"], r["text"]) for r in cut.collect()) == [(1, "short text"), (1, W60), (2, "x y")]
    staged = corpus_pipeline.substring_stage(spark, docs, "")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in staged.collect()) == [(1, "short text", 10), (1, W60, len(W60)), (2, "x y", 3)]


def test_all_combining_marks_are_counted_and_packed_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    draw, marks = random.Random(3), [chr(i) for i in range(128, 0x110000) if unicodedata.combining(chr(i)) or unicodedata.category(chr(i))[0] == "M"]
    texts = [f"S\U00011d45́"] + ["".join(f"{draw.choice(['S', 'a', 'é', 'ह', ' '])}{c}{draw.choice(marks)}́" for _ in range(2)) for c in marks]
    texts += [f"S{c}́ a{c}̴" for c in marks]
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        counts = bpe_counts.WordCounts(json.load(f))
    assert [t for t, ids in zip(texts, want) if counts.text(t) != len(ids)] == []
    own = packing.ids_of(path)
    got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 256) for x in own.batch(texts[at : at + 256])]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_a_language_of_three_documents_among_thousands_is_learnt(spark):
    small_batches(spark)
    draw = random.Random(1)
    words = {lang: ["".join(draw.choices(letters, k=draw.randint(3, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefghijklm"), ("bb", "nopqrstuvwxyz"), ("cc", "αβγδεζηθικλμ"))}
    held = [i for i in range(60_000, 61_000) if zlib.crc32(b"%d" % i) % 4 == 2][:20]
    rare = [i for i in range(50_000, 51_000) if zlib.crc32(b"%d" % i) % 4 != 2][:3]
    rows = [(i, " ".join(draw.choices(words["ab"[i % 2] * 2], k=60)), "ab"[i % 2] * 2) for i in range(5000)]
    rows += [(i, " ".join(draw.choices(words["cc"], k=60)), "cc") for i in held + rare]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.label_documents(docs, language_id.fit(docs, train_docs=300)).collect()}
    assert all(found[i] == "cc" for i in held)


def test_of_a_repeated_id_the_least_passages_count(spark):
    a, b, c = [i for i in range(1, 50) if zlib.crc32(b"%d" % i) % 4 != 2][:3]
    docs = [(a, "zz zz zz", "b"), (a, "aa aa aa", "a"), (b, "yy yy yy", "b"), (c, "ab ba ab", "a")]
    models = [language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")) for rows in (docs, docs[::-1], docs[1:])]
    assert all((m.weights == models[0].weights).all() and m.languages == ["a", "b"] for m in models)


def test_empty_texts_score_one_half_under_any_model(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, np.ones(quality.WIDTH)).collect()}
    assert scores[1] == scores[2] == 0.5 < scores[3]


@pytest.mark.parametrize("percent", [85, 80])
def test_larger_sets_at_the_threshold_share_bands_as_if_bins_were_independent(percent):
    """Of 129 to 400 shingles, where some bins are borrowed: the bands that two sets share at the threshold have the mean of
    independent bins, and hardly more spread, so none in common stays as unlikely as stated."""
    rows, bands = near_dedup.banding(percent)
    keys, draw = near_dedup.Keys(percent, rows, bands), np.random.default_rng(1)
    p = (percent / 100) ** rows
    for n in (129, 200, 300, 400):
        both = -(-percent * 2 * n // (100 + percent))
        shared = []
        for _ in range(1500):
            x = draw.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))
            shared.append(int((keys.banded(a) == keys.banded(b)).sum()))
        assert min(shared) > 0 and np.mean(shared) > 0.97 * bands * p and np.var(shared) < 1.35 * bands * p * (1 - p)


def test_texts_hashed_together_have_the_sets_of_each_alone(monkeypatch):
    draw = random.Random(6)
    texts = [None, b"", b"one", b"one two", b"A b c d e", *(" ".join(draw.choices("abcde", k=draw.randint(0, 40))).encode() for _ in range(200))]
    for size in (1, 3, 5):
        alone = [near_dedup.shingle_sets([t], near_dedup.WordHashes(), size)[0] for t in texts]
        for words in (1, 50, 1 << 15):
            monkeypatch.setattr(near_dedup, "RUN_WORDS", words)
            together = near_dedup.shingle_sets(texts, near_dedup.WordHashes(), size)
            assert len(together) == len(texts) and all((a == b).all() and len(a) == len(b) for a, b in zip(alone, together))
        counted = [len({tuple((t or b"").lower().split()[i : i + size]) for i in range(max(1, len((t or b"").split()) - size + 1))}) if (t or b"").split() else 0 for t in texts]
        assert counted == [len(s) for s in alone]
