"""The corpus operators against plain versions, on a table that has every awkward case."""

from __future__ import annotations

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curation.llm import bpe_counts, exact_dedup, fingerprints, language_id, near_dedup, packing, piece_codec, quality, registry, substring_dedup, warc
from curation.llm.common import shared_dir
from tests.compare import DATA, check
from tests.llm import cases

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    check(spark, registry.QUERIES, registry.ORACLES, name)


def test_exact_duplicates(docs, rows, empty):
    got = exact_dedup.exact_duplicates(docs, digest_all=True).collect()
    by_text: dict = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", []).append(i)
    want = sorted((i, max(by_text[t or ""]), len(by_text[t or ""]), i == max(by_text[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["full_hash"]) for r in got) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {x[0] for x in want if x[3]}


def test_equal_prefixes_and_lengths_are_told_apart(spark):
    texts = ["p" * 100 + c for c in "aabbc"] + ["q" * 101]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 3, 2), (3, 3, 2), (4, 4, 1), (5, 5, 1)]


def test_token_counts_are_the_library_s(docs, rows, empty):
    library = tokenizers.Tokenizer.from_file(WORDS)
    got = bpe_counts.count_tokens(docs, WORDS).collect()
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert bpe_counts.count_tokens(empty, WORDS).count() == 0


def test_heap_merging_on_odd_texts():
    with open(WORDS, encoding="utf-8") as f:
        counter = bpe_counts.WordCounts(json.load(f))
    library = tokenizers.Tokenizer.from_file(WORDS)
    for text in ["it's we'll I'VE don't", "a\x1cb \x85 c\xa0d", "ΑΣ ΣΑΣ İstanbul", "１２３ ½ 12,345", "😀😀 a😀b", "​foo ﻿bar", "é é", "aaaaaaaaaaaaaaaa", "<|endoftext|><|startoftext|>"]:
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_code_points_newer_than_python_s_tables_are_cut_as_the_library_does():
    draw = random.Random(1)
    newer = [chr(c) for c in (0xA7CB, 0x1C89, 0xA7DA, 0x10D50, 0x378, 0x16D40)]
    pool = [*newer, *"aB é ΣΐÄßİǅﬁ'’sS\n\t12½😀 中日 \x85\xa0\u200b", *(chr(draw.choice([*range(0x20, 0xD800), *range(0xE000, 0x30000)])) for _ in range(300))]
    texts = [*newer, *("".join(draw.choices(pool, k=draw.randint(0, 14))) for _ in range(3000))]
    want = [e.ids for e in tokenizers.Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    with open(WORDS, encoding="utf-8") as f:
        counter = bpe_counts.WordCounts(json.load(f))
    assert [counter.text(t) for t in texts] == [len(ids) for ids in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.DocumentIds(WORDS).batch(texts)] == want


def test_a_cache_of_words_is_as_large_as_asked_for(monkeypatch):
    """Words that come again go to the library again only where the cache is too small for them; the ids are the same."""
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x, é{i}." for i in range(at, at + 60)) for at in (*range(0, 600, 60), *range(0, 600, 60))]
    merged, asked, found = packing.DocumentIds.merged, [], []
    monkeypatch.setattr(packing.DocumentIds, "merged", lambda self, pieces: (asked[-1].extend(pieces), merged(self, pieces))[1])
    for most in (100, 100_000):
        ids = packing.DocumentIds(WORDS, most)
        asked.append([])
        found.append([ids.batch([t])[0] for t in texts])
    want = [packing.DocumentIds(WORDS).library(t) for t in texts]
    assert found == [want, want]
    assert len(asked[0]) > len(asked[1]) == len(set(asked[1]))


def test_packing_places_every_id_once(docs, rows, empty):
    library = tokenizers.Tokenizer.from_file(WORDS)
    pieces = packing.pack_documents(docs, WORDS, pool_tokens=20_000).collect()
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    copies: dict = {}
    for i, t, *_ in rows:
        copies.setdefault(i, []).append(np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert set(by_doc) == set(copies)
    for i, found in by_doc.items():
        ids = copies[i][0]
        assert sum(p["length"] for p in found) == len(ids) * len(copies[i])
        for p in found:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_longest_documents_are_spread():
    pieces, sizes = packing.packed([3000, 3000, 500, 500, 500, 500, 96, 96])
    assert sorted(sizes) == [4096, 4096] and len({p[3] for p in pieces if p[2] == 3000}) == 2


def test_fingerprints(docs, rows, empty):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    texts = [r[1] or "" for r in rows]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    got = sorted(fingerprints.with_edited_fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_chars"]) for r in got] == [(r[0], len(t)) for r, t in zip(rows, texts)]
    assert sorted(r["edited_sha256"] for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in edited)

    def likeness(a: str, b: str) -> float:
        a, b = ({*zip(*(w[j:] for j in range(5)))} if len(w) >= 5 else {tuple(w)} - {()} for w in (a.encode().split(), b.encode().split()))
        return len(a & b) / len(a | b) if a | b else 1.0

    prints: dict = {}
    for r, t, e in zip(got, texts, edited):
        if texts.count(t) == 1:
            assert abs(r["near_edited"] - likeness(t, e)) < 0.2
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.with_edited_fingerprints(empty).count() == 0
    assert fingerprints.with_edited_fingerprints(docs.where("text like 'one two'")).first()["near_next"] == 1.0


def test_sketches_merge_and_estimate(spark):
    parts = spark.createDataFrame([("k", " ".join(f"w{i}" for i in range(a, b))) for a, b in ((0, 600), (500, 1200), (900, 1500))] + [("none", None)], "key string, text string")
    sketches = fingerprints.with_sketch(parts)
    merged = {r["key"]: r for r in fingerprints.merged_by(sketches, "key").withColumn("n", fingerprints.distinct_shingles(F.col("sketch"))).collect()}
    assert abs(merged["k"]["n"] - 1488) < 400
    a, b = (sketches.where(F.col("text").startswith(x)).select("sketch").first()[0] for x in ("w0 ", "w500 "))
    both = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b"))).first()
    assert abs(both[0] - 96 / 1192) < 0.1 and abs(both[1] - 96 / 596) < 0.15


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_lose_no_link(docs, rows, empty, size, percent):
    got = near_dedup.near_duplicates(docs, shingle_words=size, percent=percent).collect()
    want = cases.linked(rows, size, percent)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(docs, shingle_words=size, percent=percent)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, x in want.items() if x[2]}


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("one_sided", [True, False])
def test_keys_meet_for_sets_at_the_threshold(percent, one_sided):
    """The least alike sets that are still linked: the smaller within the larger, or elements of each that the other lacks."""
    draw, keys = np.random.default_rng(3), near_dedup.Keys(percent, *near_dedup.banding(percent))
    for n in (5, 7, 8, 13, 20, 40, 64, 65, 100, 128, 129, 300, 1000):
        gone = (100 - percent) * n // 100 if one_sided else (100 - percent) * n // (100 + percent)
        for _ in range(60):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            new = draw.integers(0, 1 << 63, 0 if one_sided else gone, dtype=np.uint64)
            b = np.unique(np.concatenate([a[draw.permutation(n)[gone:]], new]))
            shared = len(np.intersect1d(a, b))
            assert 100 * shared >= percent * (len(a) + len(b) - shared)
            assert set(keys.of(a)) & set(keys.of(b)), n
            flips = np.unpackbits((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint8)).sum()
            assert flips <= len(a) + len(b) - 2 * shared


@pytest.mark.parametrize("percent", [80, 85])
def test_keys_are_lost_by_chance_below_the_stated_one(percent):
    rows, bands = near_dedup.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS and rows * bands <= near_dedup.BINS
    keys = near_dedup.Keys(percent, rows, bands)
    for low, high, n in zip([0, *keys.levels], keys.levels, keys.deals):
        assert near_dedup.deal_miss(percent, low, high) ** n <= near_dedup.MISS
    draw = np.random.default_rng(5)
    for _ in range(30_000 if percent == 80 else 0):
        s = draw.integers(0, 1 << 63, 5, dtype=np.uint64)
        assert set(keys.of(np.sort(s[:4]))) & set(keys.of(np.sort(s)))


def test_members_of_a_hot_bucket_do_not_meet_in_pairs(spark):
    """Unlinked texts with a common phrase share buckets; the rows that are joined grow as their number does."""
    def joined(n: int) -> int:
        texts = [(i, "one two three four five six seven eight " + " ".join(f"w{i}x{k}" for k in range(4))) for i in range(n)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        sig = near_dedup.signatures(docs, "doc_id", "text", 3, 85, *near_dedup.banding(85))
        buckets = sig.select("id", F.explode("keys").alias("key")).groupBy("key").count()
        assert buckets.agg(F.max("count")).first()[0] > n / 20
        rare = near_dedup.rare_shingles(sig.select("id", F.col("id").alias("component")), docs, "doc_id", "text", 3, 85, n)
        met = rare.groupBy("shingle").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        got = near_dedup.near_duplicates(docs, shingle_words=3, percent=85)
        assert got.where("kept").count() == n
        return met + n * near_dedup.STRANGERS

    assert joined(5000) <= 6 * joined(1000)


def test_linked_members_of_a_hot_bucket_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STRANGERS", 0)
    draw = random.Random(8)
    phrase = "one two three four five six seven eight"
    rows = []
    for i in range(0, 300, 3):
        own = [f"w{i}x{k}" for k in range(40)]
        rows += [(i + j, f"{phrase} {' '.join(w if draw.random() > 0.01 * j else 'z' for w in own)}", "", "", 0, "", "") for j in range(3)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle_words=3, percent=85).collect()}
    assert got == cases.linked(rows, 3, 85)


def test_rows_of_one_id_are_one_node(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a), (2, a + " more"), (3, b), (2, b + " more"), (4, b), (5, "other words here"), (None, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=3, percent=85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (5, 5)]


def test_components_follow_long_chains(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 900), (900, 8), (50, 50)]
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, 8: 7, 900: 7}


@pytest.mark.parametrize("share", [1, 40, substring_dedup.SHARE])
def test_repeated_passages_go(docs, rows, empty, share):
    """With no, some and all repeated windows in the broadcast shard."""
    spans = {r["id"]: r["spans"] for r in substring_dedup.repeated_spans(docs, share=share).collect()}
    for i, (n, gone, digest) in cases.removed(rows).items():
        words = next((r[1] or "") for r in rows if r[0] == i).encode().split()
        keep = substring_dedup.kept_mask(n, [x.asDict() for x in spans.get(i, [])])
        left = [w for w, k in zip(words, keep) if k]
        assert (n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()) == (gone, digest), i
    assert substring_dedup.repeated_spans(empty).count() == 0
    cut = substring_dedup.drop_repeated_passages(docs, window=13)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_matching_statistics():
    automaton = substring_dedup.SuffixAutomaton([b"a b c d".split(), b"c d e a b".split()])
    assert list(automaton.matching(b"a b c d e a b x d e".split())) == [1, 2, 3, 4, 3, 4, 5, 0, 1, 2]
    assert automaton.spans(b"x a b c d e a b".split(), 4) == [(1, 8)]


def test_archives_come_back(spark, empty):
    html = "<p>" + "x" * 1500 + "é</p>"
    rows = [(1, "http://a/ b", html), (2, "http://a/c", html), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "http://n/", html), (2, "http://a/c", html), (6, "u\r\nX: y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("p"))
    root = shared_dir(spark)
    index = warc.write_archives(pages, root)
    got = warc.read_records(index, root).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    size = len(html.encode())
    assert kinds == [(0, "revisit", 2, size), (1, "revisit", 2, size), (2, "response", None, size), (2, "response", None, size), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0)]
    assert all(r["payload_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest() for r in got if r["payload"] is not None)
    assert warc.read_records(index.where("page_id = 4"), root).first()["payload"] == b"short"
    assert warc.read_records(warc.write_archives(pages.where("false"), shared_dir(spark)), root).count() == 0


def test_piece_codec_is_the_library_s(docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    decoded = piece_codec.decode_documents(piece_codec.encode_documents(docs, PIECES), PIECES).collect()
    want = sorted((i, library.encode(t) if t else []) for i, t, *_ in rows)
    assert sorted((r["doc_id"], list(r["ids"])) for r in decoded) == want
    assert sorted((r["doc_id"], r["text"]) for r in decoded) == sorted((i, t or "") for i, t, *_ in rows)
    assert piece_codec.encode_documents(empty, PIECES).count() == 0


def piece_model(pieces: list[tuple[str, float, int]], kind: int) -> bytes:
    """A model file written field by field: pieces with scores and types, the kind, byte fallback, no normalisation."""
    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def held(number: int, raw: bytes) -> bytes:
        return varint(number << 3 | 2) + varint(len(raw)) + raw

    out = b"".join(held(1, held(1, p.encode()) + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(t)) for p, score, t in pieces)
    return out + held(2, b"\x18" + varint(kind) + varint(35 << 3) + b"\x01") + held(3, held(1, b"identity") + b"\x20\x00")


def test_unigram_models_take_the_best_sum_of_scores(tmp_path):
    import sentencepiece

    draw = random.Random(4)
    normal = {p: -draw.uniform(1, 12) for p in [*"▁abcdé", *("▁" * draw.randint(0, 1) + "".join(draw.choices("abcd", k=draw.randint(2, 6))) for _ in range(300))]}
    bytes_ = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    model = tmp_path / "m.model"
    model.write_bytes(piece_model([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *bytes_, *((p, s, 1) for p, s in normal.items())], 1))
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=str(model)), piece_codec.Pieces(str(model))
    texts = [" ".join("".join(draw.choices("abcdéx日", k=draw.randint(1, 12))) for _ in range(draw.randint(1, 9))) for _ in range(400)] + ["", " ", "a  b ", " a"]
    assert [np.frombuffer(x, "<i4").tolist() for x in pieces.encode(texts)] == [library.encode(t) if t else [] for t in texts]
    assert [pieces.decode(np.frombuffer(x, "<i4")) for x in pieces.encode(texts)] == texts
    for kind, more in ((3, []), (1, [("a▁b", -1.0, 1)])):
        model.write_bytes(piece_model([("<unk>", 0.0, 2), *bytes_, ("a", -1.0, 1), *more], kind))
        with pytest.raises((ValueError, RuntimeError)):
            piece_codec.Pieces(str(model))


def test_quality_orders_held_out_texts(spark, docs, empty):
    scored = registry.QUERIES["op3_quality"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    weights = np.zeros(quality.WIDTH)
    assert {r["score"] for r in quality.score_texts(docs, weights).collect()} == {0.5}
    assert quality.score_texts(empty, weights).count() == 0
    assert not quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int")).any()


def test_risk_is_never_negative_and_separates():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(1.5, 1, (800, 3)), draw.normal(-1.5, 1, (400, 3))])
    x = np.c_[x, np.ones(len(x))]
    w = quality.fitted(x[:400], x[400:], 0.5)
    assert (quality.sigmoid(x[:800] @ w) > 0.5).mean() > 0.9 and (quality.sigmoid(x[800:] @ w) < 0.5).mean() > 0.9


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_is_estimated_without_negatives(share):
    draw = np.random.default_rng(2)

    def sample(n, mean):
        return np.c_[draw.normal(mean, 1, (n, 4)), np.ones(n)].astype(np.float32)

    n = 4000
    unlabelled = np.concatenate([sample(int(n * share), 1.5), sample(n - int(n * share), -1.5)])
    assert abs(quality.estimated_prior(sample(2000, 1.5), draw.permutation(unlabelled)) - share) < 0.06


def test_language_of_words_and_documents(spark, docs, rows, empty):
    found = registry.QUERIES["op9_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    texts = [("the cat and the dog sat on the mat " * 8, "en"), ("le chat et le chien sont sur le tapis " * 8, "fr")] * 6
    field = language_id.trained([(language_id.passages(t), lang) for t, lang in texts])
    words = ("the cat and the dog sat on the mat le chat et le chien sont sur le tapis").split()
    first = np.zeros(len(words), bool)
    first[0] = True
    p = field.marginals(field.looked_up(words)[0], first)
    assert [field.languages[i] for i in p.argmax(axis=1)] == ["en"] * 9 + ["fr"] * 9
    got = {r["doc_id"]: r for r in language_id.label_documents(docs, field).collect()}
    assert all((got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for i, t, *_ in rows)
    assert language_id.label_documents(empty, field).count() == 0
    assert {r["lang_pred"] for r in language_id.label_documents(docs, language_id.trained([])).collect()} == {"und"}


def test_language_reads_every_character_of_a_long_word(spark):
    w = "".join(chr(0x4E00 + i) for i in range(1000))
    for word in (w[:24], w[:25], w[:46], w[:47], w, "…" + w[:60] + "," + w[60:99] + "»", "." * 60, w[:22] + ".,;" + w[:30]):
        bare = word.strip(language_id.EDGE)
        parts = [p.strip(language_id.EDGE) for p in language_id.words_of(word)]
        grams = {bare[i : i + n] for n in (1, 2, 3) for i in range(len(bare) - n + 1)}
        assert grams <= {p[i : i + n] for p in parts for n in (1, 2, 3) for i in range(len(p) - n + 1)}
        assert all(len(p) <= language_id.SEGMENT + 2 for p in parts)
    en, fr = "thecatandthedogsatonthemat", "lechatetlechiensontsurletapis"
    field = language_id.trained([(language_id.passages(en * 6), "en"), (language_id.passages(fr * 6), "fr")] * 6)
    long = spark.createDataFrame([(1, en[:24] + fr * 20 + "mat"), (2, fr[:24] + en * 20 + "pis")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.label_documents(long, field).collect()} == {1: "fr", 2: "en"}


def test_blocks_give_the_plain_posteriors():
    draw = np.random.default_rng(1)
    k, sizes = 3, [1, 5, 70, 33]
    field = language_id.Field(list("abc"), {}, np.zeros((1, k)), draw.normal(size=(k, k)))
    unary = draw.normal(size=(sum(sizes), k))
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, at, step = field.marginals(unary, first), 0, np.exp(field.transitions)
    for n in sizes:
        e = np.exp(unary[at : at + n])
        a, b = [e[0]], [np.ones(k)]
        for t in range(1, n):
            a.append((a[-1] @ step) * e[t])
            b.append(step @ (e[n - t] * b[-1]))
        p = np.array(a) * np.array(b[::-1])
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_rows_without_id_and_clashing_columns(spark):
    """A null id is handed through, or stands before all others; a column named like a result is replaced by it."""
    rows = [(None, "der Hund und die Katze", 7, 0.5, "x"), (2, None, 7, 0.5, "x"), (None, None, 7, 0.5, "x"), (1, "the dog and the cat", 7, 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, score double, lang_pred string")
    library = tokenizers.Tokenizer.from_file(WORDS)
    counted = bpe_counts.count_tokens(docs, WORDS)
    assert sorted(counted.columns) == sorted([*docs.columns, "n_bytes", "over_limit"])
    assert sorted(r["n_tokens"] for r in counted.collect()) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    scored = quality.score_texts(docs, np.zeros(quality.WIDTH))
    assert scored.columns == docs.columns and [r["score"] for r in scored.collect()] == [0.5] * 4
    field = language_id.trained([(["der hund und die katze"] * 3, "de"), (["the dog and the cat"] * 3, "en")])
    labelled = language_id.label_documents(docs, field)
    assert labelled.columns == ["doc_id", "lang_pred", "score", "shares"]
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in labelled.collect()) == [(0, "de"), (0, "und"), (1, "en"), (2, "und")]
    encoded = piece_codec.encode_documents(docs, PIECES).collect()
    assert sorted((r["doc_id"] or 0, bool(r["ids"])) for r in encoded) == [(0, False), (0, True), (1, True), (2, False)]
    prints = fingerprints.with_edited_fingerprints(docs).collect()
    assert len(prints) == 4 and sorted(r["n_chars"] for r in prints) == [0, 0, 19, 22]
    # an empty text follows, so nothing takes the place of the last nine characters
    assert [r["edited_sha256"] for r in prints if r["doc_id"] == 1] == [hashlib.sha256(b"the dog an").hexdigest()]


def test_a_word_is_read_once_whatever_signs_stand_around_it(monkeypatch):
    read, features = [], language_id.word_features
    draw = np.random.default_rng(3)
    field = language_id.Field(["a", "b"], {"und": 0}, draw.normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.zeros((2, 2)))
    words = ["und", "und,", "(und)", "...", "été", "été!", "x", "\0langes\0", "12", "und"]
    want = [field.weights[np.asarray(features(w, field.lists))].sum(axis=0) for w in words]
    monkeypatch.setattr(language_id, "word_features", lambda w, lists: (read.append(w), features(w, lists))[1])
    for _ in range(2):
        scores, lettered = field.looked_up(words)
        assert np.allclose(scores, want, atol=1e-4) and lettered.tolist() == [1, 1, 1, 0, 1, 1, 1, 1, 0, 1]
    assert sorted(read) == sorted(["und", "", "été", "x", "\0langes\0", "12"])
