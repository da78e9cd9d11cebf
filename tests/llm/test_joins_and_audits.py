"""The Jaccard join, the divergence audit and the clustering against plain versions, and their awkward cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curation.llm import centroids, divergence, jaccard_join
from curation.llm.common import small_batches, written
from tests.compare import DATA
from tests.llm import cases


def joined(df, **options) -> set:
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df, **options).collect()}


def expected(rows, size: int = 5, percent: int = 80) -> set:
    return {(i, n, c) for i, (n, c, _) in cases.linked(rows, size, percent).items()}


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (2, 60), (3, 90)])
def test_join_finds_the_links_of_all_pairs(spark, size, percent):
    small_batches(spark, 16)
    rows = cases.documents()
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumn("key", F.lit("k")).withColumn("component", F.lit(1)).repartition(3)
    assert joined(docs, shingle_words=size, percent=percent) == expected(rows, size, percent)
    assert joined(docs.where("false")) == set()


def test_join_on_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert joined(docs) == expected([tuple(r) for r in docs.collect()])


def short_texts(n: int = 500) -> list[tuple]:
    """Texts of 5 to 13 words, most of which share a line: its shingles are common, and lists of them long."""
    draw = random.Random(3)
    line = [f"c{i}" for i in range(8)]
    tails = ["".join(draw.choices("xyz", k=3)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = line[: draw.randint(3, 8)] + draw.choices(tails, k=draw.randint(1, 4)) if i % 4 else draw.choices(tails[:3], k=draw.randint(2, 9))
        rows.append((i + 1, " ".join(words)))
    return rows


def test_light_sets_are_enumerated_where_lists_cost_more(spark):
    rows, costs = short_texts(), {}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 2):
        assert joined(docs, shingle_words=size, costs=costs) == expected(rows, size)
        assert costs["boundary"] >= 5


def test_crowded_lists_are_split(spark, monkeypatch):
    """Unlinked texts that share their common shingles: with few strangers allowed, lists are split twice."""
    monkeypatch.setattr(jaccard_join, "STRANGERS", 0)
    monkeypatch.setattr(jaccard_join, "LIGHT_MOST", 0)
    draw = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = [(i + 1, " ".join(w if draw.random() < 0.9 else f"{w}{draw.randint(0, 2)}" for w in base)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 2):
        assert joined(docs, shingle_words=size) == expected(rows, size)


def test_subset_sizes_are_those_that_links_need():
    for percent in (60, 80, 90):
        for n in range(2, 14):
            for m in range(2, 14):
                for both in range(min(n, m) + 1):
                    if (n, m) != (1, 1) and 100 * both >= percent * (n + m - both):
                        need = -(-percent * (n + m) // (100 + percent))
                        assert need <= both and need in jaccard_join.subset_sizes(n, percent) and need in jaccard_join.subset_sizes(m, percent)


def test_join_of_repeated_and_missing_ids(spark):
    """A repeated id is one node with all of its texts; a row without id is alone unless something equals it."""
    draw = random.Random(2)
    a, b = (" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(2))
    rows = [(1, a), (2, b), (3, a + " x"), (3, b + " y"), (None, a), (None, "alone " + b[:30]), (5, None), (6, " ")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (3, 1), (None, 1), (None, None), (5, 5), (6, 6)], key=str)


def audit(rows: list[tuple], least: int, top: int) -> set:
    """(lang, source, text) rows -> the audit's rows, by dictionaries."""
    letters = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
    held = defaultdict(Counter)
    docs_of, groups = defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", (text or "").encode()
        groups.add((lang, source))
        words = bytes(b if b in letters else 32 for b in text).lower().split()
        held[lang, source].update(words)
        docs_of[lang].update(set(words))
    kept = {lang: [w for w, n in c.items() if n >= least] for lang, c in docs_of.items()}

    def shares(counts: Counter, lang: str) -> dict:
        total = sum(counts[w] for w in kept[lang])
        return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept[lang])) for w in kept[lang]}

    p = {g: shares(held[g], g[0]) for g in groups}
    q = {lang: shares(sum((held[g] for g in groups if g[0] == lang), Counter()), lang) for lang in kept}
    out = set()
    for g in groups:
        pair = [(sum(abs(p[g][w] - p[h][w]) for w in kept[g[0]]), h[1].encode()) for h in groups if h[0] == g[0] and h != g]
        term = [(p[g][w] - q[g[0]][w], w) for w in kept[g[0]] if held[g][w] and p[g][w] > q[g[0]][w]]
        for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (-x[0], x[1]))[:top])):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1])), 1):
                out.add((*g, part, item.decode(), value, rank))
    return out


def test_audit_matches_dictionaries(spark):
    draw = random.Random(9)
    words = ["The", "of", "naïve", "日本", "x1y", "don't", "ÀB", "z", "\x00q", "[k]"] + ["".join(draw.choices("abcd", k=3)) for _ in range(60)]
    rows = [(draw.choice(["en", "fr", None]), draw.choice(["s", "t", "u", "v", None]), " ".join(draw.choices(words, k=draw.randint(0, 30)))) for _ in range(150)]
    rows += [("xx", "only", None), ("xx", "other", ""), ("en", "empty", None), ("en", "s", "long " + "of " * 20000), *rows[:5]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("slot", F.lit(2)).repartition(4)
    want = audit(rows, 5, 7)

    def got(**options):
        return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(docs, least=5, top=7, **options).collect()}

    assert got() == want
    assert got(shard_terms=7, pass_bytes=2000) == want  # many shards, read in several passes
    assert divergence.divergence(docs.where("false")).count() == 0


def test_audit_with_small_tiles_and_tables(spark, monkeypatch):
    for name, value in {"TILE": 2, "BLOCK_BITS": 2, "TABLE_TERMS": 20, "SLOT_BYTES": 500}.items():
        monkeypatch.setattr(divergence, name, value)
    small_batches(spark, 8)
    draw = random.Random(1)
    rows = [("en", f"s{draw.randint(0, 6)}", " ".join("".join(draw.choices("abc", k=2)) for _ in range(20))) for _ in range(90)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(docs, least=3, top=4).collect()}
    assert got == audit(rows, 3, 4)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    for n in (1, 2, 63, 5000):
        keys = [b"k%d" % i for i in range(n)]
        found = divergence.PerfectHash(keys)
        assert sorted(found.slots(keys).tolist()) == list(range(n)) == list(range(len(found)))
        assert (found.slots([b"other%d" % i for i in range(2000)]) == -1).all() and len(found.slots([])) == 0


def clustered(rows: list[tuple], k: int, rounds: int) -> dict:
    """Lloyd's rounds in plain loops: row number -> (cluster, distance); and the centroids."""
    kept = {n: [int(np.floor(64 * np.float64(x))) for x in v] for n, (_, v) in enumerate(rows) if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)}
    order = sorted(kept, key=lambda n: (rows[n][0] is None, hashlib.sha256(b"1:%d" % (rows[n][0] or 0)).hexdigest(), kept[n]))
    centres = [kept[n] for n in order[:k]]

    def nearest() -> dict:
        return {n: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres)) for n, v in kept.items()}

    for _ in range(rounds):
        found = nearest()
        for i in range(len(centres)):
            own = [kept[n] for n, (_, c) in found.items() if c == i]
            if own:
                centres[i] = [sum(x) // len(own) for x in zip(*own)]
    return {n: (c, d) for n, (d, c) in nearest().items()}, centres


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_clusters_are_those_of_plain_loops(spark, share):
    draw = np.random.default_rng(5)
    middles = draw.normal(0, 0.4, (6, 64))
    vectors = [(int(i), (middles[i % 6] + draw.normal(0, 0.12, 64)).astype(np.float32).tolist()) for i in range(240)]
    odd = [(900, None), (901, [0.5] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (None, [0.25] * 64), (905, [9.0] * 64)]
    rows = vectors + odd + [vectors[3], vectors[3], (7, vectors[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(0)).withColumn("cells", F.lit("c")).repartition(3)
    counts: list = []
    found, centres = centroids.cluster_vectors(df, rounds=4, fetch_share=share, fetch_counts=counts)
    want, want_centres = clustered(rows, 16, 4)
    assert centres.tolist() == want_centres and len(counts) == 3
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == sorted((str(rows[n][0]), *x) for n, x in want.items())


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64), (3, None)], "vec_id long, embedding array<float>")
    found, centres = centroids.cluster_vectors(df)
    assert sorted((r["vec_id"], r["distance"]) for r in found.collect()) == [(1, 0), (2, 0)] and len(centres) == 2
    assert centroids.cluster_vectors(df.where("false"))[0].count() == 0
    with pytest.raises(Exception, match="not supported"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>"))


def test_intervals_never_rule_out_the_nearest():
    draw = np.random.default_rng(2)
    v = np.rint(draw.normal(0, 8, (500, 64))).astype(np.int64)
    grid = centroids.Grid(v.min(axis=0), v.max(axis=0), v.mean(axis=0), v.std(axis=0))
    cells = grid.cells(v)
    assert (centroids.unpacked(centroids.packed(cells), 64) == cells).all()
    tables = centroids.Intervals(grid, v[:16])
    distance = ((v[:, None, :] - v[None, :16]) ** 2).sum(axis=2)
    possible = tables.possible(cells)
    assert possible[distance == distance.min(axis=1, keepdims=True)].all()
    cluster, best = tables.nearest(possible, v)
    assert (cluster == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_long_texts_are_told_apart_by_wide_bitmaps(spark, monkeypatch):
    """Texts of more shingles than the common bitmap has bits: linked ones are found, and most others never confirmed."""
    monkeypatch.setattr(jaccard_join, "WIDE_FROM", 100)
    draw = random.Random(8)
    line = [f"l{i}" for i in range(1500)]
    rows = []
    for i in range(24):
        own = [f"w{i % 8}x{k}" for k in range(1600)]
        words = line + own if i % 2 else own + line
        rows.append((i + 1, " ".join(w if draw.random() < 0.97 else "z" for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, shingle_words=1) == expected(rows, 1)
    assert joined(docs) == expected(rows)


def test_join_brings_no_more_than_sizes_to_the_driver_as_rows(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, taken = type(docs).collect, []

    def collect(self):
        taken.append(real(self))
        return taken[-1]

    monkeypatch.setattr(type(docs), "collect", collect)
    out = jaccard_join.jaccard_join(docs)
    monkeypatch.undo()
    assert max(map(len, taken)) <= jaccard_join.LIGHT_MOST
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(i, i // 2 * 2) for i in range(40)}


def test_join_broadcasts_no_side_by_the_size_of_its_files(spark, monkeypatch):
    """A million rows of 16 MB in files of a few KB."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    small = written(spark.range(1 << 20).select(F.lit(7).cast("long").alias("id"), F.lit(8).cast("long").alias("component")))
    before, real, plans = [spark.conf.get(n, None) for n in names], jaccard_join.described, []

    def described(*args):
        plans.append(spark.range(1 << 30).join(small, "id")._jdf.queryExecution().sparkPlan().toString())
        return real(*args)

    monkeypatch.setattr(jaccard_join, "described", described)
    jaccard_join.jaccard_join(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert [spark.conf.get(n, None) for n in names] == before
