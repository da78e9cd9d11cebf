"""Keyed tables, snapshots, checked imports, co-located joins, footers, streams with state, top-k joins, cache expiry."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from curation.operators import extractors, series, topk
from curation.plans import registry, storage
from curation.sources import colocated, database, files, tables
from curation.sources.keyed import KeyedTable
from curation.streaming import state
from tests.compare import DATA, check

KEYS = [database.Key("b", "a_id", "a", "id"), database.Key("c", "b_id", "b", "id")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_merge_leaves_other_files_alone(spark, tmp_path):
    rows = spark.range(400).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("s"))
    kept = KeyedTable.create(rows, str(tmp_path / "t"), ["id"], 16)
    before = {f for f in files.files(spark, kept.path) if f.endswith(".parquet")}
    new = spark.createDataFrame([(3, 99, " "), (1000, 1, "y")], "id long, v long, s string")
    touched = kept.upsert(new)
    after = {f for f in files.files(spark, kept.path) if f.endswith(".parquet")}
    assert 1 <= len(touched) <= 2 and before <= after and len(after - before) <= 2
    live = set(kept.pointer["at"].values())
    same = [f for f in before if f.rsplit("/", 1)[0] in live]
    assert len(same) == len(before) - len(touched)
    got = {r["id"]: (r["v"], r["s"]) for r in KeyedTable(spark, kept.path).read().collect()}
    assert got == {i: (2 * i, "x") for i in range(400)} | {3: (99, "x"), 1000: (1, "y")}
    kept.delete(spark.createDataFrame([(3,), (5555,)], "id long"))
    assert kept.recompute("v", F.greatest("v", F.lit(0))) == []
    assert kept.read().count() == 400 and kept.vacuum() > 0 and kept.read().count() == 400
    empty = KeyedTable.create(rows.where("false"), str(tmp_path / "e"), ["id"], 4)
    assert empty.read().count() == 0
    empty.upsert(new)
    assert empty.read().count() == 2


def test_a_lost_merge_changes_nothing(spark, tmp_path):
    kept = KeyedTable.create(spark.range(20).select("id", F.lit(1).alias("v")), str(tmp_path / "t"), ["id"], 4)
    with pytest.raises(Exception, match="broken"):
        kept.rewrite(spark.range(5), lambda old: old.withColumn("v", F.raise_error(F.lit("broken")).cast("int")))
    assert KeyedTable(spark, kept.path).read().where("v = 1").count() == 20


def test_unchanged_tables_cost_nothing(spark, tmp_path):
    a, b = spark.range(10), spark.range(5).select("id", F.lit("t").alias("t"))
    store = database.SnapshotStore(spark, str(tmp_path))
    for i in range(5):
        store.snapshot({"a": a.where(f"id <> {i}"), "b": b})
    parts = {t: len(files.folders(spark, f"{tmp_path}/parts/{t}")) for t in ("a", "b")}
    assert parts == {"a": 5, "b": 1}
    store.restore(1)
    assert store.retain(2) == [5, 4, 1]
    assert len(files.folders(spark, f"{tmp_path}/parts/a")) == 3 and store.tables()["a"].where("id = 0").count() == 0
    store.restore(5)
    assert store.retain(1) == [5] and len(files.folders(spark, f"{tmp_path}/parts/a")) == 1
    with pytest.raises(ValueError, match="no snapshot 9"):
        store.restore(9)


def test_imports_are_checked_before_anything_is_committed(spark, tmp_path):
    own = {"c": spark.createDataFrame([(1, 7), (2, None)], "id long, b_id long"), "b": spark.createDataFrame([(7, 1)], "id long, a_id long"), "a": spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 0, 123456))], "id long, at timestamp_ntz")}
    assert database.parents_first([*own], KEYS) == ["a", "b", "c"]
    schemas = {n: df.schema for n, df in own.items()}
    database.export_database(own, f"{tmp_path}/good", KEYS)
    back = database.import_database(spark, f"{tmp_path}/good", f"{tmp_path}/db", schemas, KEYS)
    assert [*back] == ["a", "b", "c"] and all(back[n].exceptAll(own[n]).isEmpty() and own[n].exceptAll(back[n]).isEmpty() for n in own)
    with pytest.raises(ValueError, match="not empty: a, b, c"):
        database.import_database(spark, f"{tmp_path}/good", f"{tmp_path}/db", schemas, KEYS)
    broken = own | {"c": spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id long, b_id long")}
    database.export_database(broken, f"{tmp_path}/bad", KEYS)
    with pytest.raises(ValueError, match=r"c\.b_id = 8 \(2 rows, no b\.id\)"):
        database.import_database(spark, f"{tmp_path}/bad", f"{tmp_path}/db", schemas, KEYS, force=True)
    assert database.SnapshotStore(spark, f"{tmp_path}/db").current() == 1
    spark.createDataFrame([("c", 5)], "name string, rows long").write.mode("append").json(f"{tmp_path}/bad/manifest")
    with pytest.raises(ValueError, match=r"differ from the manifest"):
        database.import_database(spark, f"{tmp_path}/bad", f"{tmp_path}/other", schemas, KEYS)


def test_colocated_children_are_not_shuffled(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = plan_of(registry.QUERIES["j8_children_nested"](spark, DATA))
        assert "Exchange hashpartitioning" in shuffled
        assert "Exchange" not in plan_of(registry.QUERIES["j8_children_colocated"](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_counts_come_from_footers(spark):
    df = colocated.row_counts(spark, {"orders": f"{DATA}/orders.parquet"})
    assert "PushedAggregation: [COUNT(*)]" in df._jdf.queryExecution().toString()
    assert df.collect()[0]["n"] == spark.read.parquet(f"{DATA}/orders.parquet").count()


def test_a_hit_does_not_renew_an_entry(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, i, start + timedelta(seconds=s)) for k, times in ((1, (0, 200, 400, 450, 700)), (2, (5, 304, 305, 305))) for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "k long, i long, at timestamp_ntz").repartition(3)
    got = {(r["k"], r["i"]): r["expired"] for r in series.cache_misses(df, "k", "at", "i").collect()}
    assert [got[1, i] for i in range(5)] == [True, False, True, False, True]
    assert [got[2, i] for i in range(4)] == [True, False, True, False]


def test_reaper_fires_on_the_boundary_and_late_beats_rearm(spark):
    start = datetime(2024, 1, 1)
    times = {1: [0, 60], 2: [0, 1200], 3: [600], 4: [599, 601], 5: [0, 300, 900]}
    rows = [(u, start + timedelta(seconds=s), 10 * u + i, "click") for u, ts in times.items() for i, s in enumerate(ts)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, event_type string")
    changes = state.replayed(spark, events, state.reaper_stream, batches=3, jitter=500)
    got = {r["user_id"]: r["reaped"] for r in state.final_status(changes).collect()}
    # the clock ends at 1200 s: beats up to 600 s are ten minutes old
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def brute_best(names: list[str], k: int) -> set:
    def squash(s):
        return "".join(c for c in s.lower() if c.isascii() and c.isalnum())

    def tokens(s):
        return set("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())

    out = set()
    for a in names:
        found = []
        for b in names:
            if a != b and (tokens(a) & tokens(b) or squash(a) == squash(b)):
                x, y = squash(a), squash(b)
                score = 1.0 if x == y else max(SequenceMatcher(None, x, y).ratio(), 0.9 if x in y or y in x else 0.0, 0.95 * len(tokens(a) & tokens(b)) / len(tokens(a) | tokens(b)))
                found.append((-round(score, 4), b))
        out |= {(a, b, -s, n) for n, (s, b) in enumerate(sorted(found)[:k], 1)}
    return out


def named(count: int) -> list[str]:
    """Names that all share a token, most of them in families of a rarer one."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 8))) for _ in range(count // 15)]
    return sorted({" ".join(["MSc", draw.choice(words), *draw.choices(words, k=draw.randint(0, 2))]) for _ in range(count)} | {"MSc", "M.S.C", "msc x"})


def test_best_entries_are_those_of_all_pairs(spark, monkeypatch):
    rows, scored = {}, topk.scored
    monkeypatch.setattr(topk, "scored", lambda pairs: (rows.setdefault(len(names), []).append(pairs.count()), scored(pairs))[1])
    for count in (150, 600):
        names = named(count)
        df = spark.createDataFrame([(n,) for n in names], "name string")
        got = {(r["signal"], r["entry"], r["score"], r["n"]) for r in topk.best_entries(df, "name", df, "name", itself=False).collect()}
        if count == 150:
            assert got == brute_best(names, 3)
    (few, a), (many, b) = ((n, sum(x)) for n, x in rows.items())
    assert b / a < 2 * many / few, rows  # in proportion, although all names share a token


def test_exports_keep_microseconds(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 1, 2, 3, 456789),)], "at timestamp_ntz").withColumn("z", F.col("at").cast("timestamp"))
    tables.export_tables({"t": df}, str(tmp_path))
    assert tables.import_tables(spark, str(tmp_path), {"t": df.schema})["t"].collect() == df.collect()


def test_every_foreign_key_of_the_data_is_named():
    assert {k.child for k in storage.KEYS} | {k.parent for k in storage.KEYS} <= set(storage.TABLES)


def test_an_extractor_is_added_without_touching_a_plan(spark):
    own = extractors.Extractors()
    own.expressions |= extractors.BUILT_IN.expressions

    @own.scan("words")
    def words(content, base):
        return [(w, f"/{w}") for w in content.split()[:2]]

    pages = spark.createDataFrame([(1, '<a href="/x">X</a> <a href="https://b.c/y">', "https://a.b/p"), (2, None, "https://a.b"), (3, "", None)], "id int, html string, base string")
    got = sorted(map(tuple, own.extracted(pages, "html", "base").select("id", "extractor", "pos", "text", "url").collect()), key=str)
    assert got == sorted([(1, "html_links", 0, None, "https://a.b/x"), (1, "html_links", 1, None, "https://b.c/y"), (1, "words", 0, "<a", "https://a.b/<a"), (1, "words", 1, 'href="/x">X</a>', 'https://a.b/href="/x">X</a>')], key=str)
    assert own.names == ["html_links", "words"] and own.extracted(pages, "html", "base", []).count() == 0
    with pytest.raises(ValueError, match="unknown extractors: no"):
        own.extracted(pages, "html", "base", ["no"])
    with pytest.raises(ValueError, match="would hide: url"):
        own.extracted(pages.withColumnRenamed("base", "url"), "html", "url")


def test_fees_of_one_line_number_go_by_their_place(spark, tmp_path):
    """The first file is the smaller one, so a scan takes it up last."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber")
    for i, rows in enumerate((lines.limit(300), lines, lines.withColumn("l_quantity", F.rand(1)))):
        price = F.col("l_extendedprice") + i * 1000 + F.pmod(F.xxhash64("l_partkey", F.lit(i)), F.lit(100))
        rows.withColumn("l_extendedprice", price).coalesce(1).write.parquet(str(tmp_path / f"{i}"))
        (part,) = (tmp_path / f"{i}").glob("*.parquet")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "lineitem.parquet" / f"{i}.parquet")
    for other in ("nation", "customer", "orders"):
        (tmp_path / f"{other}.parquet").symlink_to(f"{DATA}/{other}.parquet")
    check(spark, registry.QUERIES, registry.ORACLES, "w5_u8_valid_fees", str(tmp_path))


def test_an_export_is_compressed_and_an_import_stages_it_once(spark, tmp_path, monkeypatch):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    orders.write.json(str(tmp_path / "plain"))
    database.export_database({"a": orders, "b": orders}, f"{tmp_path}/out", [])
    size = lambda at: sum(f.stat().st_size for f in at.rglob("part-*"))
    assert size(tmp_path / "out" / "a") < size(tmp_path / "plain") / 3
    scans = []
    digest = database.SnapshotStore.digest
    monkeypatch.setattr(database.SnapshotStore, "digest", staticmethod(lambda df: (scans.append(plan_of(df)), digest(df))[1]))
    back = database.import_database(spark, f"{tmp_path}/out", f"{tmp_path}/db", {"a": orders.schema, "b": orders.schema}, [])
    assert len(scans) == 2 and not any("json" in p.lower() for p in scans)
    assert sorted(back["b"].collect()) == sorted(orders.collect())
    assert files.folders(spark, f"{tmp_path}/db") == ["manifests", "parts"]
    with pytest.raises(ValueError, match="rows without parent"):
        key = database.Key("a", "o_orderkey", "b", "o_custkey")
        database.import_database(spark, f"{tmp_path}/out", f"{tmp_path}/db", {"a": orders.schema, "b": orders.schema}, [key], force=True)
    assert files.folders(spark, f"{tmp_path}/db") == ["manifests", "parts"]


def test_streams_keep_keys_by_shards(spark, monkeypatch):
    """Jobs of one shard have their own timers, and a stream calls Python by shards."""
    start = datetime(2024, 1, 1)
    times = {u: [60 * (u % 7), 600 + 40 * (u % 11)] for u in range(40)} | {99: [1200]}
    rows = [(u, start + timedelta(seconds=s), 10 * u + i, "click") for u, ts in times.items() for i, s in enumerate(ts)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, event_type string")
    for shards in (1, 3):
        got = {r["user_id"]: r["reaped"] for r in state.final_status(state.replayed(spark, events, lambda e: state.reaper_stream(e, shards=shards), batches=2, jitter=300)).collect()}
        # the clock ends at 1200 s: beats up to 600 s are ten minutes old
        assert got == {u: ts[-1] <= 600 for u, ts in times.items()}
        logs = state.final_logs(state.replayed(spark, events, lambda e: state.log_stream(e, most=1, shards=shards), batches=2, jitter=300)).collect()
        assert {(r["user_id"], r["event_id"], r["pos"]) for r in logs} == {(u, 10 * u + len(ts) - 1, 1) for u, ts in times.items()}


def test_pages_go_to_python_in_small_batches(spark, tmp_path):
    for limit in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{limit}")
    (tmp_path / "pages.parquet").symlink_to(f"{DATA}/pages.parquet")
    pages = registry.table(spark, str(tmp_path), "pages")
    rows = pages.select("html").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))).coalesce(1)

    @F.pandas_udf("long")
    def together(html):
        return html.map(lambda _: len(html))

    assert rows.agg(F.max(together("html"))).first()[0] <= 256 < rows.count()
