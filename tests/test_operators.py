"""Behaviour of operators that the query tests don't pin down."""

from __future__ import annotations

import tempfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from curation.functions import text as T
from curation.functions import urls as U
from curation.operators import fuzzy, joins, merge
from curation.plans.registry import QUERIES
from curation.sources import tables
from curation.streaming import heartbeats
from tests.compare import DATA


def test_fee_filter_needs_one_row_that_meets_all(spark):
    parents = spark.createDataFrame([("cheap",), ("pricey",), ("local",), ("none",)], "name string")
    fees = spark.createDataFrame(
        [("cheap", "non_local", "FullTime", 150000, "per_programme"), ("cheap", "non_local", "PartTime", 300000, "per_programme"), ("pricey", "non_local", "FullTime", 350000, "per_programme"), ("local", "local", "FullTime", 90000, "per_programme")],
        "name string, scope string, mode string, amount int, basis string",
    )

    def found(**filters):
        return {r[0] for r in joins.having_one_row(parents, fees, "name", "name", joins.fee_conditions(**filters)).collect()}

    assert len(found()) == 4
    assert found(most=200000) == {"cheap", "local"}
    assert found(mode="PartTime", most=200000) == set()
    assert found(scope="local") == {"local"}
    assert "cheap" in found(most=150000)


def test_sequence_ratio_is_that_of_difflib(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", "a"), (None, "a"), ("abc", "abc")]
    got = spark.createDataFrame(pairs, "a string, b string").select(fuzzy.sequence_ratio("a", "b")).collect()
    assert [r[0] for r in got] == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def requirements(spark, rows):
    return fuzzy.near_distinct_requirements(spark.createDataFrame(rows, "program int, pos int, category string, subject string, minimum string, text string"), "program", "pos").collect()


def test_requirements_that_repeat_go(spark):
    rows = [(1, 1, "IELTS 6.5 overall"), (1, 2, "IELTS 6.5 overall."), (1, 3, "An IELTS 6.5 overall score"), (1, 4, "TOEFL 80"), (1, 5, "TOEFL 90"), (1, 6, "a degree with honours"), (1, 7, "a degree with honors")]
    least = {4: "80", 5: "90"}
    assert [r["pos"] for r in sorted(requirements(spark, [(g, k, "other", None, least.get(k), t) for g, k, t in rows]))] == [3, 4, 5, 6]


def test_a_place_keeps_the_test_of_its_first_requirement(spark):
    rows = [(1, 1, "language", "IELTS", "6.5", "an overall score of six and a half"), (1, 2, "language", None, None, "an overall score of six and one half"), (1, 3, "language", "IELTS", "6.50", "IELTS")]
    assert [r["pos"] for r in requirements(spark, rows)] == [2]


def test_chunks_leave_no_gap(spark):
    text = "".join(f"line {i}\n" for i in range(500))
    parts = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(fuzzy.chunks(F.col("t"), 300).alias("c")).collect()
    assert [p["c"] for p in parts[1:]] == [None, [""]]
    at = 0
    for part in parts[0]["c"]:
        start = text.index(part)
        assert start <= at and len(part) <= 300
        at = start + len(part)
    assert at == len(text)


def test_swap_write_replaces_a_table_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    merge.swap_write(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_versions_close_and_append(spark):
    schema = "k int, mark string, since int, version_no int, valid_to int"
    now = spark.createDataFrame([(1, "a", 1, 1, None), (2, "b", 1, 1, None)], schema)
    new = spark.createDataFrame([(1, "a", 2), (2, "c", 2), (3, "d", 2)], "k int, mark string, since int")
    got = sorted(tuple(r) for r in merge.versioned(now, new, "k", "mark", "since").collect())
    assert [x for x in got if x[0] != 2] == [(1, "a", 1, 1, None), (3, "d", 2, 1, None)]
    assert [x for x in got if x[0] == 2] == [(2, "b", 1, 1, 2), (2, "c", 2, 2, None)]


def test_patch_refuses_blocked_fields(spark):
    with pytest.raises(ValueError, match="id"):
        merge.patched(spark.range(1), {"id": 2}, F.lit(True), ["name"])


def test_export_comes_back_equal(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.5, None)], "id int, price double, name string")
    manifest = tables.export_tables({"t": df}, str(tmp_path))
    assert [tuple(r) for r in manifest.collect()] == [("t", 2)]
    back = tables.import_tables(spark, str(tmp_path), {"t": "id int, price double, name string"})["t"]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        tables.import_tables(spark, str(tmp_path), {"t": "id int"}, existing={"t": df})


def test_university_slug_and_query_param(spark):
    urls = ["https://www.ln.edu.hk/a", "https://gs.cuhk.edu.hk", "https://ox.ac.uk/x", "https://mit.edu", "https://localhost:80/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(U.university_slug(F.col("u"))).collect()
    assert [r[0] for r in got] == ["ln", "cuhk", "ox", "mit", "localhost"]
    one = spark.createDataFrame([("https://x.y/a?p=1&page=2#f",)], "u string").select(U.with_query_param(F.col("u"), "page", F.lit(3))).first()[0]
    assert one == "https://x.y/a?p=1&page=3#f"


def test_blank_names_are_noise(spark):
    got = spark.createDataFrame([(None,), (" ",), ("Research",), ("MSc Law",)], "n string").select(T.noise_name(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, True, True, False]


def test_streams_end_sessions_and_skip_repeats(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "k1"), (1, at + dt.timedelta(minutes=5), "k1"), (1, at + dt.timedelta(hours=5), "k2"), (2, at + dt.timedelta(hours=9), "k3")]
    spark.createDataFrame(rows, "user_id int, ts timestamp, key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, ts timestamp, key string").parquet(str(tmp_path / "in"))
    ended = heartbeats.run_once(heartbeats.session_stream(stream), str(tmp_path / "s"), str(tmp_path / "c1"))
    assert {(r["user_id"], r["beats"]) for r in ended.collect()} >= {(1, 2)}
    first = heartbeats.run_once(heartbeats.first_per_key_stream(stream, "key"), str(tmp_path / "k"), str(tmp_path / "c2"))
    assert sorted(r["key"] for r in first.collect()) == ["k1", "k2", "k3"]


def test_queries_of_events_and_history_keep_every_id(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    n, users = events.count(), {r[0] for r in events.select("user_id").distinct().collect()}
    assert QUERIES["wn_batches_of_100"](spark, DATA).count() == n
    stages = QUERIES["a7_dropped_by_stage"](spark, DATA).collect()
    assert {r["user_id"] for r in stages} == users and sum(len(r["links"].split(",")) for r in stages) == n
    jobs = QUERIES["a22_job_with_tasks"](spark, DATA).collect()
    assert {r["user_id"] for r in jobs} == users and sum(r["tasks"] for r in jobs) == n
    assert QUERIES["wf_history"](spark, DATA).count() == QUERIES["j5_no_filter_keeps_all"](spark, DATA).first()["n"]


def test_programmes_of_all_years_are_nested_and_exported(spark):
    n, parts = QUERIES["j5_no_filter_keeps_all"](spark, DATA).first()["n"], spark.read.parquet(f"{DATA}/part.parquet").count()
    for name in ("j8_children_nested", "k1_k2_flat_export", "j4_program_catalog_inner"):
        assert QUERIES[name](spark, DATA).count() == n, name
    assert QUERIES["j8_children_nested"](spark, DATA).select("academic_year").distinct().count() > 1
    assert QUERIES["j3_requirement_exam_left"](spark, DATA).count() == parts


def test_all_scored_links_are_ranked(spark):
    html = "".join(f'<a href="/course/{i}"><b>MSc</b> no {i}</a>' for i in range(8))
    html += '<a href="/about">About</a><a href="/x/">Home</a><a href="/x/" class="k">Master\n programme</a><a href="http://o.org/y">y</a><a href="/study/masters/courses/list/7/">open'
    rows = spark.createDataFrame([(1, "http://u.edu/a/", html)], "page_id long, url string, html string")
    texts = rows.select(U.html_links(F.col("html")).alias("h"), U.html_link_texts(F.col("html")).alias("t")).first()
    assert len(texts["h"]) == len(texts["t"]) == 13
    assert texts["t"][0] == "MSc no 0" and texts["t"][10] == "Master programme" and texts["t"][12] == "open"
    path = shared(rows)
    got = sorted((r["rank"], r["link"], r["score"]) for r in QUERIES["t10_f23_ranked_links"](spark, path).collect())
    want = [("http://u.edu/study/masters/courses/list/7/", 9), *((f"http://u.edu/course/{i}", 8) for i in range(8)), ("http://u.edu/x/", 5)]
    assert got == [(n, *x) for n, x in enumerate(want, 1)]


def shared(pages):
    path = tempfile.mkdtemp()
    pages.write.parquet(f"{path}/pages.parquet")
    return path


def test_requirements_of_one_exam_and_threshold_are_one(spark):
    rows = [(1, 1, "6.5", "IELTS 6.5 overall"), (1, 2, None, "A degree"), (1, 3, "6.50", "Applicants must hold 6.50 in IELTS"), (1, 4, "6.0", "At least 6.0 in every part of IELTS"), (1, 5, "6.5", "TOEFL: a total of 6.5"), (1, 6, "6.5", "A score of 6.5"), (2, 1, "6.5", "6.5 (IELTS)")]
    got = requirements(spark, [(g, k, "language", None, m, t) for g, k, m, t in rows])
    assert sorted(r["pos"] for r in got if r["program"] == 1) == [2, 3, 4, 5, 6]
    assert [r["pos"] for r in got if r["program"] == 2] == [1]
