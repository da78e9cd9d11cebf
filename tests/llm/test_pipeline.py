"""The pipeline's stages: what each keeps, and the columns it hands on."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from curation.llm import quality
from tests.compare import DATA
from tests.llm import cases


def test_stages_on_awkward_documents(spark, tmp_path):
    """Null, empty, repeated and very long texts, rows without id, clashing columns; then the empty table."""
    rows = [*cases.documents(), (None, "a text of a row without an id", "en", "s", 29, "k", "z"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumn("_own", F.lit("o")).withColumn("score", F.lit(2.0))
    spark.createDataFrame([(r[0], 1) for r in rows[:40]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, exact, near, substring, packing = str(tmp_path), *(f for _, f in corpus_pipeline.STAGES[1:])

    def ids(df):
        assert df.columns == docs.columns
        return sorted((r["doc_id"] or 0) for r in df.select("doc_id").collect())

    scored = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert set(ids(scored)) <= {r[0] or 0 for r in rows} and scored.where("_own <> 'o' or score <> 2.0").count() == 0
    by_text: dict = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", []).append(i or 0)
    assert ids(exact(spark, docs, sf_dir)) == sorted(i or 0 for i, t, *_ in rows if (i or 0) == max(by_text[t or ""]))
    linked = cases.linked([r for r in rows if r[0]], 5, 80)
    assert ids(near(spark, docs, sf_dir)) == sorted(i or 0 for i, *_ in rows if not i or linked[i][2])
    removed = cases.removed([r for r in rows if r[0]], 50)
    cut = substring(spark, docs, sf_dir)
    assert ids(cut) == sorted(i or 0 for i, *_ in rows if not i or removed[i][0] == 0 or removed[i][1] < removed[i][0])
    for r in cut.where("doc_id is not null").collect():
        n, gone, _ = removed[r["doc_id"]]
        assert len((r["text"] or "").encode().split()) == n - gone and (not gone or r["n_chars"] == len(r["text"]))
    assert packing(spark, docs, sf_dir).select("doc_id").distinct().count() == len({r[0] for r in rows})
    none = docs.where("false")
    assert all(f(spark, none, sf_dir).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_stages_in_order_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "substring dedup", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().count() == counts[-1]
        if name == "exact dedup":
            assert docs.select("text").distinct().count() == counts[-1]
        if name == "near dedup":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert all(kept for _, _, kept in cases.linked(rows, 5, 80).values())
        if name == "substring dedup":
            after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert sum(gone for _, gone, _ in cases.removed(after, 50).values()) == 0
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == counts[-1]


def test_rejected_documents_score_below_the_threshold(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()}
    scores = quality.score_texts(docs, quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).select("doc_id", "score").collect()
    assert kept == {r["doc_id"] for r in scores if r["score"] >= quality.THRESHOLD}
