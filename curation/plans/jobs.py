"""Queries of staged jobs: states, retries, resumption, task graphs and crawl stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from curation.operators import series
from curation.plans.registry import ORACLES, Rows, query, table
from curation.streaming import heartbeats, state


@query("x2_heartbeat_reaper", "SELECT user_id, max(ts) AS last_beat, arg_max(event_type, (ts, event_id)) AS state, max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS reaped FROM events GROUP BY user_id")
def heartbeat_reaper(spark, d):
    e = table(spark, d, "events")
    return heartbeats.reaped(e, e.agg(F.max("ts").alias("now")))


@query("x4_idempotent_skip", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def idempotent_skip(spark, d):
    """One run per idempotency key: the first."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


STAGES = Rows("stage string, ord int", [("fetch_raw", 1), ("extract_structured", 2), ("validate_rules", 3), ("persist_versioned", 4)])
DONE = Rows("job int, stage string, state string", [(1, "fetch_raw", "SUCCEEDED"), (1, "extract_structured", "FAILED"), (2, "fetch_raw", "SUCCEEDED"), (2, "extract_structured", "SUCCEEDED"), (2, "validate_rules", "SUCCEEDED"), (2, "persist_versioned", "SUCCEEDED"), (3, "validate_rules", "SUCCEEDED")])


@query("x5_resume_stage", f"""
WITH j AS (SELECT DISTINCT job FROM {DONE.sql}) SELECT j.job, arg_min(s.stage, s.ord) FILTER (coalesce(t.state, '') <> 'SUCCEEDED') AS resume FROM j, {STAGES.sql} s LEFT JOIN {DONE.sql} t ON t.job = j.job AND t.stage = s.stage GROUP BY j.job""")
def resume_stage(spark, d):
    """First stage in order that has not succeeded."""
    done = DONE.df(spark)
    rows = done.select("job").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(o).alias("ord")) for n, o in STAGES.rows]))).select("job", "s.*")
    open_ = rows.join(done, ["job", "stage"], "left").withColumn("open", F.coalesce("state", F.lit("")) != "SUCCEEDED")
    return open_.groupBy("job").agg(F.min_by(F.when(F.col("open"), F.col("stage")), F.when(F.col("open"), F.col("ord"))).alias("resume"))


@query("x6_event_log_tail", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def event_log_tail(spark, d):
    return series.last_n(table(spark, d, "events"), ["user_id"], [F.desc("event_id")], 20).select("user_id", "event_id")


@query("x6_capped_log", """
WITH clock AS (SELECT max(ts) AS now FROM events), t AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id),
live AS (SELECT user_id FROM t, clock WHERE last > now - INTERVAL 1 HOUR ORDER BY last DESC, user_id LIMIT 100),
g AS (SELECT user_id, event_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR AS pause FROM events JOIN live USING (user_id)),
s AS (SELECT user_id, max(ts) AS start FROM g WHERE pause GROUP BY user_id),
e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM g LEFT JOIN s USING (user_id) WHERE start IS NULL OR ts >= start)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos FROM e WHERE n <= 500""")
def capped_log(spark, d):
    e = table(spark, d, "events")
    return state.capped_log(e, e.agg(F.max("ts").alias("now")))


@query("x6_capped_log_stream", ORACLES["x6_capped_log"])
def capped_log_stream(spark, d):
    """The same log kept by a stream that takes the events in several micro-batches, late ones among them."""
    return state.final_logs(state.replayed(spark, table(spark, d, "events"), state.log_stream))


@query("x2_reaper_stream", ORACLES["x2_heartbeat_reaper"])
def reaper_stream(spark, d):
    """The reaper as a stream with a timer for each job, over several micro-batches with late beats."""
    return state.final_status(state.replayed(spark, table(spark, d, "events"), state.reaper_stream))


@query("x7_cache_expiry", """
WITH RECURSIVE f AS (
  SELECT user_id, min(ts) AS fill FROM events GROUP BY user_id
  UNION ALL SELECT f.user_id, min(e.ts) FROM f JOIN events e ON e.user_id = f.user_id AND e.ts >= f.fill + INTERVAL 300 SECOND GROUP BY f.user_id, f.fill),
e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS n FROM events)
SELECT e.user_id, event_id, f.fill IS NOT NULL AND n = 1 AS expired FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.fill = e.ts""")
def cache_expiry(spark, d):
    """An entry lives 300 s from its fill; hits don't renew it."""
    return series.cache_misses(table(spark, d, "events"), "user_id", "ts", "event_id")
