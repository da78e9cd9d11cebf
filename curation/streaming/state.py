"""Keyed state with event-time timers: a heartbeat reaper and a capped event log, each as a stream and as a batch query.

Keys are kept by shards, so a stream costs a call of Python for each shard of a micro-batch, not for each key; a shard's
timer is the earliest of its keys'.

Both forms answer for a moment ``now``: the stream's is its watermark, which a clock row moves on where no events come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curation.sources import tables

#: The key of clock rows, which no job or task has.
CLOCK = -1
#: Shards of the keys of a stream.
SHARDS = 1024


def _milliseconds(us: int) -> int:
    return -(-us // 1000)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard")


def _micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


def _kept(state: GroupState, value: tuple, expires: list[int]) -> None:
    """Keep what is left of a shard and wake it when its first timer is due, or forget it."""
    if expires:
        state.update(value)
        # a timer fires once the watermark is past it
        state.setTimeoutTimestamp(min(expires) - 1)
    elif state.exists:
        state.remove()


def reaper_stream(events: DataFrame, minutes: int = 10, lateness: str = "1 hour", done: tuple[str, ...] = ("purchase",), shards: int = SHARDS) -> DataFrame:
    """(user_id, last_beat, state, status, tasks): RUNNING when beats of a job come, FAILED once ``minutes`` have passed
    since its last one (the boundary included), with the tasks that were live then.

    A beat re-arms the job's timer; late ones are taken up to ``lateness``. A job that fails is forgotten, so what is held
    is the live jobs; a later beat starts it anew. A task is an event type; those in ``done`` are over when they come.
    """
    beats = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type", _shard(shards)).withWatermark("at", lateness)
    columns = ["user_id", "last_beat", "state", "status", "tasks"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = {user: (us, last, kind, set(tasks)) for user, us, last, kind, tasks in zip(*state.get)} if state.exists else {}
        beaten = set()
        for part in [] if state.hasTimedOut else parts:
            for user, at, event, own in zip(part["user_id"].tolist(), _micros(part["at"]), part["event_id"].tolist(), part["event_type"]):
                us, last, kind, held = jobs.get(user) or (-1, -1, "", set())
                if own not in done:
                    held.add(own)
                jobs[user] = (at, event, own, held) if (at, event) > (us, last) else (us, last, kind, held)
                beaten.add(user)
        rows = [(user, jobs[user][0], jobs[user][2], "RUNNING", sorted(jobs[user][3])) for user in beaten]
        expires = {user: _milliseconds(job[0]) + minutes * 60_000 for user, job in jobs.items()}
        for user in [u for u, at in expires.items() if at <= state.getCurrentWatermarkMs()]:
            us, _, kind, held = jobs.pop(user)
            rows.append((user, us, kind, "FAILED", sorted(held)))
            del expires[user]
        _kept(state, tuple([*c] for c in zip(*((user, us, last, kind, sorted(held)) for user, (us, last, kind, held) in jobs.items()))), [*expires.values()])
        if rows:
            out = pd.DataFrame(rows, columns=columns)
            yield out.assign(last_beat=out["last_beat"].to_numpy().astype("datetime64[us]"))

    out = "user_id long, last_beat timestamp, state string, status string, tasks array<string>"
    kept = "users array<long>, us array<long>, last_ids array<long>, kinds array<string>, tasks array<array<string>>"
    return beats.groupBy("shard").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def final_status(changes: DataFrame) -> DataFrame:
    """The last change of each job in what ``reaper_stream`` has put out."""
    order = F.struct("last_beat", F.col("status") == "FAILED")
    last = changes.where(F.col("user_id") != CLOCK).groupBy("user_id").agg(F.max_by(F.struct("last_beat", "state", "status"), order).alias("x"))
    return last.select("user_id", F.col("x.last_beat").cast("timestamp_ntz").alias("last_beat"), "x.state", (F.col("x.status") == "FAILED").alias("reaped"))


def log_stream(events: DataFrame, most: int = 500, hours: int = 1, lateness: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """(user_id, last, events): the log of a task, its last ``most`` events in order, whenever it changes; null once ``hours``
    have passed without one, when the task is forgotten. Events before a pause of that length are not in the log."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", _shard(shards)).withWatermark("at", lateness)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        logs: dict[int, list] = {}
        if state.exists:
            users, sizes, times, ids = state.get
            flat, ends = [*zip(times, ids)], np.cumsum(sizes).tolist()
            logs = {user: flat[end - n : end] for user, n, end in zip(users, sizes, ends)}
        changed = set()
        for part in [] if state.hasTimedOut else parts:
            new: dict[int, list] = {}
            for user, at, event in zip(part["user_id"].tolist(), _micros(part["at"]), part["event_id"].tolist()):
                new.setdefault(user, []).append((at, event))
            for user, own in new.items():
                logs[user] = sorted(logs.get(user, []) + own)[-most:]
            changed |= new.keys()
        out = []
        for user in changed:
            log = logs[user]
            # a late event may still fill a pause, so what is before it is only left out of the answer
            start = max((i for i in range(1, len(log)) if log[i][0] - log[i - 1][0] >= hours * 3_600_000_000), default=0)
            out.append((user, log[-1][0], [e for _, e in log[start:]]))
        expires = {user: _milliseconds(log[-1][0]) + hours * 3_600_000 for user, log in logs.items()}
        for user in [u for u, at in expires.items() if at <= state.getCurrentWatermarkMs()]:
            out.append((user, logs.pop(user)[-1][0], None))
            del expires[user]
        flat = [x for log in logs.values() for x in log]
        _kept(state, ([*logs], [*map(len, logs.values())], [t for t, _ in flat], [e for _, e in flat]), [*expires.values()])
        if out:
            users, last, own = zip(*out)
            yield pd.DataFrame({"user_id": users, "last": np.asarray(last, "datetime64[us]"), "events": pd.Series(own, dtype=object)})

    out = "user_id long, last timestamp, events array<long>"
    kept = "users array<long>, sizes array<int>, times array<long>, ids array<long>"
    return rows.groupBy("shard").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def final_logs(changes: DataFrame, tasks: int = 100) -> DataFrame:
    """user_id, event_id, pos of the ``tasks`` tasks with the newest events in what ``log_stream`` has put out."""
    # the newest change has the newest event, then no log or the longest one
    n = F.coalesce(F.nullif(F.size("events"), F.lit(-1)), F.lit(1 << 30))
    rows = changes.where(F.col("user_id") != CLOCK).withColumn("n", n)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("last", "events"), F.struct("last", "n")).alias("x")).select("user_id", "x.*")
    newest = last.where("events is not null").orderBy(F.desc("last"), "user_id").limit(tasks)
    return newest.select("user_id", F.posexplode("events").alias("pos", "event_id")).select("user_id", "event_id", (F.col("pos") + 1).alias("pos"))


def capped_log(events: DataFrame, clock: DataFrame, most: int = 500, tasks: int = 100, hours: int = 1) -> DataFrame:
    """The batch form: tasks with an event within ``hours`` of ``now`` (one row of ``clock``), the newest ``tasks`` of them, and of
    each the last ``most`` events since its last pause of ``hours``."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    live = last.crossJoin(F.broadcast(clock)).where(F.col("last") > F.col("now") - F.expr(f"INTERVAL {hours} HOURS"))
    newest = live.orderBy(F.desc("last"), "user_id").limit(tasks).select("user_id")
    pause = F.col("ts") >= F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")) + F.expr(f"INTERVAL {hours} HOURS")
    timed = events.join(F.broadcast(newest), "user_id").withColumn("start", F.when(pause, F.col("ts")))
    own = timed.withColumn("start", F.max("start").over(W.partitionBy("user_id"))).where("start is null or ts >= start")
    back = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = own.withColumn("n", F.row_number().over(back)).where(F.col("n") <= most)
    return kept.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


def replayed(spark: SparkSession, events: DataFrame, form, batches: int = 4, jitter: int = 3000, lateness: int = 3600) -> DataFrame:
    """What ``form`` (a stream of events to a stream of changes) puts out if ``events`` arrive in several micro-batches.

    They arrive up to ``jitter`` seconds late, so beats of one batch are older than some of the one before. A clock row of
    the last event's time plus ``lateness`` comes last, so that the watermark ends at the last event.
    """
    path = tables.scratch(spark)
    arrival = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(jitter))
    rows = events.select("user_id", "ts", "event_id", "event_type").withColumn("arrival", arrival)
    cuts = rows.agg(F.percentile_approx("arrival", [i / batches for i in range(1, batches)]), F.max("ts")).first()
    at = sum((F.when(F.col("arrival") > c, 1).otherwise(0) for c in cuts[0] or []), F.lit(0))
    for i in range(batches):
        rows.where(at == i).drop("arrival").write.parquet(f"{path}/in/{i:03d}")
    clock = spark.range(1).select(F.lit(CLOCK).cast("long").alias("user_id"), (F.lit(cuts[1]).cast("timestamp_ntz") + F.expr(f"INTERVAL {lateness} SECONDS")).alias("ts"), F.lit(0).cast("long").alias("event_id"), F.lit("clock").alias("event_type"))
    clock.select(rows.drop("arrival").columns).write.parquet(f"{path}/in/{batches:03d}")
    stream = spark.readStream.schema(rows.drop("arrival").schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true")
    out = f"{path}/out"
    # one start per batch: each takes the files that have come since the last, and the state is kept between them
    for i in range(batches + 1):
        changes = form(stream.parquet(*[f"{path}/in/{{{','.join(f'{k:03d}' for k in range(i + 1))}}}"]))
        query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(out)
