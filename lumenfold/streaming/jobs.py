"""Job event streams; every function works on a batch and on a stream alike unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lumenfold.operators.quality import OPEN_STAGES
from lumenfold.operators.relational import latest

#: Event type of the source table to job stage.
STAGES = {"signup": "queued", "view": "capturing", "click": "indexing", "purchase": "complete", "error": "failed"}
#: Stages that end a job, and those of a running one.
TERMINAL, RUNNING = ("complete", "failed", "skipped"), ("capturing", "analyzing", "verifying", "indexing")


def job_events(events: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return events.select(F.col("event_id"), F.col("user_id").alias("job_id"), table[F.col("event_type")].alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "value")


def stage_windows(jobs: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tallies by window and stage."""
    return jobs.withWatermark("ts", late).groupBy(F.window("ts", size), "stage").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "stage", "n")


def health_windows(jobs: DataFrame, size: str = "1 day", late: str = "2 days", most_failed: int = 20) -> DataFrame:
    """Open and failed events of a window, and its health."""
    n = lambda *s: F.count(F.when(F.col("stage").isin(*s), 1))
    out = jobs.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(n(*OPEN_STAGES).alias("open"), n("failed").alias("failed"))
    level = F.when(F.col("failed") > most_failed, "critical").when((F.col("failed") > 0) | (F.col("open") > 0), "warn").otherwise("ok")
    return out.select(F.col("window.start").alias("window_start"), "open", "failed", level.alias("health"))


def sessions(jobs: DataFrame, gap: str = "4 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of heartbeats; a job is stale after the end of its session."""
    return jobs.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "job_id").agg(F.count(F.lit(1)).alias("beats")).select("job_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("stale_at"), "beats")


def current_state(jobs: DataFrame) -> DataFrame:
    """T1 (batch): the last stage of each job; ties by event id."""
    last = F.max(F.struct("ts", "event_id", "stage")).alias("l")
    return jobs.groupBy("job_id").agg(last).select("job_id", F.col("l.stage").alias("stage"), F.col("l.ts").alias("updated_at"))


def _stateful(jobs: DataFrame, schema: str, state: str, update: Callable[[tuple | None, list[tuple]], tuple[tuple, list[tuple]]]) -> DataFrame:
    """Rows of `schema` (job_id first) from update(state, new events of a job in order), which gives the new state and rows."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        events = [e for pdf in batches for e in pdf[["ts", "event_id", "stage"]].itertuples(index=False, name=None)]
        new, rows = update(held.get if held.exists else None, sorted(events, key=lambda e: (e[0], e[1])))
        held.update(new)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    return jobs.groupBy("job_id").applyInPandasWithState(run, schema, state, "update", GroupStateTimeout.NoTimeout)


def state_stream(jobs: DataFrame) -> DataFrame:
    """T1 (stream): after each batch the last stage of every job that it touched; an event older than the last one changes nothing."""

    def update(held, events):
        ts, event_id, stage = events[-1]
        now = (int(pd.Timestamp(ts).value // 1000), int(event_id), stage)
        now = max(held, now, key=lambda s: s[:2]) if held else now
        return now, [(now[2], pd.Timestamp(now[0], unit="us"))]

    return _stateful(jobs, "job_id long, stage string, updated_at timestamp", "ts long, event_id long, stage string", update)


def retry_stream(jobs: DataFrame, most: int) -> DataFrame:
    """T4 (stream): attempts and status of every job after each batch; state is two values a job."""

    def update(held, events):
        attempts, done = held or (0, "")
        for _, _, stage in events:
            attempts += stage == "failed"
            done = stage if stage == "complete" else "failed" if stage == "failed" and attempts >= most else "queued" if stage == "failed" else done
        return (attempts, done), [(attempts, done or "ok")]

    return _stateful(jobs, "job_id long, attempts long, status string", "attempts long, status string", update)


def recent_stream(jobs: DataFrame, n: int) -> DataFrame:
    """T6, K9 (stream): the ids of the last n events of every job, newest first, after each batch; state has n ids at most."""

    def update(held, events):
        old = list(zip(*held, strict=True)) if held else []
        new = sorted(old + [(int(pd.Timestamp(t).value // 1000), int(e)) for t, e, _ in events], reverse=True)[:n]
        return ([t for t, _ in new], [e for _, e in new]), [([e for _, e in new],)]

    return _stateful(jobs, "job_id long, event_ids array<long>", "ts array<long>, event_id array<long>", update)


def last_events(jobs: DataFrame, n: int) -> DataFrame:
    """K9, T6 (batch): the last n events of each job."""
    w = Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return jobs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def accepted(submits: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """T5 (stream): the first submission of a key; later ones within the watermark are dropped."""
    return submits.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def replay(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to the end of its input into Parquet files; in update mode each batch adds what it changed, with its batch id."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, i: batch.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"))
    writer.start().awaitTermination()


def ingest(stream: DataFrame, out: str, checkpoint: str, scope: DataFrame | None = None) -> None:
    """Each batch of manifests (`sources.library.manifest_stream`) becomes rows of the library below `out`.

    A capture's rows replace those that it had, in every table, so a batch that is run again leaves the same library.
    A batch has as many packages as the stream's maxFilesPerTrigger lets through; their folders are all that the driver
    learns of it.
    """
    from lumenfold.sources import library

    def write(batch: DataFrame, _: int) -> None:
        library.replace_captures(batch, out, scope)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retries(jobs: DataFrame, most: int) -> DataFrame:
    """T4 (batch): failed attempts of each job; completed if its last end is a success, else queued again below `most`, then failed."""
    attempts = F.count(F.when(F.col("stage") == "failed", 1))
    last = F.max(F.when(F.col("stage").isin("failed", "complete"), F.struct("ts", "event_id", "stage")))
    out = jobs.groupBy("job_id").agg(attempts.alias("attempts"), last.alias("_l"))
    status = F.when(F.col("_l").isNull(), "ok").when(F.col("_l.stage") == "complete", "complete").when(F.col("attempts") < most, "queued").otherwise("failed")
    return out.select("job_id", "attempts", status.alias("status"))


def running_cost(usage: DataFrame, at: str, model: str, usd: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Cost of each model in windows; on a stream, rows later than `late` are dropped."""
    source = usage.withWatermark(at, late) if usage.isStreaming else usage
    sums = source.groupBy(F.window(at, width), model).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(usd), 4).alias("usd"))
    return sums.select(F.col("window.start").alias("window_start"), model, "calls", "usd")


def recovered(states: DataFrame, now: Column, keep: str = "72 hours") -> DataFrame:
    """After a restart running jobs are queued; ended ones stay for `keep`; `recovered` tells which changed."""
    running = F.col("stage").isin(*RUNNING)
    kept = states.filter(~F.col("stage").isin(*TERMINAL) | (F.col("updated_at") >= now - F.expr(f"INTERVAL {keep}")))
    return kept.withColumn("recovered", running).withColumn("stage", F.when(running, "queued").otherwise(F.col("stage")))


def queue_order(states: DataFrame) -> DataFrame:
    """Queued jobs by turn: recovered ones first, then by position (none is last), then by time, then id. `place` is within a shard."""
    w = Window.partitionBy("shard").orderBy(F.col("recovered").desc(), F.col("position").asc_nulls_last(), "created_at", "job_id")
    return states.filter("stage = 'queued'").withColumn("place", F.row_number().over(w))


def claims(jobs: DataFrame, now: Column, workers: int, stale: str = "4 minutes") -> DataFrame:
    """Jobs that workers may claim: queued first, then running ones without a heartbeat since `stale`, the oldest first."""
    old = (F.col("status") == "running") & (F.col("updated_at") < now - F.expr(f"INTERVAL {stale}"))
    open_jobs = jobs.filter((F.col("status") == "queued") | old).withColumn("reclaimed", old)
    return open_jobs.orderBy("reclaimed", "created_at", "job_id").limit(workers)


def live(jobs: DataFrame) -> DataFrame:
    """Running jobs, the last changed first."""
    return jobs.filter(F.col("stage").isin(*RUNNING)).orderBy(F.col("updated_at").desc(), "job_id")


def merged_jobs(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows in memory override stored ones of the same id."""
    both = memory.withColumn("_o", F.lit(0)).unionByName(stored.withColumn("_o", F.lit(1)))
    return latest(both, ["job_id"], F.col("_o")).drop("_o")
