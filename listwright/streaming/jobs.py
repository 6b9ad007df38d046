"""Job states folded from a stream of their events, with a mark on jobs that fall silent."""

from __future__ import annotations

import time

from pandas import Timedelta
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BucketStore

FINAL = ("Succeeded", "Failed")
FOLDED = "job_id string, created_at timestamp, status string, status_at timestamp, progress long, error_message string, finished_at timestamp, n long, silent boolean, due_at timestamp"


def states(events: DataFrame, due_us: int) -> DataFrame:
    """Each event (job_id, ts, status, progress, error_message) as the state of a job that has seen it alone."""
    at = F.col("ts").isNotNull()
    return events.select(
        F.col("job_id").cast("string"), F.col("ts").alias("created_at"), F.when(at, F.col("status")).alias("status"), F.col("ts").alias("status_at"), F.col("progress").cast("long"), F.when(at, F.col("error_message")).alias("error_message"),
        F.when(F.col("status").isin(*FINAL), F.col("ts")).alias("finished_at"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("silent"), F.timestamp_micros(F.lit(due_us)).alias("due_at"), F.lit(True).alias("_fresh"),
    )


def folded(rows: DataFrame, now_us: int) -> DataFrame:
    """One state a job, of its kept state and its new ones (``_fresh``).

    Smallest and largest values only, so the order of events and batches is free.  A job without a final status is silent from its
    ``due_at`` on, which each batch that names it sets anew; another event makes it a live one again.
    """
    last = F.max_by(F.struct("status", "status_at", "error_message"), F.struct("status_at", F.coalesce("status", F.lit("")), F.coalesce("error_message", F.lit(""))))
    own = rows.groupBy("job_id").agg(
        F.min("created_at").alias("created_at"), last.alias("_l"), F.max("progress").alias("progress"), F.max("finished_at").alias("finished_at"), F.sum("n").alias("n"), F.max("silent").alias("_silent"), F.max_by("due_at", "_fresh").alias("due_at"), F.max("_fresh").alias("_fresh"),
    )
    open_ = ~F.coalesce(F.col("_l.status").isin(*FINAL), F.lit(False))
    silent = open_ & ((F.col("_silent") & ~F.col("_fresh")) | (F.col("due_at") <= F.timestamp_micros(F.lit(now_us))))
    return own.select("job_id", "created_at", "_l.status", "_l.status_at", "progress", "_l.error_message", "finished_at", "n", silent.alias("silent"), "due_at")


def keep_jobs(store: BucketStore, events: DataFrame, version: int, patience: str = "1 day") -> None:
    """Fold a batch into the store's table ``jobs``; buckets without events and without newly silent jobs stay as they are."""
    if store.version() >= version:
        return
    now_us = time.time_ns() // 1000
    due = (F.col("due_at") <= F.timestamp_micros(F.lit(now_us))) & ~F.col("silent") & ~F.coalesce(F.col("status").isin(*FINAL), F.lit(False))
    named, late = (df.select(store.bucket("job_id")).distinct() for df in (events, store.read("jobs", FOLDED).filter(due)))
    touched = [r[0] for r in named.union(late).distinct().collect()]
    kept = store.read("jobs", FOLDED, touched).withColumn("_fresh", F.lit(False))
    now = folded(kept.unionByName(states(events, now_us + int(Timedelta(patience).total_seconds() * 1_000_000))), now_us)
    store.commit(version, {"jobs": (touched, store.write("jobs", now, version, "job_id"))})


def start(events: DataFrame, store: BucketStore, checkpoint: str, patience: str = "1 day", **trigger):
    """Fold a stream into the store's table ``jobs``.  By default what is there is drained.

    A run with a processing time beats once a second beside its events, so that jobs are found silent while no events come.
    """
    own = events.select("job_id", "ts", "status", "progress", "error_message").withColumn("_beat", F.lit(False))
    if "processingTime" in trigger:
        beats = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        own = own.unionByName(beats.select(F.lit(True).alias("_beat")), allowMissingColumns=True)
    return own.writeStream.foreachBatch(lambda df, k: keep_jobs(store, df.filter("NOT _beat").drop("_beat"), k, patience)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
