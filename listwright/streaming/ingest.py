"""Continuous ingest and monitoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators import ingest
from .store import BucketStore


def merge_listings(store: BucketStore, new: DataFrame, now: datetime, version: int, mode: str = "complete") -> bool:
    """Merge mapped listings (one row a natural key) as ``version`` of the store; false if it is there already.

    Only buckets that the batch touches are read and rewritten; price changes are appended.  ``photos``, an array of
    addresses where the column exists, is synchronised into the photo table under the stored listing's id.
    """
    if store.version() >= version:
        return False
    new = new.persist()
    try:
        kinds = ingest.conform(new)
        touched = [r[0] for r in kinds.select(store.bucket(*ingest.KEY)).distinct().collect()]  # at most ``store.buckets``
        stored = store.read("listings", model.LISTING, touched)
        merged = ingest.upsert(stored, kinds, mode)
        full = store.write("listings", merged, version, *ingest.KEY)
        fresh = ingest.conform(ingest.price_changes(stored, kinds, now), model.PRICE_HISTORY)
        grown = store.write("history", fresh, version, "listing_id")
        rewritten = {"listings": (touched, full)}
        if "photos" in new.columns:
            ids = stored.select(*ingest.KEY, F.col("id").alias("_id"))
            seen = new.filter(F.size("photos") > 0).join(ids, ingest.KEY, "left").select(F.coalesce("_id", "id").alias("listing_id"), "photos").persist()
            own = [r[0] for r in seen.select(store.bucket("listing_id")).distinct().collect()]
            rewritten["photos"] = (own, store.write("photos", ingest.synced_photos(store.read("photos", model.PHOTO, own), seen), version, "listing_id"))
            seen.unpersist()
        store.commit(version, rewritten, {"history": grown})
    finally:
        new.unpersist()
    return True


def merge_batch(store: BucketStore, raw: DataFrame, rules: ingest.Admission, now: datetime, version: int) -> DataFrame:
    """One micro-batch: enrich, admit, merge, log prices, sync photos; returns the rejected rows.

    A batch whose version is already complete is not applied again, which makes replays harmless.
    """
    good, bad = ingest.admitted(ingest.enrich(raw), rules)
    merge_listings(store, ingest.mapped(good, now), now, version)
    return bad


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def start(stream: DataFrame, store: BucketStore, checkpoint: str, rules: ingest.Admission | None = None, clock: Callable[[], datetime] = utc_now, **trigger):
    """Merge a stream of records, raw ones by ``rules``, else mapped ones.  By default what is there is drained."""

    def batch(df: DataFrame, k: int) -> None:
        if rules is None:
            merge_listings(store, df, clock(), k)
        else:
            merge_batch(store, df, rules, clock(), k)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def over_limit(events: DataFrame, key: str, most: int = 20, width: str = "1 minute") -> DataFrame:
    """Fixed-window rate limits: key, window start, requests, and how many were over."""
    own = events.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return own.select(key, F.col("w.start").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("rejected"))


def last_seen(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Per key the newest event; works on tables and on streams."""
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    return own.groupBy(key).agg(F.max("ts").alias("last_seen_at"), F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Repeats go; in a stream those within ``delay``, and rows later than that by event time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drained(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append what is there of a stream to a folder; returns how many rows came too late for the watermark."""
    run = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: bursts of a key's events without a gap."""
    own = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
