"""Enrich, admit, map and merge observed listings into the stored state.

Stored tables are plain Parquet, so a merge is copy-on-write: a full outer join on the natural key and a policy per
column.  The same functions run in batch and in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions import text

KEY = ["source_id", "external_id"]
#: Columns that a new observation replaces, completes, or never changes.
REPLACED = ["source_code", "source_name", "url", "title", "description", "property_type", "offer_type", "price", "location_text", "area_built_up", "area_land"]
COMPLETED = ["disposition", "rooms", "condition", "construction_type", "latitude", "longitude", "view_count"]
KEPT_FIRST = ["date_created_source", "first_seen_at"]
WITH_LATITUDE = ["geocoded_at", "geocode_source"]
SIZES = {"title": 200, "description": 5000, "location_text": 200}
MOST_PHOTOS = 50


def enrich(raw: DataFrame) -> DataFrame:
    """Disposition, rooms, condition and construction from title and description; present values stay."""
    words = F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("description"), F.lit("")))
    out = raw.withColumn("disposition", F.coalesce(F.nullif("disposition", F.lit("")), text.disposition(words)))
    return out.withColumns({
        "rooms": F.coalesce(F.nullif("rooms", F.lit(0)), text.rooms(F.col("disposition"))),
        "condition": F.coalesce(F.nullif("condition", F.lit("")), text.condition(words)),
        "construction_type": F.coalesce(F.nullif("construction_type", F.lit("")), text.construction(words)),
    })


def backfill_disposition(listings: DataFrame) -> DataFrame:
    """Title before description; only listings without one."""
    found = F.coalesce(text.disposition(F.col("title")), text.disposition(F.col("description")))
    out = listings.withColumn("disposition", F.coalesce("disposition", found))
    return out.withColumn("rooms", F.coalesce("rooms", text.rooms(F.col("disposition"))))


def backfill_condition(listings: DataFrame) -> DataFrame:
    words = F.concat_ws(" ", "title", "description")
    return listings.withColumns({"condition": F.coalesce("condition", text.condition(words, text.CONDITIONS_BACKFILL)), "construction_type": F.coalesce("construction_type", text.construction(words, text.CONSTRUCTIONS_BACKFILL))})


@dataclass
class TypeRule:
    property_type: str
    label: str
    enabled: bool = True
    offer_types: list[str] = field(default_factory=list)
    min_price: float | None = None
    max_price: float | None = None


@dataclass
class Admission:
    require_photos: bool = False
    min_photos: int = 1
    require_price: bool = False
    require_location: bool = False
    require_description: bool = False
    min_description_length: int = 20
    target_districts: list[str] = field(default_factory=list)
    rules: list[TypeRule] = field(default_factory=list)


def reject_reason(a: Admission) -> Column:
    """The first reason to refuse a record, null for none."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    price = F.coalesce("price", F.lit(0))
    n = F.coalesce(F.size("photos"), F.lit(0))
    checks: list[tuple[Column, Column | str]] = []
    if a.require_photos:
        checks.append(((n == 0) | (n < a.min_photos), F.format_string("Insufficient photos (have %d)", F.greatest(n, F.lit(0)))))
    if a.require_price:
        checks.append((price == 0, "Missing price"))
    if a.require_location:
        checks.append((blank("location_text"), "Missing location"))
    if a.require_description:
        checks.append((F.length(F.coalesce("description", F.lit(""))) < max(1, a.min_description_length), f"Description too short (min {a.min_description_length} chars)"))
    if a.target_districts:
        hay = F.lower(F.concat_ws(" ", "location_text", "district", "municipality", "region"))
        hit = F.exists(F.array(*(F.lit(d.lower()) for d in a.target_districts)), lambda d: F.contains(hay, d))
        checks.append((~hit, F.concat(F.lit("District not in target list: "), F.coalesce("location_text", F.lit("")))))
    kind = model.lookup(model.PROPERTY_FROM_LABEL, F.coalesce("property_type", F.lit("Ostatní")), F.col("property_type"))
    offer = model.lookup(model.OFFER_FROM_LABEL, F.coalesce("offer_type", F.lit("Sale")), F.coalesce("offer_type", F.lit("Sale")))
    for r in a.rules:
        own = F.coalesce(kind == r.property_type, F.lit(False))
        if not r.enabled:
            checks.append((own, f"{r.label.capitalize()} disabled"))
            continue
        if r.offer_types:
            checks.append((own & ~offer.isin(r.offer_types), F.concat(F.lit("Offer type "), offer, F.lit(f" not in {r.label} filter"))))
        if r.max_price:
            checks.append((own & (price > r.max_price), F.format_string(f"Price %s exceeds max {r.max_price:g}", F.col("price").cast("string"))))
        if r.min_price:
            checks.append((own & (price != 0) & (price < r.min_price), F.format_string(f"Price %s below min {r.min_price:g}", F.col("price").cast("string"))))
    return F.coalesce(*(F.when(c, why) for c, why in checks), F.lit(None).cast("string"))


def admitted(raw: DataFrame, a: Admission) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``)."""
    told = raw.withColumn("reason", reject_reason(a))
    return told.filter("reason IS NULL").drop("reason"), told.filter("reason IS NOT NULL")


def listing_id(source: Column, external: Column) -> Column:
    """The same id on every run."""
    return F.sha2(F.concat_ws("|", source, external), 256)


def mapped(raw: DataFrame, now: datetime) -> DataFrame:
    """Enum texts, cut texts, times and the id of new rows; one row a key (the last of equal ones by url, title)."""
    cut = {c: F.left(F.coalesce(c, F.lit("")), F.lit(n)) for c, n in SIZES.items()}
    stamp = F.lit(now)
    out = raw.withColumns(cut | {
        "property_type": model.property_type(F.col("property_type")), "offer_type": model.offer_type(F.col("offer_type")), "id": listing_id(F.col("source_id"), F.col("external_id")),
        "first_seen_at": stamp, "last_seen_at": stamp, "is_active": F.lit(True),
        "geocoded_at": F.when(F.col("latitude").isNotNull(), stamp), "geocode_source": F.when(F.col("latitude").isNotNull(), F.coalesce("geocode_source", F.lit("scraper"))),
    })
    return out.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in out.columns if c not in KEY)), F.struct("url", "title")).alias("_r")).select(*KEY, "_r.*")


def conform(df: DataFrame, schema: str = model.LISTING) -> DataFrame:
    """Exactly the schema's columns; absent ones are null."""
    kinds = T._parse_datatype_string(schema)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields))


def upsert(stored: DataFrame, new: DataFrame, mode: str = "complete") -> DataFrame:
    """Merge by (source_id, external_id).

    ``complete``: enriched fields survive a missing new value, the first creation date wins, coordinates bring their
    provenance.  ``replace``: the new row wins as a whole; id and first sighting stay.
    """
    o, n = conform(stored).alias("o"), conform(new).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY], "full_outer")
    seen, was = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()

    def merged(c: str) -> Column:
        old, fresh = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in ("id", "first_seen_at"):
            return F.coalesce(old, fresh)
        if c in KEY:
            return F.coalesce(fresh, old)
        if c in ("last_seen_at", "is_active") or c in REPLACED or mode == "replace":
            return F.when(seen, fresh).otherwise(old)
        if c in COMPLETED:
            return F.coalesce(fresh, old)
        if c in KEPT_FIRST:
            return F.coalesce(old, fresh)
        if c in WITH_LATITUDE:
            return F.when(seen & F.col("n.latitude").isNotNull(), fresh).otherwise(old)
        return F.when(was, old).otherwise(fresh)

    return both.select(*(merged(f.name).alias(f.name) for f in T._parse_datatype_string(model.LISTING).fields))


def price_changes(stored: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """History rows to append: first prices and changed ones; with the old price and the change in percent."""
    old = stored.select(*(F.col(k).alias(f"_{k}") for k in KEY), F.col("id").alias("_id"), F.col("price").alias("_old"))
    both = new.join(old, [F.col(k) == F.col(f"_{k}") for k in KEY], "left").filter("price IS NOT NULL AND (_old IS NULL OR _old <> price)")
    change = F.when(F.col("_old") != 0, F.bround(((F.col("price") - F.col("_old")) / F.col("_old") * 100).cast("double"), 1))
    return both.select(F.coalesce("_id", "id").alias("listing_id"), "price", F.lit(now).alias("recorded_at"), F.lit("scraper").alias("source"), F.col("_old").alias("old_price"), change.alias("change_pct"))


def first_history(listings: DataFrame, history: DataFrame) -> DataFrame:
    """One starting entry for priced listings without any."""
    return listings.filter("price IS NOT NULL").join(history.select(F.col("listing_id").alias("_h")).distinct(), F.col("id") == F.col("_h"), "left_anti").select(F.col("id").alias("listing_id"), "price", F.col("first_seen_at").alias("recorded_at"), F.lit("initial").alias("source"))


def photo_actions(stored: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per photo: insert, reorder, retry, reorder+retry, delete, keep.

    ``new``: listing_id, photos (array of addresses; the first 50 count).  Only listings in ``new`` are touched; vanished photos
    stay once they are classified.  ``tasks`` (:func:`shared.tasks_for`) is the number that the joins are dealt to, else it is the session's.
    """
    by = lambda df, *keys: df if tasks is None else df.repartition(tasks, *keys)
    key = ["listing_id", "original_url"]
    urls = by(new.select("listing_id", F.posexplode(F.slice("photos", 1, MOST_PHOTOS)).alias("idx", "original_url")), *key).groupBy(*key).agg(F.max("idx").alias("idx"))
    asked = by(new.select("listing_id"), "listing_id").distinct()
    own = by(by(stored, "listing_id").join(asked, "listing_id", "left_semi"), *key).withColumn("_stored", F.lit(True))
    both = own.join(urls.withColumn("_new", F.lit(True)), key, "full_outer")
    moved, retry = F.col("order_index") != F.col("idx"), F.col("stored_url").isNull()
    action = (
        F.when(F.col("_stored").isNull(), "insert").when(F.col("_new").isNull() & F.col("classified_at").isNull(), "delete").when(F.col("_new").isNull(), "keep")
        .when(moved & retry, "reorder+retry").when(moved, "reorder").when(retry, "retry").otherwise("keep")
    )
    return both.withColumn("action", action).drop("_stored", "_new")


def synced_photos(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The photo table after the actions; downloads fill stored_url elsewhere."""
    done = photo_actions(stored, new).filter("action <> 'delete'").withColumn("order_index", F.coalesce("idx", "order_index")).withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "listing_id", "original_url"), 256)))
    rest = stored.join(new.select("listing_id").distinct(), "listing_id", "left_anti")
    return conform(done, model.PHOTO).unionByName(conform(rest, model.PHOTO))


def deactivate_unseen(listings: DataFrame, source_code: str, seen_since: datetime, full_rescan: bool, stored_rows: int) -> DataFrame:
    """After a complete scan that stored something, what it did not see is inactive; any other run changes nothing."""
    if not (full_rescan and stored_rows > 0):
        return listings
    gone = (F.col("source_code") == source_code) & (F.col("last_seen_at") < F.lit(seen_since))
    return listings.withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active")))


def deactivate_keys(listings: DataFrame, sold: DataFrame) -> DataFrame:
    """``sold``: source_code, external_id."""
    hit = sold.select(F.col("source_code").alias("_s"), F.col("external_id").alias("_e")).distinct().withColumn("_gone", F.lit(True))
    both = listings.join(hit, (F.col("source_code") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left")
    return both.withColumn("is_active", F.when(F.col("_gone"), False).otherwise(F.col("is_active"))).select(listings.columns)


def deactivate_dead(listings: DataFrame, answers: DataFrame, now: datetime, days: int) -> DataFrame:
    """``answers``: url, http_status of probes.  404 and 410 end a stale listing; other answers renew its sighting."""
    stale = F.col("is_active") & (F.col("last_seen_at") < F.lit(now) - F.expr(f"interval {int(days)} days")) & (F.coalesce("url", F.lit("")) != "")
    own = answers.groupBy(F.col("url").alias("_u")).agg(F.max("http_status").alias("_code"))
    both = listings.join(own, F.col("url") == F.col("_u"), "left")
    asked, dead = stale & F.col("_code").isNotNull(), F.col("_code").isin(404, 410)
    return both.withColumns({"is_active": F.when(asked & dead, False).otherwise(F.col("is_active")), "last_seen_at": F.when(asked & (dead | (F.col("_code") < 400)), F.lit(now)).otherwise(F.col("last_seen_at"))}).select(listings.columns)


def is_live(status: Column) -> Column:
    return (status < 400) | (status == 403)


def purge_photos(photos: DataFrame, answers: DataFrame) -> DataFrame:
    """Photos whose address answers 404 or 410 go; server errors, 403 and 429 keep them."""
    gone = answers.filter(F.col("http_status").isin(404, 410)).select(F.col("url").alias("original_url")).distinct()
    return photos.join(gone, "original_url", "left_anti").select(photos.columns)


def latest_wins(old: DataFrame, new: DataFrame, keys: Iterable[str], at: str) -> DataFrame:
    """Union of two versions of a table, the newest row of each key."""
    keys = list(keys)
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), at, *(c for c in rest if c != at))).alias("_r")).select(*keys, "_r.*").select(old.columns)


def appended_once(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``old`` and those of ``new`` whose keys it does not hold."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(old.columns))


def completed(old: DataFrame, new: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Per column, the new value where there is one (job updates, recognised registry fields)."""
    both = old.join(new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns)), F.col(key) == F.col("_k"), "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(old.columns)


def recomputed_signals(listings: DataFrame, answers: DataFrame) -> DataFrame:
    """Reset, then set valid signals; ``answers``: listing_id, signal, reason."""
    from ..functions.jsons import price_signal

    own = answers.groupBy(F.col("listing_id").alias("_l")).agg(F.first("signal").alias("_s"), F.first("reason").alias("_w"))
    valid = price_signal(F.col("_s"))
    both = listings.join(own, F.col("id") == F.col("_l"), "left")
    asked = F.col("_l").isNotNull()
    return both.withColumns({"price_signal": F.when(asked, valid).otherwise(F.col("price_signal")), "price_signal_reason": F.when(asked, F.when(valid.isNotNull(), F.left("_w", F.lit(500)))).otherwise(F.col("price_signal_reason"))}).select(listings.columns)


def job_states(events: DataFrame) -> DataFrame:
    """Fold an event log (job_id, ts, status, progress, error_message) to the jobs' present state."""
    last = F.struct(F.col("ts"), F.col("status"))
    return events.groupBy("job_id").agg(F.min("ts").alias("created_at"), F.max_by("status", last).alias("status"), F.max("progress").alias("progress"), F.max_by("error_message", last).alias("error_message"), F.max(F.when(F.col("status").isin("Succeeded", "Failed"), F.col("ts"))).alias("finished_at"))


def jobs_listed(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    return (jobs if status is None else jobs.filter(F.col("status") == status)).orderBy(F.col("created_at").desc_nulls_last(), "job_id").limit(limit)
