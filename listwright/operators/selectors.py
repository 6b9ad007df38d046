"""Work lists: which rows still need a step; each ends in a bounded, repeatable batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINE = ["Liked", "ToVisit", "Visited"]


def newest(df: DataFrame, n: int, oldest_first: bool = False, most: int | None = 50) -> DataFrame:
    n = min(most, max(1, n)) if most else n
    return df.orderBy(F.col("first_seen_at").asc_nulls_last() if oldest_first else F.col("first_seen_at").desc_nulls_last(), "id").limit(n)


def needs(listings: DataFrame, column: str, n: int, condition: Column, force: bool = False, oldest_first: bool = False) -> DataFrame:
    """Active listings that meet the condition and lack the column's value (unless forced)."""
    own = listings.filter(F.col("is_active") & condition)
    return newest(own if force else own.filter(F.col(column).isNull()), n, oldest_first)


def needs_tags(listings: DataFrame, n: int, **how) -> DataFrame:
    return needs(listings, "smart_tags", n, F.length("description") > 50, **how)


def needs_normalizing(listings: DataFrame, n: int, **how) -> DataFrame:
    return needs(listings, "ai_normalized_data", n, F.length("description") > 100, **how)


def needs_price_opinion(listings: DataFrame, n: int, **how) -> DataFrame:
    return needs(listings, "price_signal", n, F.col("price") > 0, **how)


def of_mine(photos: DataFrame, states: DataFrame) -> DataFrame:
    own = states.filter(F.col("status").isin(MINE)).select("listing_id").distinct()
    return photos.join(own, "listing_id", "left_semi")


def unclassified(photos: DataFrame, n: int, states: DataFrame | None = None) -> DataFrame:
    own = photos.filter("classified_at IS NULL AND coalesce(stored_url, original_url) IS NOT NULL")
    return (own if states is None else of_mine(own, states)).orderBy("listing_id", "order_index", "id").limit(n)


def not_stored(photos: DataFrame, n: int, states: DataFrame | None = None) -> DataFrame:
    own = photos.filter("stored_url IS NULL")
    return (own if states is None else of_mine(own, states)).orderBy("listing_id", "order_index", "id").limit(n)


def without_auto_analysis(listings: DataFrame, analyses: DataFrame) -> DataFrame:
    have = analyses.filter("source = 'auto'").select(F.col("listing_id").alias("_h")).distinct()
    return listings.filter("is_active").join(have, F.col("id") == F.col("_h"), "left_anti")


def without_cadastre(listings: DataFrame, cadastre: DataFrame, n: int, settled: tuple[str, ...] = ("found", "manual", "not_found")) -> DataFrame:
    """Listings without a settled registry row."""
    done = cadastre.filter(F.col("fetch_status").isin(*settled)).select(F.col("listing_id").alias("_h")).distinct()
    return newest(listings.filter("is_active").join(done, F.col("id") == F.col("_h"), "left_anti"), n, most=None)


def without_cadastre_batch(listings: DataFrame, cadastre: DataFrame, n: int, again: bool = False) -> DataFrame:
    """The batch job's rule: any status but pending and error (and, asked so, not_found) settles a listing."""
    open_ = ["pending", "error"] + (["not_found"] if again else [])
    done = cadastre.filter(~F.col("fetch_status").isin(open_)).select(F.col("listing_id").alias("_h")).distinct()
    return newest(listings.filter("is_active").join(done, F.col("id") == F.col("_h"), "left_anti"), n, most=None)


def without_location(listings: DataFrame, n: int) -> DataFrame:
    return newest(listings.filter("is_active AND latitude IS NULL AND coalesce(location_text, '') <> ''"), n, most=None)


def stale(listings: DataFrame, now: datetime, days: int) -> DataFrame:
    return listings.filter(F.col("is_active") & (F.col("last_seen_at") < F.lit(now) - F.expr(f"interval {int(days)} days")) & (F.coalesce("url", F.lit("")) != "")).select("id", "url", "last_seen_at")


def valid_feedback(c: Column) -> Column:
    return c.isNull() | c.isin("correct", "wrong")


def upload_allowed(name: Column, size: Column, most: int = 10 << 20) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(".jpg", ".jpeg", ".png", ".webp", ".heic") & (size <= most)


def on_corridor(municipality: Column, location: Column, names: list[str]) -> Column:
    """The municipality is one of ``names``, or the location text contains one; cases ignored."""
    low = [n.lower() for n in names]
    return F.coalesce(F.lower(municipality).isin(low), F.lit(False)) | F.coalesce(F.exists(F.array(*map(F.lit, low)), lambda n: F.contains(F.lower(location), n)), F.lit(False))


def target_score(names: list[str], price_max: float = 7_500_000, area_min: float = 100.0, rooms_min: int = 4) -> Column:
    """0 to 5: price, area, rooms, corridor, garden."""
    from ..functions.jsons import is_true

    marks = [F.col("price") <= price_max, F.col("area_built_up") >= area_min, F.col("rooms") >= rooms_min, on_corridor(F.col("municipality"), F.col("location_text"), names), is_true(F.col("ai_normalized_data"), "has_garden")]
    return sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks[1:]), F.coalesce(marks[0], F.lit(False)).cast("int"))
