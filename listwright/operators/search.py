"""The listing search: predicates, sorting, paging, projections."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text


@dataclass
class ListingFilter:
    """Every clause is used only when its value is set; clauses are joined by AND."""

    page: int = 1
    page_size: int = 50
    sources: list[str] = field(default_factory=list)
    region: str | None = None
    district: str | None = None
    municipality: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    built_min: float | None = None
    built_max: float | None = None
    land_min: float | None = None
    land_max: float | None = None
    property_type: str | None = None
    offer_type: str | None = None
    disposition: str | None = None
    conditions: list[str] = field(default_factory=list)
    constructions: list[str] = field(default_factory=list)
    rooms_min: int | None = None
    rooms_max: int | None = None
    first_seen_from: datetime | None = None
    user_status: str | None = None
    lat_min: float | None = None
    lat_max: float | None = None
    lon_min: float | None = None
    lon_max: float | None = None
    search_text: str | None = None
    sort_by: str | None = None
    descending: bool = False


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def area_name(column: str, value: str) -> Column:
    """The column or the free location text, wildcards of the value included."""
    return (F.col(column).isNotNull() & F.col(column).ilike(f"%{value}%")) | F.col("location_text").ilike(f"%{value}%")


def between(column: str, lo, hi) -> list[Column]:
    """One predicate per set bound; null fails both."""
    return ([F.col(column) >= F.lit(lo)] if lo is not None else []) + ([F.col(column) <= F.lit(hi)] if hi is not None else [])


def matches_text(query: str | None, *columns: str) -> Column:
    """All words of the query occur among the words of the columns; a blank query matches everything."""
    words = sorted({w for w in "".join(c if c.isalnum() else " " for c in (query or "").lower()).split()})
    if not words:
        return F.lit(True)
    own = text.lexemes(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    return F.size(F.array_except(F.array(*map(F.lit, words)), own)) == 0


def predicate(f: ListingFilter) -> Column:
    """Everything but the user's status, which is a join."""
    p = [F.col("is_active")]
    p += [F.col("source_code").isin(f.sources)] if f.sources else []
    p += [area_name(c, v) for c, v in (("region", f.region), ("district", f.district), ("municipality", f.municipality)) if v and v.strip()]
    p += between("price", f.price_min, f.price_max) + between("area_built_up", f.built_min, f.built_max) + between("area_land", f.land_min, f.land_max)
    for column, value, values in (("property_type", f.property_type, model.PROPERTY_TYPES), ("offer_type", f.offer_type, model.OFFER_TYPES)):
        if known := model.parse_enum(value, values):
            p.append(F.col(column) == known)
    p += [F.lower("disposition") == f.disposition.lower()] if f.disposition else []
    p += [F.col("condition").isin(f.conditions)] if f.conditions else []
    p += [F.col("construction_type").isin(f.constructions)] if f.constructions else []
    p += between("rooms", f.rooms_min, f.rooms_max)
    p += [F.col("first_seen_at") >= F.lit(f.first_seen_from)] if f.first_seen_from else []
    p += between("latitude", f.lat_min, f.lat_max) + between("longitude", f.lon_min, f.lon_max)
    return all_of([*p, matches_text(f.search_text, "title", "location_text", "description")])


def with_status(listings: DataFrame, states: DataFrame, user: str, status: str) -> DataFrame:
    """Listings for which the user has stored this status (New included: a missing row is not a stored New)."""
    own = states.filter((F.col("user_id") == user) & (F.col("status") == status)).select(F.col("listing_id").alias("_own"))
    return listings.join(own, F.col("id") == F.col("_own"), "left_semi")


def filtered(listings: DataFrame, f: ListingFilter, states: DataFrame | None = None, user: str = "default") -> DataFrame:
    out = listings.filter(predicate(f))
    return with_status(out, states, user, f.user_status) if f.user_status and states is not None else out


# Sort names and their columns; nullable ones put nulls last either way.
SORTS = {"price": "price", "area": "area_built_up", "land": "area_land", "date": "first_seen_at", "title": "title", "location": "location_text"}


def ordering(sort_by: str | None, descending: bool) -> list[Column]:
    if column := SORTS.get((sort_by or "").lower()):
        return [F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last(), F.col("id").asc()]
    return [F.col("first_seen_at").desc_nulls_first(), F.col("price").asc_nulls_last(), F.col("id").asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Skip and take under a total order; pages below 1 are the first."""
    skip = max(0, (number - 1) * size)
    out = df.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(size)


def search(listings: DataFrame, f: ListingFilter, states: DataFrame | None = None, user: str = "default") -> tuple[DataFrame, DataFrame]:
    """(items of the page, one row with the total before paging)."""
    hits = filtered(listings, f, states, user)
    return page(hits, ordering(f.sort_by, f.descending), f.page, f.page_size), hits.agg(F.count("*").alias("total"))


def array_page(values: Column, number: int, size: int) -> Column:
    """A page of an array: sizes 1 to 20, pages past the end give the last one."""
    size = min(20, max(1, size))
    pages = F.greatest(F.lit(1), F.ceil(F.size(values) / size)).cast("int")
    at = F.least(F.greatest(F.lit(number), F.lit(1)), pages)
    return F.slice(values, (at - 1) * size + 1, size)


# --- children, one row a listing, so that no join multiplies rows


def first_photo(photos: DataFrame) -> DataFrame:
    """Thumbnail: stored or original address of the photo with the smallest order."""
    return photos.groupBy("listing_id").agg(F.min_by(F.coalesce("stored_url", "original_url"), F.struct("order_index", "id")).alias("thumbnail"))


def main_photo(photos: DataFrame) -> DataFrame:
    """Photos at order 0; a listing may have none or several."""
    return photos.filter("order_index = 0").select("listing_id", F.col("original_url").alias("main_photo_url"))


def photo_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy("listing_id").agg(F.count("*").alias("photo_count"), F.min(F.when(F.col("order_index") == 0, F.col("original_url"))).alias("main_photo_url"))


def nested_photos(photos: DataFrame, *columns: str) -> DataFrame:
    own = F.struct("order_index", "id", "original_url", "stored_url", *columns)
    return photos.groupBy("listing_id").agg(F.array_sort(F.collect_list(own)).alias("photos"))


def user_state(states: DataFrame, user: str) -> DataFrame:
    return states.filter(F.col("user_id") == user).groupBy("listing_id").agg(F.max_by(F.struct("status", "notes", "last_updated"), "last_updated").alias("state"))


def beside(listings: DataFrame, child: DataFrame) -> DataFrame:
    return listings.join(child.withColumnRenamed("listing_id", "_child"), F.col("id") == F.col("_child"), "left").drop("_child")


def summaries(listings: DataFrame, photos: DataFrame, states: DataFrame, user: str = "default") -> DataFrame:
    """Listing cards: thumbnail, status (New without a row), whether there are notes."""
    out = beside(beside(listings, first_photo(photos)), user_state(states, user))
    return out.withColumns({"user_status": F.coalesce("state.status", F.lit("New")), "has_notes": F.coalesce(F.length(F.trim("state.notes")) > 0, F.lit(False))}).drop("state")


def details(listings: DataFrame, photos: DataFrame, states: DataFrame, user: str = "default") -> DataFrame:
    """All columns with sorted photos and the user's state; duplicates borrow title, source and state of their primary."""
    out = beside(beside(listings, nested_photos(photos)), user_state(states, user))
    first = beside(listings, user_state(states, user)).select(F.col("id").alias("_pid"), F.col("title").alias("_pt"), F.col("source_name").alias("_ps"), F.col("state").alias("_pu"), F.lit(True).alias("_is"))
    # Listings without a primary would all meet in one task by their null: they go by their own id, and match nothing.
    out = out.withColumns({"_of": effective_id(), "_has": F.col("duplicate_of_listing_id").isNotNull()})
    out = out.join(first, (F.col("_of") == F.col("_pid")) & (F.col("_has") == F.col("_is")), "left").drop("_of", "_has", "_is")
    return out.withColumns({"primary_title": F.coalesce("_pt", "title"), "primary_source": F.coalesce("_ps", "source_name"), "state": F.coalesce("state", "_pu")}).drop("_pid", "_pt", "_ps", "_pu")


def effective_id() -> Column:
    return F.coalesce("duplicate_of_listing_id", "id")


def by_id(listings: DataFrame, value: str) -> DataFrame:
    return listings.filter(F.col("id") == value)


def by_natural_key(listings: DataFrame, source_id: str, external: str) -> DataFrame:
    return listings.filter((F.col("source_id") == source_id) & (F.col("external_id") == external))


def active(listings: DataFrame, source_id: str | None = None) -> DataFrame:
    out = listings.filter("is_active")
    return out if source_id is None else out.filter(F.col("source_id") == source_id)


def sources(table: DataFrame, only_active: bool = False) -> DataFrame:
    return (table.filter("is_active") if only_active else table).select("id", "code", "name", "is_active").orderBy("name", "code")
