"""Schemas, enum values and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LISTING = """
id string, source_id string, source_code string, source_name string, external_id string, url string, title string, description string,
property_type string, offer_type string, price decimal(15,2), price_note string, location_text string, region string, district string, municipality string,
area_built_up double, area_land double, rooms int, has_kitchen boolean, disposition string, condition string, construction_type string,
latitude double, longitude double, geocoded_at timestamp, geocode_source string, view_count int, date_created_source timestamp,
first_seen_at timestamp, last_seen_at timestamp, is_active boolean, smart_tags string, ai_normalized_data string, price_signal string, price_signal_reason string,
duplicate_of_listing_id string
"""
PHOTO = "id string, listing_id string, original_url string, stored_url string, order_index int, classified_at timestamp, photo_category string, photo_labels string, damage_detected boolean, classification_confidence decimal(3,2), photo_description string"
PRICE_HISTORY = "listing_id string, price decimal(15,2), recorded_at timestamp, source string"
USER_STATE = "user_id string, listing_id string, status string, notes string, last_updated timestamp"
ANALYSIS = "id string, listing_id string, content string, title string, source string, embedding array<float>, created_at timestamp, updated_at timestamp"
NORMALIZED = """
year_built int, floor int, total_floors int, has_elevator boolean, has_basement boolean, has_garage boolean, has_garden boolean, has_balcony boolean,
has_terrace boolean, has_pool boolean, heating_type string, energy_class string, ownership string, is_single_floor boolean, has_storage boolean, extension_possible boolean
"""

# Stored enum texts and the labels of the data sources and of the user interface.
PROPERTY_TYPES = ["House", "Apartment", "Land", "Cottage", "Commercial", "Industrial", "Garage", "Other"]
OFFER_TYPES = ["Sale", "Rent", "Auction"]
STATUSES = ["New", "Liked", "Disliked", "ToVisit", "Visited"]
PROPERTY_FROM_LABEL = {"Dům": "House", "Byt": "Apartment", "Pozemek": "Land", "Chata": "Cottage", "Komerční": "Commercial", "Průmyslový": "Industrial", "Garáž": "Garage", "Ostatní": "Other"}
OFFER_FROM_LABEL = {"Prodej": "Sale", "Pronájem": "Rent", "Dražba": "Auction"}
PROPERTY_LABELS = {"House": "Dům", "Apartment": "Byt", "Land": "Pozemek", "Cottage": "Chata/chalupa", "Commercial": "Komercí", "Industrial": "Průmyslový", "Garage": "Garáž"}
OFFER_LABELS = {"Sale": "Prodej", "Rent": "Pronájem", "Auction": "Dražba"}
STATUS_LABELS = {"Liked": "Zajímavé", "Disliked": "Nezajímavé", "ToVisit": "K návštěvě", "Visited": "Navštíveno"}
PHOTO_CATEGORIES = {"exterior": 1, "land": 2, "interior": 3, "living_room": 4, "kitchen": 5, "bathroom": 6, "bedroom": 7, "attic": 8, "basement": 9, "garage": 10, "floor_plan": 11, "damage": 12, "other": 99}
PHOTO_ALIASES = {"livingroom": "living_room", "living room": "living_room", "floorplan": "floor_plan", "floor plan": "floor_plan", "plan": "floor_plan"}


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """A map lookup; unknown and null keys give ``default`` (null if none)."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    found = F.try_element_at(table, F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, default)


def property_type(label: Column) -> Column:
    """Label or enum text to enum text; anything else is Other."""
    return lookup(PROPERTY_FROM_LABEL | {t: t for t in PROPERTY_TYPES}, label, F.lit("Other"))


def offer_type(label: Column) -> Column:
    return lookup(OFFER_FROM_LABEL | {t: t for t in OFFER_TYPES}, label, F.lit("Sale"))


def parse_enum(text: str | None, values: list[str]) -> str | None:
    """Case-insensitive parse of a filter value; None (no predicate) if it is not one."""
    return next((v for v in values if text and v.lower() == text.strip().lower()), None)
