"""JSON hidden in text: fences, islands, strict flags, salvage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import first_group


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z]*\s*\n?|\n?\s*```\s*$", ""))


def object_island(text: Column) -> Column:
    """First { to last }, null unless that is valid JSON."""
    found = first_group(strip_fences(text), r"(?s)(\{.*\})")
    return F.when(F.try_parse_json(found).isNotNull(), found)


def array_island(text: Column) -> Column:
    found = first_group(strip_fences(text), r"(?s)(\[.*\])")
    return F.when(F.try_parse_json(found).isNotNull(), found)


def tags(text: Column, most: int = 5) -> Column:
    return F.slice(F.from_json(array_island(text), "array<string>"), 1, most)


def is_true(json: Column, key: str) -> Column:
    """The value is the JSON literal true; the string "true" and malformed JSON are not."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def first_key(json: Column, *keys: str) -> Column:
    """Value of the first key present."""
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys))


def salvage(raw: Column) -> Column:
    """Fields of a photo classification whose JSON was cut off; null without a category."""
    cat = first_group(raw, r'"category"\s*:\s*"([^"]+)"')
    return F.when(cat.isNotNull(), F.struct(cat.alias("category"), F.trim(first_group(raw, r'"description"\s*:\s*"((?:[^"\\]|\\.)*)')).alias("description"), F.coalesce(first_group(raw, r'"damage_detected"\s*:\s*(true|false)') == "true", F.lit(False)).alias("damage_detected"), first_group(raw, r'"confidence"\s*:\s*([0-9.]+)').try_cast("double").alias("confidence")))


def price_signal(signal: Column) -> Column:
    low = F.lower(F.trim(signal))
    return F.when(low.isin("low", "fair", "high"), low)
