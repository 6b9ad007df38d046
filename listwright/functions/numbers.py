"""Numbers out of text, prices per area, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The area unit here, and the labels and number forms in the patterns of this module.
#: Blanks inside numbers: white space, no-break, narrow no-break and zero-width joiners.
GAP = r"[\s  ‍]"
AREA_UNIT = r"(?:m[²2]|㎡)"


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return nullif_empty(F.regexp_extract(text, pattern, group))


def digits(text: Column, kind: str = "decimal(15,0)") -> Column:
    """All digits of the text as one number; null without digits or when too long."""
    return nullif_empty(F.regexp_replace(text, "[^0-9]", "")).try_cast(kind)


def price_labelled(text: Column) -> Column:
    """Price after its label, else the first amount of four digits and more that is at least 1000."""
    near = digits(first_group(text, rf"(?iu)Cena\s*:\s*([0-9](?:[0-9]|{GAP})*){GAP}*Kč"))
    any_ = digits(first_group(text, rf"([0-9]{{4}}(?:[0-9]|{GAP})*){GAP}*Kč"))
    return F.coalesce(near, F.when(any_ >= 1000, any_))


def price_sane(text: Column, lo: int = 10_000, hi: int = 500_000_000) -> Column:
    """Digits of the text if they make a plausible price."""
    v = digits(first_group(F.translate(text, "‍ ", "  "), r"([0-9][0-9\s]*)"))
    return F.when(v.between(lo, hi), v)


def area_first(text: Column) -> Column:
    """First run of digits, blanks inside allowed."""
    return digits(first_group(text, rf"([0-9](?:[0-9]|{GAP})*)"), "int")


def area_thousands(text: Column) -> Column:
    """``2.059 m2`` is 2059; the unit's digit is not part of it."""
    return digits(F.regexp_replace(text, rf"(?iu){AREA_UNIT}", ""), "double")


def areas_inferred(title: Column, description: Column, kind: Column) -> tuple[Column, Column]:
    """(built-up, land): keywords first, then the first area of the description, then the title's."""
    text = F.concat_ws(" ", title, description)
    land = F.regexp_replace(first_group(text, rf"(?iu)(?:pozemk(?:u|em|y|ů|a)|zahrad(?:a|e|y|ou)|parcel)\s+(?:o\s+(?:výměře|velikosti|ploše)\s+)?([0-9][0-9\s.]+)\s*{AREA_UNIT}"), r"[\s.]", "").try_cast("double")
    land = F.when(land.between(10, 100_000), land)
    built = first_group(text, rf"(?iu)(?:zastav[eě]n[oaáíé]+\s+(?:plochou?|plochem?)|u[žz]itn[aáíé]+\s+(?:plochou?|plochem?))[^0-9]*([0-9]{{2,5}})\s*{AREA_UNIT}").try_cast("double")
    built = F.when(built.between(10, 2000), built)
    in_text = first_group(description, rf"([0-9]{{2,5}})\s*{AREA_UNIT}").try_cast("double")
    in_text = F.when(built.isNull() & in_text.between(10, 5000), in_text)
    plot = F.coalesce(kind == "Pozemek", F.lit(False))
    land1 = F.coalesce(land, F.when(plot, in_text))
    built1 = F.coalesce(built, F.when(~(plot & land.isNull()), in_text))
    in_title = first_group(title, rf"([0-9]{{2,5}})\s*{AREA_UNIT}").try_cast("double")
    in_title = F.when(built1.isNull() & land1.isNull() & in_title.between(10, 100_000), in_title)
    return F.coalesce(built1, F.when(~plot, in_title)), F.coalesce(land1, F.when(plot, in_title))


def area_by_strategies(heading_value: Column, text: Column) -> Column:
    """Value beside an area heading, else a labelled area, else a lone area between 10 and 2000."""
    labelled = first_group(text, rf"(?iu)(?:plocha|výměra)[^0-9]{{0,20}}([0-9][0-9\s]*)\s*{AREA_UNIT}")
    lone = first_group(text, rf"(?:^|[^0-9])([0-9]{{2,4}})\s*{AREA_UNIT}").try_cast("int")
    return F.coalesce(area_first(heading_value), digits(labelled, "int"), F.when((lone > 10) & (lone < 2000), lone))


def per_area(price: Column, built: Column, land: Column) -> Column:
    """Price per square metre; built-up area when above 0, else land; null when neither is."""
    area = F.when(built > 0, built).otherwise(land)
    return F.when(area > 0, price / area)


def per_area_batch(price: Column, built: Column, land: Column) -> Column:
    return price / F.coalesce(F.nullif(built, F.lit(0.0)), F.nullif(land, F.lit(0.0)))


def price_display(price: Column, missing: str = "neuvedena") -> Column:
    """Millions with one digit, thousands without, a label for null; decimals, ties away from zero."""
    exact = price.cast("decimal(20,4)")
    millions = F.round(exact / 1_000_000, 1).cast("decimal(20,1)").cast("string")
    thousands = F.round(exact / 1000, 0).cast("decimal(20,0)").cast("string")
    return F.when(price.isNull(), missing).when(price >= 1_000_000, F.concat(millions, F.lit(" M"))).otherwise(F.concat(thousands, F.lit(" k")))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def percent(part: Column, whole: Column, scale: int = 1) -> Column:
    """Half-even rounded percentage; 0 when there is nothing to share."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(100.0 * part / whole, scale))


def percent_change(old: Column, new: Column) -> Column:
    """Null when there is no old price or it is 0."""
    return F.when(old != 0, F.bround(((new - old) / old * 100).cast("double"), 1))


def areas_agree(registry: Column, listed: Column, tolerance: float = 0.05) -> Column:
    return F.abs(registry - listed) / F.greatest(F.lit(1), listed) < tolerance
