"""CSV, JSON, Markdown and JSON Lines sinks, as text columns and folders of text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import price_display

CSV_LIMIT = 5000
# The number of photos here, and the labels of the documents in this module.
PHOTO_LIMIT = 50
# The header of the export file.
CSV_HEADER = "ID;Zdroj;Název;Typ;Nabídka;Dispozice;Cena (Kč);Užitná plocha (m2);Pozemek (m2);Lokalita;Kraj;Okres;Obec;Datum nalezení;Můj stav"


def whole(c: str) -> Column:
    """A number without decimals, empty for null."""
    return F.coalesce(F.format_string("%.0f", F.col(c).cast("double")), F.lit(""))


def csv_lines(rows: DataFrame, order: Sequence[Column] | None = None, limit: int | None = CSV_LIMIT) -> DataFrame:
    """id, line: semicolon-separated, fields quoted only where needed."""
    f = lambda c: text.csv_field(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = rows.orderBy(*order) if order else rows
    out = out.limit(limit) if limit else out
    fields = [f("id"), f("source_name"), f("title"), text.csv_field(text.translate_property(F.col("property_type"))), text.csv_field(text.translate_offer(F.col("offer_type"))), f("disposition"), whole("price"), whole("area_built_up"), whole("area_land"), f("location_text"), f("region"), f("district"), f("municipality"), F.coalesce(F.date_format("first_seen_at", "yyyy-MM-dd"), F.lit("")), text.csv_field(text.translate_status(F.col("user_status")))]
    return out.select("id", F.concat_ws(";", *fields).alias("line"))


def write_csv(lines: DataFrame, path: str) -> None:
    """One file with byte order mark and header: bounded by the export's row limit."""
    head = lines.sparkSession.createDataFrame([(0, "﻿" + CSV_HEADER)], "k int, line string")
    head.unionByName(lines.withColumn("k", F.lit(1)).select("k", "line")).coalesce(1).sortWithinPartitions("k", "line").select("line").write.mode("overwrite").text(path)


def data_json(listings: DataFrame) -> DataFrame:
    """id, json; ``listings`` carries photos (array of structs with order_index and original_url)."""
    urls = F.transform(F.coalesce("photos", F.array().cast(listings.schema["photos"].dataType)), lambda p: p["original_url"])
    body = F.struct(
        "id", "title", "property_type", "offer_type", "price", "price_note", "location_text", "municipality", "district", "region", F.col("area_built_up").alias("area_built_up_m2"), F.col("area_land").alias("area_land_m2"),
        "rooms", "has_kitchen", "construction_type", "condition", "source_name", "source_code", "url", "description", "first_seen_at", F.size(urls).alias("photos_count"), urls.alias("photo_urls"),
        F.when(text.is_new_build(F.col("condition"), F.col("description")), "new_build").otherwise("existing").alias("age_category"),
    )
    return listings.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def photo_links(photos: Column) -> Column:
    """The first 50 photos, those with an address, named by position with a known extension."""
    first = F.filter(F.slice(photos, 1, PHOTO_LIMIT), lambda p: F.trim(F.coalesce(p["stored_url"], p["original_url"])) != "")
    known = lambda u: F.coalesce(F.nullif(F.lower(F.regexp_extract(u, r"(?i)(\.(?:jpg|jpeg|png|webp))(?:[?#].*)?$", 1)), F.lit("")), F.lit(".jpg"))
    return F.transform(first, lambda p, i: F.struct(F.concat(F.format_string("foto_%02d", i + 1), known(p["original_url"])).alias("name"), F.coalesce(p["stored_url"], p["original_url"]).alias("direct_url"), p["original_url"].alias("source_url")))


def row(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (F.trim(value) != ""), F.concat(F.lit(f"| **{label}** | "), value, F.lit(" |")))


def info_markdown(stamp: str) -> Column:
    s = lambda c: F.col(c).cast("string")
    price = F.concat_ws(" ", F.when(F.col("price").isNotNull(), F.concat(F.format_number("price", 0), F.lit(" Kč"))).otherwise("neuvedena"), s("price_note"))
    metres = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%s m²", s(c)))
    links = F.array_join(F.transform(photo_links(F.col("photos")), lambda p: F.concat(F.lit("- ["), p["name"], F.lit("]("), p["direct_url"], F.lit(")"))), "\n")
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), F.col("title"), F.lit(f"\n\n> Exportováno: {stamp}\n\n## Základní informace\n\n| Parametr | Hodnota |\n|---|---|")),
        row("Typ nemovitosti", s("property_type")), row("Typ nabídky", s("offer_type")), row("Cena", price), row("Lokalita", s("location_text")), row("Obec", s("municipality")), row("Okres", s("district")), row("Kraj", s("region")),
        row("Užitná plocha", metres("area_built_up")), row("Plocha pozemku", metres("area_land")), row("Počet pokojů", s("rooms")), row("Typ konstrukce", s("construction_type")), row("Stav", s("condition")),
        row("Zdroj", F.concat(s("source_name"), F.lit(" ("), s("source_code"), F.lit(")"))), row("URL inzerátu", F.concat(F.lit("["), s("url"), F.lit("]("), s("url"), F.lit(")"))), row("Poprvé viděno", F.date_format("first_seen_at", "dd.MM.yyyy")),
        F.lit("\n## Popis\n"), F.coalesce(s("description"), F.lit("_Bez popisu_")), F.lit("\n## Fotky\n"), links,
    )


def instructions(listings: DataFrame, new_build: str, existing: str, folder_url: str | None = None) -> DataFrame:
    """id, text: a template by age with its placeholders filled; templates are parameters."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    m = lambda c, tail: F.when(F.col(c).isNotNull(), F.format_string(f"%s m² {tail}", F.col(c).cast("string")))
    opt = lambda label, c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"**{label}:** "), s(c), F.lit("\n"))).otherwise("")
    links = photo_links(F.col("photos"))
    shown = F.array_join(F.transform(F.slice(links, 1, 10), lambda p: F.concat(F.lit("- ["), p["name"], F.lit("]("), p["source_url"], F.lit(")"))), "\n")
    more = F.when(F.size(links) > 10, F.format_string("\n- … +%d", F.size(links) - 10)).otherwise("")
    values = {
        "LOCATION": F.concat_ws(", ", s("location_text"), F.nullif("municipality", F.lit("")), F.concat(F.lit("okres "), F.nullif("district", F.lit(""))), F.nullif("region", F.lit(""))), "PROPERTY_TYPE": s("property_type"), "OFFER_TYPE": s("offer_type"),
        "PRICE": F.coalesce(F.concat(F.format_number("price", 0), F.lit(" Kč")), F.lit("neuvedena")), "PRICE_NOTE": F.when(F.trim("price_note") != "", F.concat(F.lit(" ("), F.col("price_note"), F.lit(")"))).otherwise(""),
        "AREA": F.coalesce(F.nullif(F.concat_ws(" / ", m("area_built_up", "užitná"), m("area_land", "pozemek")), F.lit("")), F.lit("neuvedena")), "ROOMS_LINE": opt("Počet pokojů", "rooms"), "CONSTRUCTION_TYPE_LINE": opt("Typ konstrukce", "construction_type"), "CONDITION_LINE": opt("Stav dle inzerátu", "condition"),
        "SOURCE_NAME": s("source_name"), "SOURCE_CODE": s("source_code"), "URL": s("url"), "PHOTO_LINKS_SECTION": F.when(F.size(links) > 0, F.concat(shown, more)).otherwise(""), "DRIVE_FOLDER_SECTION": F.lit(folder_url or ""),
    }
    out = F.when(text.is_new_build(F.col("condition"), F.col("description")), new_build).otherwise(existing)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return listings.select("id", out.alias("text"))


def batch(listings: DataFrame, region: str | None, price_max: float | None, active_only: bool, limit: int) -> DataFrame:
    """Case-sensitive region part, price bound, newest first."""
    out = listings
    if region:
        out = out.filter(F.col("region").contains(region))
    if price_max is not None:
        out = out.filter(F.col("price") <= price_max)
    if active_only:
        out = out.filter("is_active")
    return out.orderBy(F.col("first_seen_at").desc(), "id").limit(limit)


def batch_markdown(rows: DataFrame) -> DataFrame:
    """One document: a numbered table of contents, then a section a listing; bounded by the batch's limit."""
    item = F.struct(F.col("first_seen_at").alias("at"), "id", "title", price_display(F.col("price")).alias("p"), F.coalesce("description", F.lit("")).alias("d"))
    own = rows.agg(F.reverse(F.array_sort(F.collect_list(item))).alias("x"))
    toc = F.array_join(F.transform("x", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["title"], F.lit(" – "), r["p"])), "\n")
    body = F.array_join(F.transform("x", lambda r, i: F.concat(F.lit("\n## "), (i + 1).cast("string"), F.lit(". "), r["title"], F.lit("\n\n"), r["d"])), "\n")
    return own.select(F.concat_ws("\n", toc, body).alias("markdown"))


def as_html(markdown: Column) -> Column:
    """A minimal page: escaped text, headings as elements."""
    safe = F.replace(F.replace(F.replace(markdown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('<html><meta charset="utf-8"><body><pre>'), F.regexp_replace(safe, r"(?m)^#+ (.*)$", "<b>$1</b>"), F.lit("</pre></body></html>"))


def area_json(members: DataFrame, areas: DataFrame) -> DataFrame:
    """area_id, json: the area's settings, number and sorted list of its municipalities."""
    own = members.groupBy("area_id").agg(F.array_sort(F.collect_set("name")).alias("municipalities"))
    both = areas.join(own, "area_id", "left").withColumn("municipalities", F.coalesce("municipalities", F.array().cast("array<string>")))
    rest = [c for c in areas.columns if c != "area_id"]
    return both.select("area_id", F.to_json(F.struct(F.col("area_id").alias("name"), *rest, F.size("municipalities").alias("municipalityCount"), "municipalities")).alias("json"))
