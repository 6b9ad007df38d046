"""JSON inside pages and paged JSON feeds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.geo import in_box_or_unknown
from ..functions.numbers import first_group
from .html import bound, distinct_by

ESTATE = "struct<id:string,listingType:string,status:string,slug:string,title:string,description:string,price:double,area:double,landArea:double,localityCity:string,localityRegion:string,images:array<string>,sourcePayload:struct<estate:struct<advert_type:int>>>"


class JsonPages(DataSource):
    """``spark.read.format("json_pages")`` or ``readStream``: a folder of files ``<n>.json``, one feed page each.

    Options: path (any store that Arrow knows), per_page, group.  Pages are numbered from 1 and announce the total
    of items; a group of pages is one partition.  Conditions on ``page`` choose the pages that are read at all (with
    spark.sql.python.filterPushdown.enabled).  A stream hands out every item once, by its place in the feed, so a last
    page that fills up later loses nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page int, total long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(self.options)


class _Pages:
    def __init__(self, options):
        self.path, self.size, self.group = options["path"].rstrip("/"), int(options.get("per_page", 60)), int(options.get("group", 16))

    def load(self, page: int) -> dict:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        try:
            with store.open_input_stream(f"{folder}/{page}.json") as f:
                return json.loads(f.read().decode())
        except (FileNotFoundError, ValueError):
            return {}

    def total(self) -> int:
        return int(self.load(1).get("total", 0))

    def rows(self, first: int, last: int) -> Iterator[tuple[int, int, int, str]]:
        """(place in the feed, page, total, item) of pages ``first`` to ``last``; ends at an empty page."""
        for page in range(first, last + 1):
            found = self.load(page)
            if not found.get("items"):
                return
            for k, item in enumerate(found["items"]):
                yield (page - 1) * self.size + k, page, int(found.get("total", 0)), json.dumps(item, ensure_ascii=False)


class _PageReader(_Pages, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.first, self.last = 1, 1 << 31

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("page",) or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.last = min(self.last, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        last = min(self.last, max(1, -(-self.total() // self.size)))
        return [InputPartition((p, min(p + self.group - 1, last))) for p in range(self.first, last + 1, self.group)] or [InputPartition((1, 0))]

    def read(self, partition) -> Iterator[tuple]:
        for _, *row in self.rows(*partition.value):
            yield tuple(row)


class _PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        return {"items": self.total()}

    def partitions(self, start: dict, end: dict):
        a, b, step = start["items"], end["items"], self.size * self.group
        cuts = [a, *range((a // step + 1) * step, b, step), b]
        return [InputPartition(x) for x in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition) -> Iterator[tuple]:
        a, b = partition.value
        for place, *row in self.rows(a // self.size + 1, -(-b // self.size)):
            if a <= place < b:
                yield tuple(row)


def decoded(markup: str | None, marker: str = '"listings":') -> list[dict]:
    """Rows of a page whose script pushes string chunks: joined, unescaped, decoded from the array after the marker.

    Descriptions may be references ``$id`` to chunks that begin ``id:Tlength,`` with both numbers in hex.
    """
    import re

    joined = ""
    for chunk in re.findall(r"push\(\[1,\s*(\"(?:[^\"\\]|\\.)*\")\]\)", markup or "", re.S):
        try:
            joined += json.loads(chunk)
        except ValueError:
            continue
    at = joined.find(marker)
    at = joined.find("[", at) if at >= 0 else -1
    if at < 0:
        return []
    try:
        rows, _ = json.JSONDecoder().raw_decode(joined[at:])
    except ValueError:
        return []
    data = joined.encode()
    for row in (r for r in rows if isinstance(r, dict)):
        ref = re.fullmatch(r"\$([0-9a-f]+)", str(row.get("description") or ""))
        if ref and (m := re.search(rb"(?:^|\n)" + ref[1].encode() + rb":T([0-9a-f]+),", data)):
            row["description"] = data[m.end() : m.end() + int(m[1], 16)].decode("utf-8", "replace")
    return [r for r in rows if isinstance(r, dict)]


def pushed_rows(markup: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda m: [json.dumps(r, ensure_ascii=False) for r in decoded(m)])

    return F.pandas_udf(run, "array<string>")(markup)


def estates(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(pushed_rows(F.coalesce("html", F.lit("")))).alias("j")).select(F.from_json("j", ESTATE).alias("e")).select("e.*")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def estate_listings(rows: DataFrame, base: str) -> DataFrame:
    """Offers that are still open and have slug and id; numbers above 0; at most 20 picture addresses."""
    own = rows.filter(~F.coalesce(F.upper("status"), F.lit("")).isin("SOLD", "RESERVED") & (F.coalesce("slug", F.lit("")) != "") & F.col("id").isNotNull())
    return own.select(
        F.col("id").alias("external_id"), F.concat(F.lit(base.rstrip("/") + "/"), F.col("slug")).alias("url"), "title", "description", positive(F.col("price")).cast("decimal(15,2)").alias("price"), positive(F.col("area")).alias("area_built_up"), positive(F.col("landArea")).alias("area_land"),
        F.concat_ws(", ", F.nullif("localityCity", F.lit("")), F.nullif("localityRegion", F.lit(""))).alias("location_text"), F.slice(F.filter("images", lambda u: u.startswith("http")), 1, 20).alias("photos"),
        F.when(F.col("sourcePayload.estate.advert_type") == 2, "Rent").otherwise("Sale").alias("offer_type"),
    )


def next_data(markup: Column) -> Column:
    """The page's embedded state as text, null unless it is JSON."""
    found = first_group(markup, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>')
    return bound(found, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))


def ads(markup: Column) -> Column:
    """(total, items as JSON texts) of a list page; either of two keys holds the items."""

    def read(found: Column) -> Column:
        items = F.coalesce(F.get_json_object(found, "$.ads"), F.get_json_object(found, "$.data"))
        return F.when(found.isNotNull(), F.struct(F.get_json_object(found, "$.totalCount").cast("int").alias("total"), F.transform(F.from_json(items, "array<variant>"), lambda v: F.to_json(v)).alias("items")))

    # The state is found and parsed once, its list alone is looked into again.
    return bound(bound(next_data(markup), lambda state: F.get_json_object(state, "$.props.pageProps.adsListResult")), read)


def ad_description(markup: Column, html_text: Column, size: int = 4000) -> Column:
    return F.left(F.coalesce(F.get_json_object(next_data(markup), "$.props.pageProps.adEstateDetail.description"), F.when(F.length(html_text) > 50, html_text)), F.lit(size))


AD = "struct<_id:string,title:string,type:string,disposition:string,price:double,originalPrice:double,utilityArea:double,cadastralArea:double,address:string,isAnonymous:boolean,location:struct<coordinates:array<double>>,images:array<struct<url:string,order:int>>>"


def ad_listings(items: DataFrame, base: str, hint: str = "", box=None) -> DataFrame:
    """``items``: item (JSON text).  Anonymous ads and repeats go; rows outside the box go, those without coordinates stay."""
    own = items.select(F.from_json("item", AD).alias("a")).select("a.*").filter(~F.coalesce("isAnonymous", F.lit(False)) & F.col("_id").isNotNull()).dropDuplicates(["_id"])
    # Coordinates come as longitude, latitude.
    lon, lat = (F.try_element_at("location.coordinates", F.lit(i)) for i in (1, 2))
    photos = F.transform(F.array_sort(F.transform("images", lambda p: F.struct(F.coalesce(p["order"], F.lit(999)).alias("o"), p["url"].alias("u")))), lambda p: p["u"])
    place = F.when((F.lit(hint) != "") & ~F.lower(F.coalesce("address", F.lit(""))).contains(hint.lower()), F.concat_ws(", ", F.nullif("address", F.lit("")), F.lit(hint))).otherwise(F.coalesce("address", F.lit("")))
    out = own.select(F.col("_id").alias("external_id"), F.concat(F.lit(base.rstrip("/") + "/"), F.col("_id")).alias("url"), F.coalesce(F.nullif("title", F.lit("")), F.concat_ws(" ", "type", "disposition", place)).alias("title"), F.coalesce(positive(F.col("price")), positive(F.col("originalPrice"))).cast("decimal(15,2)").alias("price"), positive(F.col("utilityArea")).alias("area_built_up"), positive(F.col("cadastralArea")).alias("area_land"), lat.alias("latitude"), lon.alias("longitude"), place.alias("location_text"), "disposition", photos.alias("photos"))
    return out if box is None else out.filter(in_box_or_unknown(F.col("latitude"), F.col("longitude"), box))


LIST_ITEM = "struct<hash_id:long,advert_name:string,price_czk:double,category_main_cb:struct<value:int,name:string>,category_sub_cb:struct<value:int,name:string>,category_type_cb:struct<value:int,name:string>,locality:struct<city:string,district:string,region:string,gps_lat:double,gps_lon:double>,advert_images:array<string>>"


def list_items(items: DataFrame) -> DataFrame:
    """Feed items: nested categories and locality flattened, ``//`` addresses completed, 50 pictures, prices up to 1 are none."""
    e = items.select(F.from_json("item", LIST_ITEM).alias("e")).select("e.*")
    https = lambda u: F.regexp_replace(u, "^//", "https://")
    return e.select(F.col("hash_id").cast("string").alias("external_id"), F.col("advert_name").alias("title"), F.when(F.col("price_czk") > 1, F.col("price_czk")).cast("decimal(15,2)").alias("price"), F.col("category_main_cb.value").alias("main_code"), F.col("category_sub_cb.value").alias("sub_code"), F.col("category_type_cb.value").alias("type_code"), F.concat_ws(", ", "locality.city", "locality.district").alias("location_text"), F.col("locality.district").alias("district"), F.col("locality.region").alias("region"), F.col("locality.gps_lat").alias("latitude"), F.col("locality.gps_lon").alias("longitude"), F.slice(F.array_distinct(F.transform("advert_images", https)), 1, 50).alias("photos"))


def with_details(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Detail values win where present; the detail's area goes to land for category 3, else to built-up."""
    d = details.select(F.col("external_id").alias("_e"), *(F.col(c).alias(f"_{c}") for c in ("price", "description", "photos", "area", "created")))
    both = listed.join(d, F.col("external_id") == F.col("_e"), "left")
    plot = F.coalesce(F.col("main_code") == 3, F.lit(False))
    return both.select(*(c for c in listed.columns if c not in ("price", "photos")), F.coalesce("_price", "price").alias("price"), F.col("_description").alias("description"), F.when(F.size("_photos") > 0, F.col("_photos")).otherwise(F.col("photos")).alias("photos"), F.when(~plot, F.col("_area")).alias("area_built_up"), F.when(plot, F.col("_area")).alias("area_land"), F.try_to_timestamp("_created").alias("date_created_source"))


def detail_url(base: str, kinds: dict[int, str], mains: dict[int, str], subs: dict[int, str], overrides: dict[int, str] | None = None) -> Column:
    """Canonical address from category codes; unknown parts are left out."""
    from ..model import lookup

    sub = F.coalesce(lookup(overrides, F.col("sub_code"), None) if overrides else F.lit(None).cast("string"), _by_code(subs, "sub_code"))
    slug = F.regexp_replace(F.lower(F.coalesce("location_text", F.lit(""))), r"[^\p{L}\p{N}]+", "-")
    return F.concat_ws("/", F.lit(base.rstrip("/")), _by_code(kinds, "type_code"), _by_code(mains, "main_code"), sub, F.nullif(slug, F.lit("")), F.col("external_id"))


def _by_code(values: dict[int, str], column: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), F.coalesce(F.col(column), F.lit(-1)))


def json_ld(els: Column) -> Column:
    """Objects of all JSON-LD scripts, lists flattened, as JSON texts."""
    from .html import attr, of_tag

    bodies = F.transform(F.filter(of_tag(els, "script"), lambda e: attr(e, "type") == "application/ld+json"), lambda e: F.trim(e["text"]))
    lists = F.transform(bodies, lambda b: F.when(b.startswith("["), F.transform(F.from_json(b, "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(b)))
    return F.filter(F.flatten(lists), lambda b: F.try_parse_json(b).isNotNull())


def ld_fields(body: Column) -> Column:
    """name, description, price and address of one object."""
    j = lambda p: F.get_json_object(body, p)
    return F.struct(j("$.name").alias("title"), j("$.description").alias("description"), F.coalesce(j("$.offers.price"), j("$.offers.priceSpecification.price"), j("$.priceSpecification.price")).try_cast("double").alias("price"), F.concat_ws(", ", j("$.address.streetAddress"), j("$.address.addressLocality"), j("$.address.addressRegion")).alias("location_text"))


def distinct_items(items: Column) -> Column:
    return distinct_by(items, "external_id")
