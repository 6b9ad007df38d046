"""Queries on pages, embedded records, feeds and routes: markup made of the driver tables' columns is read back.

The SQL states what must come out of a row's columns, so that a parser that loses or changes a value shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..model import property_type
from ..operators import search
from ..sources import html, payloads, routes
from .registry import query
from .views import DEALT, VIEWS


def markup(sql: str) -> str:
    """Braces and backslashes inside literals, which the SQL of views cannot hold as they are."""
    for mark, code in (("⟨", 123), ("⟩", 125), ("↘", 92)):
        sql = sql.replace(mark, f"' || chr({code}) || '")
    return sql


VIEWS |= {
    "offer_pages": markup("""
SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS n, p_name AS name, p_type AS kind, p_size AS size,
  concat('<html><head><title>', p_name, CASE p_partkey % 6 WHEN 0 THEN ' - PRODÁNO' ELSE '' END, '</title>', CASE p_partkey % 4 WHEN 0 THEN concat('<script type="application/ld+json">[⟨"name": "', p_name, '", "offers": ⟨"price": ', CAST(p_size * 1000 AS STRING), '⟩, "address": ⟨"streetAddress": "Ulice ', CAST(p_partkey AS STRING), '", "addressLocality": "', p_brand, '"⟩⟩, ⟨"name": "x"⟩]</script>') WHEN 1 THEN concat('<script type="application/ld+json">⟨"name": "', p_name, '", "priceSpecification": ⟨"price": "', CAST(p_partkey AS STRING), '"⟩⟩</script>') WHEN 2 THEN '<script type="application/ld+json">⟨broken</script>' ELSE '' END,
    '</head><body><nav><a href="/o-nas">O nás</a></nav><h1>', p_name, '</h1><span class="badge">', CASE p_partkey % 7 WHEN 0 THEN 'Rezervováno' ELSE 'volný' END, '</span><table><tr><td>Užitná plocha:</td><td>', CAST(p_size AS STRING), ' m2</td></tr>', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('<tr><th>Plocha pozemku</th><td>1 ', CAST(100 + p_partkey % 900 AS STRING), ' m2</td></tr>') END, '<tr><td>Stav</td><td>a</td></tr><tr><td>Stav :</td><td><b>', p_type, '</b></td></tr><tr><td>Lokalita</td><td>Town', CAST(p_partkey % 23 AS STRING), '</td></tr></table>', CASE WHEN p_partkey % 2 = 0 THEN concat('<ul><li>Adresa: Hlavní ', CAST(p_partkey AS STRING), '</li></ul>') ELSE '' END,
    '<p>', repeat(concat(p_name, '.'), 10), '</p><p>krátký</p>', CASE p_partkey % 5 WHEN 0 THEN concat('<p>', repeat(concat(p_type, '-'), 20), '</p>') ELSE '' END, '<img srcset="/a.jpg 300w, /b', CAST(p_partkey AS STRING), '-300x200.jpg 800w, /c.jpg 20w"><img data-src="//cdn.example.org/', CAST(p_partkey AS STRING), '.jpg" src="x"><img src="/b', CAST(p_partkey AS STRING), '-640x480.jpg"><a href="/detail/', CAST(p_partkey AS STRING), '">A</a><a href="http://cizi.example.org/detail/', CAST(p_partkey + 1 AS STRING), '" title="B">b</a><a href="/detail/', CAST(p_partkey AS STRING), '">C</a>',
    CASE p_partkey % 3 WHEN 0 THEN concat('<a class="next" href="/p', CAST(p_partkey AS STRING), '">2</a>') WHEN 1 THEN '<a href="/x"> Další</a>' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN concat('<script>new LatLng(48.', CAST(p_partkey AS STRING), ', 16.25)</script>') WHEN 1 THEN concat('<div data-lat="48.5" data-lng="-16.', CAST(p_partkey AS STRING), '"></div>') ELSE '' END, '<div class="pos">GPS 48,85 N, 16,', CAST(10 + p_partkey % 80 AS STRING), ' E</div></body></html>') AS html,
  CASE p_partkey % 4 WHEN 0 THEN 'Nalezeno 0 NEMOVITOSTÍ' ELSE concat(CAST(p_partkey % 30 AS STRING), ' nemovitostí') END AS result, concat('http://x/3t/1/', CAST(p_partkey AS STRING), '.jpg http://x/1t/1/', CAST(p_partkey AS STRING), '.jpg http://x/3t/1/', CAST(p_partkey AS STRING), '.jpg') AS thumbs, concat('http://x/p/', CASE WHEN p_partkey % 3 = 0 THEN 'thumbs_1_2/' ELSE '' END, 'n', CAST(p_partkey AS STRING), '_200_100.jpg') AS thumb, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 60 END AS total
FROM {part}"""),
    "pushed_pages": markup("""
SELECT p_partkey AS n,
  concat('<html><script>self.__next_f.push([1,"⟨↘"listings↘":[⟨↘"id↘":↘"', CAST(p_partkey AS STRING), '↘",↘"slug↘":↘"s', CAST(p_partkey AS STRING), '↘",↘"status↘":↘"', CASE p_partkey % 5 WHEN 0 THEN 'sold' WHEN 1 THEN 'RESERVED' ELSE 'open' END, '↘",↘"title↘":↘"', p_name, '↘",↘"price↘":', CAST(p_size % 3 * 1000 AS STRING), ',↘"description↘":↘"$1a↘","])</script><script>self.__next_f.push([1,"↘"area↘":', CAST(p_size AS STRING), ',↘"landArea↘":0,↘"localityCity↘":↘"', p_brand, '↘",↘"localityRegion↘":↘"↘",↘"images↘":[↘"http://i/', CAST(p_partkey AS STRING), '.jpg↘",↘"data:x↘"],↘"sourcePayload↘":⟨↘"estate↘":⟨↘"advert_type↘":', CAST(1 + p_partkey % 2 AS STRING), '⟩⟩⟩,⟨↘"id↘":↘"b', CAST(p_partkey AS STRING), '↘",↘"slug↘":↘"', CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'b' END, '↘",↘"price↘":null⟩]⟩↘n1a:T', lower(hex(length(p_name) + 6)), ',Popis ', p_name, 'zbytek"])</script></html>') AS html
FROM {part}"""),
    "ad_pages": markup("""
SELECT p_partkey AS n, concat('<script id="__NEXT_DATA__" type="application/json">', CASE p_partkey % 6 WHEN 5 THEN '⟨broken' ELSE concat('⟨"props":⟨"pageProps":⟨"adEstateDetail":⟨"description":"', p_type, CAST(p_partkey AS STRING), '"⟩,"adsListResult":⟨', CASE p_partkey % 2 WHEN 0 THEN concat('"totalCount":', CAST(p_partkey AS STRING), ',"ads"') ELSE '"data"' END, ':[⟨"_id":"a', CAST(p_partkey AS STRING), '","title":"', CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_name END, '","type":"PRODEJ","disposition":"3+1","price":', CAST(p_size % 4 * 100 AS STRING), ',"originalPrice":', CAST(p_partkey AS STRING), ',"utilityArea":', CAST(p_size AS STRING), ',"cadastralArea":-1,"address":"', CASE p_partkey % 4 WHEN 0 THEN 'Znojmo' WHEN 1 THEN '' ELSE 'Lesní' END, '","isAnonymous":', CASE p_partkey % 7 WHEN 0 THEN 'true' ELSE 'false' END, CASE p_partkey % 5 WHEN 0 THEN '' ELSE concat(',"location":⟨"coordinates":[16.', CAST(100 + p_partkey % 800 AS STRING), ',48.9]⟩') END, ',"images":[⟨"url":"z"⟩,⟨"url":"y', CAST(p_partkey AS STRING), '","order":2⟩,⟨"url":"x","order":1⟩]⟩,⟨"_id":"b', CAST(p_partkey - p_partkey % 10 AS STRING), '","title":"t","price":5⟩,⟨"title":"ohne"⟩]⟩⟩⟩⟩') END, '</script>') AS html, repeat(p_name, CAST(p_partkey % 8 AS INT)) AS visible
FROM {part}"""),
    "feed_items": markup("""
SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS n, p_size AS size, p_brand AS brand, p_name AS name, concat('⟨"hash_id":', CAST(p_partkey AS STRING), ',"advert_name":"', p_name, '","price_czk":', CAST(CASE p_partkey % 4 WHEN 0 THEN 1 ELSE p_partkey * 1000 END AS STRING), ',"category_main_cb":⟨"value":', CAST(1 + p_partkey % 4 AS STRING), ',"name":"m"⟩,"category_sub_cb":⟨"value":', CAST(p_partkey % 6 AS STRING), '⟩,"category_type_cb":⟨"value":', CAST(1 + p_partkey % 3 AS STRING), '⟩,"locality":⟨', CASE p_partkey % 5 WHEN 0 THEN '' ELSE concat('"city":"Město ', p_brand, '",') END, '"district":"D', CAST(p_partkey % 9 AS STRING), '","gps_lat":48.5,"gps_lon":16.', CAST(p_partkey AS STRING), '⟩,"advert_images":["//i/', CAST(p_partkey AS STRING), '.jpg","https://i/', CAST(p_partkey AS STRING), '.jpg","http://j/1.jpg"]⟩') AS item
FROM {part}"""),
    "route_files": markup("""
SELECT concat('r/', CAST(o_orderkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '.GPX' WHEN 1 THEN '.gpx' WHEN 2 THEN '.geojson' WHEN 3 THEN '.json' ELSE '.txt' END) AS path, o_orderkey AS n,
  CASE o_orderkey % 5 WHEN 0 THEN concat('<gpx><trk><trkseg><trkpt lat="48.5" lon="16.', CAST(o_orderkey AS STRING), '"/><trkpt lon="16.25" lat="48.', CAST(o_custkey AS STRING), '"><ele>1</ele></trkpt><trkpt lat="95" lon="1"/></trkseg></trk><wpt lat="1" lon="2"/></gpx>') WHEN 1 THEN concat('<gpx><wpt lat="3" lon="4"/><rte><rtept lat="48.5" lon="16.', CAST(o_orderkey AS STRING), '"/></rte></gpx>') WHEN 2 THEN concat('⟨"features":[⟨"geometry":⟨"type":"MultiLineString","coordinates":[[[16.', CAST(o_orderkey AS STRING), ',48.5]],[[16.25,48.', CAST(o_custkey AS STRING), ']]]⟩⟩]⟩') WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN '⟨"type":"Point","coordinates":[1,2]⟩' ELSE concat('⟨"geometry":⟨"type":"LineString","coordinates":[[16.', CAST(o_orderkey AS STRING), ',48.5],[16.25,48.', CAST(o_custkey AS STRING), ']]⟩⟩') END ELSE 'x' END AS content
FROM {orders}"""),
}
DEALT |= {"offer_pages", "pushed_pages", "ad_pages", "feed_items", "route_files"}
BASE = "http://e.example.org"


@query(r"""SELECT id, n % 6 = 0 OR n % 7 = 0 AS sold, CASE n % 7 WHEN 0 THEN 'Rezervováno' ELSE 'volný' END AS badge, concat('Stav=', kind, '|Užitná plocha=', size, ' m2') AS parameters, CAST(size AS DOUBLE) AS built, CASE WHEN n % 3 <> 0 THEN CAST(1100 + n % 900 AS DOUBLE) END AS land, CASE n % 2 WHEN 0 THEN concat('Hlavní ', n) ELSE concat('Town', n % 23) END AS location,
CASE n % 4 WHEN 0 THEN CAST(concat('48.', n) AS DOUBLE) WHEN 1 THEN 48.5 END AS lat, CASE n % 4 WHEN 0 THEN 16.25 WHEN 1 THEN CAST(concat('-16.', n) AS DOUBLE) END AS lon, CAST(concat('16.', 10 + n % 80) AS DOUBLE) AS row_lon, concat_ws(chr(10) || chr(10), CASE WHEN 10 * (length(name) + 1) > 80 THEN repeat(concat(name, '.'), 10) END, CASE WHEN n % 5 = 0 AND 20 * (length(kind) + 1) > 80 THEN repeat(concat(kind, '-'), 20) END) AS paragraphs FROM offer_pages""")
def offers_read(offer_pages):
    """Whether a page's offer is gone; parameters, areas, location, coordinates and paragraphs."""
    own, e = html.parsed(offer_pages), F.col("elements")
    rows = html.label_rows(e)
    built, land = html.row_areas(rows)
    p, at = html.parameters(e), html.gps(F.col("html"))
    return own.select(
        "id", text.is_sold(html.sold_texts(e)).alias("sold"), html.first_hit(e, "missing", "badge").alias("badge"), F.array_join(F.array_sort(F.transform(F.filter(F.map_entries(p), lambda x: x["key"].isin("Stav", "Užitná plocha")), lambda x: F.concat_ws("=", x["key"], x["value"]))), "|").alias("parameters"),
        built.alias("built"), land.alias("land"), html.row_location(rows).alias("location"), at["lat"].alias("lat"), at["lon"].alias("lon"), html.row_gps(html.first_hit(e, "pos"))["lon"].alias("row_lon"), html.paragraphs(e).alias("paragraphs"),
    )


@query(rf"""SELECT id, concat(n, '=A|', n + 1, '=B') AS links, CAST(n AS VARCHAR) AS own_links, CASE n % 3 WHEN 0 THEN concat('{BASE}/p', n) END AS next_page, n % 3 < 2 OR coalesce(total > 40, false) AS has_more, regexp_matches(result, '(?i)(^|[^0-9])0\s+nemovitost') AS nothing, concat('{BASE}/b', n, '.jpg https://cdn.example.org/', n, '.jpg') AS images, concat('http://x/1/1/', n, '.jpg http://x/3/1/', n, '.jpg') AS full_size,
CASE WHEN n % 3 = 0 THEN thumb ELSE concat('http://x/p/thumbs_200_100/n', n, '.jpg') END AS repaired FROM offer_pages""")
def offer_links(offer_pages):
    """Links of a list page, those of its own host, the next page, whether there is more or nothing; pictures in full size."""
    own, e = html.parsed(offer_pages), F.col("elements")
    found = html.links(e, BASE, "/detail/([0-9]+)")
    return own.select(
        "id", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["external_id"], x["title"])), "|").alias("links"), F.array_join(F.transform(html.same_host(found, "e.example.org"), lambda x: x["external_id"]), "|").alias("own_links"), html.next_url(e, BASE).alias("next_page"),
        html.has_next(e, F.col("total"), F.lit(2), 20).alias("has_more"), html.is_empty_result(F.col("result")).alias("nothing"), F.array_join(html.images(e, BASE), " ").alias("images"), F.array_join(html.full_size(F.split("thumbs", " ")), " ").alias("full_size"), html.repaired_thumb(F.col("thumb")).alias("repaired"),
    )


@query("""SELECT id, name AS title, CASE n % 4 WHEN 0 THEN size * 1000.0 ELSE CAST(n AS DOUBLE) END AS price, CASE n % 4 WHEN 0 THEN concat('Ulice ', n, ', ', p_brand) ELSE '' END AS location_text FROM offer_pages JOIN part ON p_partkey = n WHERE n % 4 < 2 UNION ALL SELECT id, 'x', NULL, '' FROM offer_pages WHERE n % 4 = 0""")
def offers_linked_data(offer_pages):
    """One row per JSON-LD object of a page; broken scripts give none."""
    own = html.parsed(offer_pages).select("id", F.explode(F.transform(payloads.json_ld(F.col("elements")), payloads.ld_fields)).alias("x"))
    return own.select("id", "x.title", "x.price", "x.location_text")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS external_id, concat('http://e.example.org/s', p_partkey) AS url, p_name AS title, concat('Popis ', p_name) AS description, CAST(CASE WHEN p_size % 3 > 0 THEN p_size % 3 * 1000 END AS DECIMAL(15,2)) AS price, CAST(p_size AS DOUBLE) AS area_built_up, p_brand AS location_text, concat('http://i/', p_partkey, '.jpg') AS photos, CASE WHEN p_partkey % 2 = 1 THEN 'Rent' ELSE 'Sale' END AS offer_type FROM part WHERE p_partkey % 5 > 1
UNION ALL SELECT concat('b', p_partkey), 'http://e.example.org/b', NULL, NULL, NULL, NULL, '', '', 'Sale' FROM part WHERE p_partkey % 3 <> 0""")
def offers_pushed(pushed_pages):
    """Records that a page's scripts push in pieces, descriptions by reference; sold and reserved ones and those without a slug go."""
    own = payloads.estate_listings(payloads.estates(pushed_pages), BASE)
    return own.select("external_id", "url", "title", "description", "price", "area_built_up", "location_text", F.coalesce(F.array_join("photos", " "), F.lit("")).alias("photos"), "offer_type")


@query("""WITH a AS (SELECT p_partkey AS n, p_name, p_size, CASE p_partkey % 4 WHEN 0 THEN 'Znojmo' WHEN 1 THEN 'Znojmo' ELSE 'Lesní, Znojmo' END AS place FROM part WHERE p_partkey % 6 <> 5)
SELECT concat('a', n) AS external_id, CASE WHEN n % 3 = 0 THEN concat('PRODEJ 3+1 ', place) ELSE p_name END AS title, CAST(CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 100 ELSE n END AS DECIMAL(15,2)) AS price, CAST(p_size AS DOUBLE) AS area_built_up, CAST(NULL AS DOUBLE) AS area_land, CASE WHEN n % 5 <> 0 THEN CAST(concat('16.', 100 + n % 800) AS DOUBLE) END AS longitude, place AS location_text, concat('x y', n, ' z') AS photos FROM a WHERE n % 7 <> 0 AND (n % 5 = 0 OR 100 + n % 800 <= 500)
UNION ALL SELECT DISTINCT concat('b', n - n % 10), 't', CAST(5 AS DECIMAL(15,2)), NULL, NULL, NULL, 'Znojmo', '' FROM a""")
def offers_of_states(ad_pages):
    """Ads of the pages' embedded states: anonymous ones, repeats and those outside the box go; a place hint is added."""
    items = ad_pages.select(F.explode(payloads.ads(F.col("html"))["items"]).alias("item"))
    own = payloads.ad_listings(items, BASE, "Znojmo", (48.7, 49.1, 15.7, 16.5))
    return own.select("external_id", "title", "price", "area_built_up", "area_land", "longitude", "location_text", F.coalesce(F.array_join("photos", " "), F.lit("")).alias("photos"))


@query("""SELECT p_partkey AS n, CASE WHEN p_partkey % 6 <> 5 AND p_partkey % 2 = 0 THEN CAST(p_partkey AS INTEGER) END AS total, p_partkey % 6 <> 5 AS has_state, CASE WHEN p_partkey % 6 <> 5 THEN concat(p_type, p_partkey) WHEN length(p_name) * (p_partkey % 8) > 50 THEN repeat(p_name, p_partkey % 8) END AS description FROM part""")
def states_read(ad_pages):
    """Totals of the embedded states, whether a page has one, descriptions from it or from the visible text."""
    return ad_pages.select("n", payloads.ads(F.col("html"))["total"].alias("total"), payloads.next_data(F.col("html")).isNotNull().alias("has_state"), payloads.ad_description(F.col("html"), F.col("visible")).alias("description"))


DETAIL_SQL = "n % 3 = 0"


@query(f"""SELECT id AS external_id, name AS title, CAST(CASE WHEN {DETAIL_SQL} AND n % 2 = 0 THEN n * 7 WHEN n % 4 <> 0 THEN n * 1000 END AS DECIMAL(15,2)) AS price, concat_ws(', ', CASE WHEN n % 5 <> 0 THEN concat('Město ', brand) END, concat('D', n % 9)) AS location_text, CASE WHEN {DETAIL_SQL} THEN concat('detail ', n) END AS description, CASE WHEN {DETAIL_SQL} AND n % 2 = 1 THEN 'd.jpg' ELSE concat('https://i/', n, '.jpg http://j/1.jpg') END AS photos,
CASE WHEN {DETAIL_SQL} AND 1 + n % 4 <> 3 THEN CAST(size AS DOUBLE) END AS area_built_up, CASE WHEN {DETAIL_SQL} AND 1 + n % 4 = 3 THEN CAST(size AS DOUBLE) END AS area_land, CASE WHEN {DETAIL_SQL} AND n % 4 <> 1 THEN TIMESTAMP '2024-01-05 10:00:00' END AS created,
concat_ws('/', 'http://e.example.org', CASE n % 3 WHEN 0 THEN 'prodej' WHEN 1 THEN 'pronajem' END, CASE n % 4 WHEN 0 THEN 'byt' WHEN 1 THEN 'dum' WHEN 2 THEN 'pozemek' END, CASE n % 6 WHEN 2 THEN '2+kk' WHEN 3 THEN '2+1' END, regexp_replace(lower(concat_ws(', ', CASE WHEN n % 5 <> 0 THEN concat('Město ', brand) END, concat('D', n % 9))), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), id) AS url FROM feed_items""")
def feed_with_details(feed_items):
    """Feed items, their details where there are any, and canonical addresses from the category codes."""
    listed = payloads.list_items(feed_items)
    n = F.col("n")
    details = feed_items.filter(n % 3 == 0).select(F.col("id").alias("external_id"), F.when(n % 2 == 0, n * 7).cast("decimal(15,2)").alias("price"), F.concat(F.lit("detail "), F.col("id")).alias("description"), F.when(n % 2 == 1, F.array(F.lit("d.jpg"))).otherwise(F.array().cast("array<string>")).alias("photos"), F.col("size").cast("double").alias("area"), F.when(n % 4 == 1, "x").otherwise("2024-01-05 10:00:00").alias("created"))
    url = payloads.detail_url(BASE, {1: "prodej", 2: "pronajem"}, {1: "byt", 2: "dum", 3: "pozemek"}, {2: "2+kk", 3: "2+1"})
    own = payloads.with_details(listed, details).withColumn("url", url)
    return own.select("external_id", "title", "price", "location_text", "description", F.array_join("photos", " ").alias("photos"), "area_built_up", "area_land", F.col("date_created_source").alias("created"), "url")


@query("""WITH r AS (SELECT path, o_orderkey AS n, CAST(concat('16.', o_orderkey) AS DOUBLE) AS x, CAST(concat('48.', o_custkey) AS DOUBLE) AS y, o_orderkey % 5 = 0 OR o_orderkey % 5 = 2 OR (o_orderkey % 5 = 3 AND o_orderkey % 2 = 1) AS ok FROM orders JOIN route_files ON n = o_orderkey)
SELECT path, CASE WHEN ok THEN 2 WHEN n % 5 = 1 THEN 1 END AS points, CASE WHEN ok THEN x END AS first_lon, CASE WHEN ok THEN y END AS last_lat, NOT ok AS wrong, CASE WHEN n % 5 = 1 THEN 3.0 WHEN n % 5 = 0 THEN 48.5 END AS upload_lat FROM r""")
def routes_read(route_files):
    """Routes of GPX and GeoJSON files: track points before route points before way points; short ones carry an error."""
    own = routes.routes(route_files).join(route_files.select("path", F.get(routes.gpx_points(F.col("content")), 0)["lat"].alias("upload_lat"), (F.col("n") % 5 < 2).alias("gpx")), "path")
    return own.select("path", F.size("points").alias("points"), F.col("first.lon").alias("first_lon"), F.col("last.lat").alias("last_lat"), F.col("error").isNotNull().alias("wrong"), F.when(F.col("gpx"), F.col("upload_lat")).alias("upload_lat"))


@query("""SELECT id, CASE WHEN id::INT % 3 = 0 THEN 'House' WHEN id::INT % 3 = 1 THEN 'Land' ELSE 'Other' END AS label_kind, CASE id::INT % 6 WHEN 0 THEN 'House' WHEN 1 THEN 'Apartment' WHEN 2 THEN 'Land' WHEN 3 THEN 'Cottage' WHEN 4 THEN 'Garage' ELSE 'Other' END AS inferred, coalesce(latitude BETWEEN 48.75 AND 48.95 AND longitude BETWEEN 16.0 AND 16.4, true) AS near, latitude IS NOT NULL AS has_point FROM listings""")
def listing_kinds_and_boxes(listings):
    """Type labels to kinds, kinds out of breadcrumb, title and address, boxes that let unknown places pass, points."""
    n = F.col("id").cast("int")
    crumb = F.when(n % 6 == 0, "Domy na prodej").when(n % 6 == 1, "BYTY")
    title = F.when(n % 6 == 2, "Stavební pozemek").when(n % 6 == 3, "u lesa")
    url = F.when(n % 6 == 3, "http://e/chata-1").when(n % 6 == 4, "http://e/garaz-2").otherwise("http://e/x")
    label = F.when(n % 3 == 0, "Dům").when(n % 3 == 1, "Land").otherwise("stan")
    return listings.select("id", property_type(label).alias("label_kind"), text.infer_property_type(crumb, title, url).alias("inferred"), geo.in_box_or_unknown(F.col("latitude"), F.col("longitude"), (48.75, 48.95, 16.0, 16.4)).alias("near"), geo.point(F.col("latitude"), F.col("longitude")).isNotNull().alias("has_point"))


@query("""WITH g AS (SELECT listing_id, list(original_url ORDER BY original_url, id) AS u FROM photos GROUP BY listing_id), p AS (SELECT *, least(greatest(CAST(listing_id AS INT) % 9, 1), greatest(1, CAST(ceil(len(u) / 4) AS INT))) AS k FROM g) SELECT listing_id, array_to_string(u[(k - 1) * 4 + 1 : k * 4], ' ') AS shown FROM p""")
def photo_pages(photos):
    """A page of four of each listing's picture addresses; pages past the end give the last."""
    own = photos.groupBy("listing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("original_url", "id"))), lambda x: x["original_url"]).alias("u"))
    return own.select("listing_id", F.array_join(search.array_page(F.col("u"), F.col("listing_id").cast("int") % 9, 4), " ").alias("shown"))
