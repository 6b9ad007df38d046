"""Small tables of cases: parsers and rules whose inputs the driver tables do not hold.

Each case gives inputs and the result that the rule asks for; the SQL is the table of these results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import geo, jsons, numbers, text
from listwright.operators import ingest, search, selectors
from listwright.sources import html, payloads, routes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def literal(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def cases(schema: str, *rows: tuple):
    """Register a query over ``rows``, each of inputs as in ``schema`` and the expected result as text.

    An input named ``markup`` arrives as the page's elements.
    """

    def register(f: Callable[..., Column]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = spark.createDataFrame([(n, *r[:-1]) for n, r in enumerate(rows)], f"case_no int, {schema}")
            names = df.columns[1:]
            if "markup" in names:
                df = html.parsed(df, "markup")
            return df.select("case_no", f(*(F.col("elements" if c == "markup" else c) for c in names)).cast("string").alias("result"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = "SELECT CAST(n AS INTEGER) AS case_no, result FROM (VALUES " + ", ".join(f"({n}, {literal(r[-1])})" for n, r in enumerate(rows)) + ") AS t(n, result)"
        return f

    return register


def joined(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))


def place(p: Column) -> Column:
    return F.when(p.isNotNull(), F.concat_ws("/", p["lat"].cast("string"), p["lon"].cast("string")))


# --- enrichment and texts


@cases("title string", ("Prodej rodinného domu 4+kk, 153m2 - Znojmo", "4+KK"), ("Byt 3+1 a 2+kk", "3+1"), ("Prodej stavebního pozemku 467 m²", None), (None, None))
def disposition_cases(title):
    return text.disposition(title)


@cases("d string", ("4+KK", "4"), ("12+1", "12"), ("KK", None), (None, None))
def rooms_of_disposition(d):
    return text.rooms(d)


@cases("s string", ("prodej-domu-znojmo", "Prodej Domu Znojmo"), ("byt", "Byt"), (None, None))
def slug_titles(s):
    return text.slug_title(s)


@cases("s string", ("Miroslav", "Miroslav, okres Znojmo"), ("Znojmo - město", "Znojmo - město"), ("Brno, Jihomoravský kraj", "Brno, Jihomoravský kraj"), (" ", "okres Znojmo"), (None, "okres Znojmo"))
def locations_with_district(s):
    return text.location_with_district(s)


@cases("s string", ("Lokalita: 669 02 Znojmo Vidělo: 5 lidí", "669 02 Znojmo"), ("dům 671 81  Nový Šaldorf", "671 81 Nový"), ("bez adresy", ""))
def locations_postal(s):
    return text.location_postal(s)


@cases("s string", ("Pěkný dům\nSmazat / Upravit\n [1.2. 2024]\n\n  volný ihned ", "Pěkný dům\nvolný ihned"), ("Tisk\r\nPrvní řádek", "První řádek"), ("", ""))
def descriptions_cleaned(s):
    return text.clean_description(s)


@cases("l string, m string, d string", ("Hlavní 5, Znojmo", "Znojmo", "okres Znojmo", "Hlavní 5, Znojmo|Znojmo, okres Znojmo|okres Znojmo"), ("ab", None, "Brno", "Brno"), ("Brno", None, "Brno", "Brno"), (None, None, None, ""))
def geocode_tries(l, m, d):  # noqa: E741
    return F.array_join(text.geocode_attempts(l, m, d), "|")


@cases("s string", ("48.85, 16.05", "48.85/16.05"), ("95,16", None), ("1,2,3", None), ("sever", None), (None, None))
def lat_lon_parsed(s):
    return place(text.lat_lon(s))


@cases("m string, l string", (" Znojmo ", "x", "Znojmo"), (None, "Miroslav, okres Znojmo", "Miroslav"), ("", "Brno", "Brno"))
def municipality_first(m, l):  # noqa: E741
    return text.prefer_municipality(m, l)


@cases("s string", ("Miroslav, okres Znojmo", "Miroslav"), ("Brno okr. Brno-venkov", "Brno"), ("Praha", "Praha"))
def address_queries(s):
    return text.address_query(s, 80)


@cases("c long", (123, "https://vdp.cuzk.cz/vdp/ruian/adresnimista/123"), (None, "https://nahlizenidokn.cuzk.cz"))
def cadastre_links(c):
    return text.cadastre_url(c)


@cases("s string", ("Hledám byt 2+1", "true"), ("  koupím dům", "true"), ("Poptávám pozemek", "true"), ("Prodej domu, hledám kupce", "false"))
def demand_titles(s):
    return text.is_demand(s)


@cases("s string", ("Dům|PRODÁNO", "true"), ("Byt|Rezervováno", "true"), ("Byt|volný", "false"))
def sold_pages(s):
    return text.is_sold(F.split(s, r"\|"))


@cases("s string", ("Kitchen ", "kitchen"), ("exterior", "exterior"), ("nesmysl", "other"), (None, "other"))
def photo_category(s):
    return text.category(s)


@cases("s string", ("úvod\nVerdikt: koupit\ndůvod", "Verdikt: koupit\ndůvod"), ("a\nDoporučení: ano \n\n", "Doporučení: ano"), ("nic", "nic"))
def verdict_lines(s):
    return text.verdict(s)


@cases("s string", ("# A\n## VERDIKT\nKoupit.\n## Další\nx", "## VERDIKT\nKoupit."), ("## 5. Závěr\nNe.\n---\nx", "## 5. Závěr\nNe."), ("text", ""))
def verdict_sections(s):
    return text.verdict_section(s)


@cases("s string", ("úvod\n| a | b |\n|---|---|\n| 1 | 2 |\nkonec", "| a | b |\n|---|---|\n| 1 | 2 |\n"), ("bez tabulky", ""))
def first_tables(s):
    return text.first_table(s)


@cases("s string", ("aaaa\nbbbb\ncccc", "aaaa\nbbbb\n[…64 %]"), ("krátký", "krátký"), ("abcdefghijklmnopqrst", "abcdefghijk\n[…55 %]"))
def capped_texts(s):
    return text.capped(s, 11)


@cases("s string", ("Dům má velkou zahradu. Dům má velkou zahradu! . Krátká. K domu patří garáž", "Dům má velkou zahradu. K domu patří garáž."), ("Krátce", "Krátce"))
def sentences_unrepeated(s):
    return text.sentences_once(s, 500)


@cases("s string", ("image/png; q=1", ".png"), ("IMAGE/WEBP", ".webp"), ("text/html", ".jpg"))
def picture_extensions(s):
    return text.extension_of(s)


@cases("s string", ("https://h.cz/uploads/a/b.jpg", "/uploads/a/b.jpg"), ("/uploads/x.jpg", "/uploads/x.jpg"), ("x.jpg", "/uploads/x.jpg"))
def local_paths(s):
    return text.local_path(s)


@cases("s string", ("Pěkná Vila", "House"), ("byt nebo vila", "House"), ("Byt", "Apartment"), ("stan", "Other"))
def first_needle(s):
    return text.contains_first(s, [("vila", "House"), ("byt", "Apartment")], "Other")


# --- numbers


@cases("s string", ("Cena: 4 200 000 Kč", "4200000"), ("byt za 1500000 Kč", "1500000"), ("za 999 Kč", None), ("dohodou", None))
def prices_labelled(s):
    return numbers.price_labelled(s)


@cases("s string", ("1 250 000 Kč", "1250000"), ("500", None), ("600 000 000", None), ("na dotaz", None))
def prices_sane(s):
    return numbers.price_sane(s)


@cases("s string", ("1 234 m²", "1234"), ("cca 85 m2", "85"), ("bez", None))
def areas_first(s):
    return numbers.area_first(s)


@cases("s string", ("2.059 m2", "2059.0"), ("467 m²", "467.0"), ("m2", None))
def areas_thousands(s):
    return numbers.area_thousands(s)


@cases("h string, s string", ("120 m²", "x", "120"), (None, "Plocha: 85 m2", "85"), (None, "byt 60 m2", "60"), (None, "dům 9000 m2", None))
def areas_by_strategies(h, s):
    return numbers.area_by_strategies(h, s)


@cases("t string, d string, k string", ("Dům", "Pozemek o výměře: dům, zastavěná plocha 120 m2, pozemku 800 m2", "Dům", "120.0|800.0"), ("Pozemek 467 m²", "Pěkný.", "Pozemek", "-|467.0"), ("Dům 153 m2", None, "Dům", "153.0|-"), ("Dům", "obytná 90 m2", "Dům", "90.0|-"))
def areas_of_texts(t, d, k):
    return joined(*numbers.areas_inferred(t, d, k))


@cases("p double, b double, l double", (100.0, 0.0, 50.0, "2.0"), (100.0, 20.0, 50.0, "5.0"), (1.0, 0.0, None, None))
def per_area_batches(p, b, l):  # noqa: E741
    return numbers.per_area_batch(p, b, l)


@cases("x double", (1.5, "1.0"), (-1.0, "0.0"), (0.5, "0.5"), (None, None))
def clamped(x):
    return numbers.clamp(x)


@cases("a double, b double", (100.0, 103.0, "true"), (100.0, 120.0, "false"), (None, 1.0, None))
def areas_agreeing(a, b):
    return numbers.areas_agree(a, b)


@cases("s string", ("12 345 Kč", "12345"), ("", None), ("abc", None))
def all_digits(s):
    return numbers.digits(s)


# --- answers of language models


@cases("s string", ('```json\n{"a": 1}\n```', '{"a": 1}'), ("  text ", "text"))
def fences_stripped(s):
    return jsons.strip_fences(s)


@cases("s string", ('Odpověď: ["a", "b"] konec', '["a", "b"]'), ("[a", None), ("nic", None))
def array_islands(s):
    return jsons.array_island(s)


@cases("s string", ('Zde: {"a": {"b": 1}} konec', '{"a": {"b": 1}}'), ("{a", None))
def object_islands(s):
    return jsons.object_island(s)


@cases("s string", ('{"category": "kitchen", "description": "Bílá linka", "damage_detected": true, "confidence": 0.9', "kitchen|Bílá linka|true|0.9"), ('{"category": "attic"', "attic|-|false|-"), ('{"x": 1}', None))
def answers_salvaged(s):
    x = jsons.salvage(s)
    return F.when(x.isNotNull(), joined(*(x[c] for c in ("category", "description", "damage_detected", "confidence"))))


@cases("s string", (" LOW ", "low"), ("fair", "fair"), ("cheap", None))
def price_signals(s):
    return jsons.price_signal(s)


@cases("s string", ("correct", "true"), ("wrong", "true"), (None, "true"), ("maybe", "false"))
def feedback_valid(s):
    return selectors.valid_feedback(s)


@cases("f string, n long", ("a.JPG", 100, "true"), ("a.exe", 1, "false"), ("b.png", 20_971_520, "false"), ("c", 1, "false"))
def uploads_allowed(f, n):
    return selectors.upload_allowed(f, n)


@cases("m string, l string", ("ZNOJMO", None, "true"), (None, "u Znojma, Dobšice", "true"), ("Brno", "Brno", "false"))
def corridor_towns(m, l):  # noqa: E741
    return selectors.on_corridor(m, l, ["Znojmo", "Dobšice"])


# --- pages and payloads


@cases("s string", ("a.jpg 300w, b.jpg 800w, c.jpg 20w", "b.jpg"), ("", None))
def srcset_widest(s):
    return html.widest(s)


@cases("s string", ("http://x/a-300x200.jpg", "http://x/a.jpg"), ("http://x/a-3.jpg", "http://x/a-3.jpg"))
def sizes_off(s):
    return html.unsized(s)


@cases("s string", ("http://x/p/name_200_100.jpg", "http://x/p/thumbs_200_100/name.jpg"), ("http://x/thumbs_1_2/n_1_2.jpg", "http://x/thumbs_1_2/n_1_2.jpg"))
def thumbs_repaired(s):
    return html.repaired_thumb(s)


@cases("s string", ("http://x/2t/12/6.jpg http://x/1t/12/5.jpg http://x/2t/12/6.jpg", "http://x/1/12/5.jpg http://x/2/12/6.jpg"))
def thumbs_full_size(s):
    return F.array_join(html.full_size(F.split(s, " ")), " ")


@cases("s string", ("Nalezeno 0 NEMOVITOSTÍ", "true"), ("10 nemovitostí", "false"))
def result_is_empty(s):
    return html.is_empty_result(s)


@cases("s string", ("new LatLng(48.85, 16.05)", "48.85/16.05"), ('<div data-lat="48.1" data-lng="16.2">', "48.1/16.2"), ("<p>bez</p>", None))
def page_gps(s):
    return place(html.gps(s))


@cases("s string", ("GPS 48,85 N, 16,05 E", "48.85/16.05"), ("bez", None))
def row_coordinates(s):
    return place(html.row_gps(s))


@cases("s string", ("Plocha pozemku: 1 200 m2|Užitná plocha: 95 m2|Cena 5", "95.0|1200.0"), ("Cena 5", "-|-"))
def areas_of_rows(s):
    return joined(*html.row_areas(F.split(s, r"\|")))


@cases("s string", ("Cena 5|Lokalita: Brno|Adresa Znojmo, Hlavní", "Znojmo, Hlavní"), ("Cena 5", None))
def location_of_rows(s):
    return html.row_location(F.split(s, r"\|"))


@cases("markup string", ("<table><tr><td>Cena:</td><td>5 Kč</td></tr><tr><th>Stav</th><td>nový</td></tr><tr><td>Cena</td><td>6 Kč</td></tr></table>", "Cena=6 Kč|Stav=nový"), ("<p>x</p>", ""))
def page_parameters(markup):
    pairs = F.map_entries(html.parameters(markup))
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"]))), "|")


@cases("s string", ('<a class="next" href="/p2">2</a>', "http://e.cz/p2|true"), ('<a rel="next" href="http://e.cz/p3">dál</a>', "http://e.cz/p3|true"), ('<a href="/x">x</a>', "-|false"))
def pager_next(s):
    els = html.elements(s)
    return joined(html.next_url(els, "http://e.cz"), html.has_next(els, F.lit(10), F.lit(1), 20))


@cases("total int, page int", (45, 2, "true"), (40, 2, "false"), (None, 1, "false"))
def pages_left(total, page):
    return html.has_next(html.elements(F.lit("<p>x</p>")), total, page, 20)


@cases("markup string", (f"<p>{'a' * 90}</p><p>krátký</p><p>{'b' * 81}</p>", f"{'a' * 90}\n\n{'b' * 81}"), ("<p>x</p>", ""))
def page_paragraphs(markup):
    return html.paragraphs(markup)


@cases("markup string", ('<a href="/detail/11">A</a><a href="/detail/12" title="B">b</a><a href="/detail/11">C</a><a href="/o-nas">D</a>', "11=A|12=B"))
def page_links(markup):
    return F.array_join(F.transform(html.links(markup, "http://e.cz", "/detail/([0-9]+)"), lambda x: F.concat(x["external_id"], F.lit("="), x["title"])), "|")


@cases("markup string", ('<a href="/detail/1">A</a><a href="http://cizi.cz/detail/2">B</a>', "1"))
def links_of_host(markup):
    return F.array_join(F.transform(html.same_host(html.links(markup, "http://e.cz", "/detail/([0-9]+)"), "e.cz"), lambda x: x["external_id"]), "|")


NEXT = '<script id="__NEXT_DATA__" type="application/json">{}</script>'


@cases("s string", (NEXT.format('{"a": 1}'), '{"a": 1}'), (NEXT.format("{a"), None), ("<p>x</p>", None))
def next_states(s):
    return payloads.next_data(s)


@cases("s string", (NEXT.format('{"props":{"pageProps":{"adsListResult":{"ads":[{"_id":"a"},{"_id":"b"}],"totalCount":7}}}}'), "7|a,b"), (NEXT.format('{"props":{"pageProps":{"adsListResult":{"data":[{"_id":"c"}]}}}}'), "-|c"), (NEXT.format('{"props":{}}'), None))
def ad_pages(s):
    a = payloads.ads(s)
    return F.when(a.isNotNull(), joined(a["total"], F.array_join(F.transform(a["items"], lambda i: F.get_json_object(i, "$._id")), ",")))


@cases("s string, t string", (NEXT.format('{"props":{"pageProps":{"adEstateDetail":{"description":"Byt u parku"}}}}'), "x", "Byt u parku"), ("<p/>", "y" * 60, "y" * 60), ("<p/>", "krátký", None))
def ad_descriptions(s, t):
    return payloads.ad_description(s, t)


@cases("s string", ('<script>self.__next_f.push([1,"{\\"listings\\":[{\\"id\\":\\"a1\\"},"])</script><script>self.__next_f.push([1,"{\\"id\\":\\"b2\\"}]}"])</script>', "a1,b2"), ("<p>x</p>", ""))
def pushed_ids(s):
    return F.array_join(F.transform(payloads.pushed_rows(s), lambda j: F.get_json_object(j, "$.id")), ",")


@cases("markup string", ('<script type="application/ld+json">[{"name":"Dům","offers":{"price":5},"address":{"addressLocality":"Brno"}},{"name":"Byt"}]</script>', "Dům/5.0/Brno|Byt/-/"), ("<script>x</script>", ""))
def linked_data(markup):
    own = F.transform(payloads.json_ld(markup), payloads.ld_fields)
    return F.array_join(F.transform(own, lambda x: F.concat_ws("/", x["title"], F.coalesce(x["price"].cast("string"), F.lit("-")), x["location_text"])), "|")


# --- routes and places

POINTS_JSON = '[{"lon":16.05,"lat":48.85},{"lon":16.1,"lat":48.9}]'


@cases("s string", ('<gpx><trk><trkseg><trkpt lat="48.85" lon="16.05"/><trkpt lon="16.1" lat="48.9"></trkpt></trkseg></trk></gpx>', POINTS_JSON), ('<gpx><rte><rtept lat="48.85" lon="16.05"/><rtept lat="48.9" lon="16.1"/></rte></gpx>', POINTS_JSON), ('<gpx><wpt lat="95" lon="16"/></gpx>', "[]"))
def gpx_tracks(s):
    return F.to_json(routes.gpx_points(s))


@cases("s string", ('{"type":"LineString","coordinates":[[16.05,48.85],[16.1,48.9]]}', POINTS_JSON), ('{"features":[{"geometry":{"type":"MultiLineString","coordinates":[[[16.05,48.85]],[[16.1,48.9]]]}}]}', POINTS_JSON), ('{"type":"LineString","coordinates":[[],[16.1],[16.05,48.85],[16.1,48.9]]}', POINTS_JSON), ('{"type":"Point","coordinates":[1,2]}', None))
def geojson_lines(s):
    return F.to_json(routes.geojson_points(s))


@cases("p string, s string", ("a.GEOJSON", '{"type":"LineString","coordinates":[[16.05,48.85],[16.1,48.9]]}', POINTS_JSON), ("a.gpx", '<trkpt lat="48.85" lon="16.05"/><trkpt lat="48.9" lon="16.1"/>', POINTS_JSON), ("a.txt", "x", None))
def route_files(p, s):
    return F.to_json(routes.route_points(p, s))


@cases("lat double, lon double", (48.85, 16.1, "true"), (50.0, 16.1, "false"), (None, None, "true"))
def box_or_unknown(lat, lon):
    return geo.in_box_or_unknown(lat, lon, (48.8, 48.95, 16.0, 16.2))


@cases("n int", (0, "1,2"), (2, "3,4"), (9, "5"))
def array_pages(n):
    five = F.array(*(F.lit(i) for i in range(1, 6)))
    page = F.coalesce(*(F.when(n == k, F.array_join(search.array_page(five, k, 2), ",")) for k in (0, 2, 9)))
    return page


def enrich_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present values stay; patterns in order."""
    rows = [
        ("Prodej rodinného domu 4+kk, 153m2 - Znojmo", None, None, None), ("Prodej domu", "Dům je po kompletní rekonstrukci, cihlová stavba.", None, None), ("Prodej novostavby 3+kk Brno", None, None, None), ("Byt 3+1", "Po rekonstrukci", "5+1", "Dobrý stav"),
        ("Dům k rekonstrukci", "Nemovitost vyžaduje rekonstrukci, dřevostavba.", None, None), ("Prodej bytu 3+1", "Panelový dům v klidné lokalitě.", None, None), ("Prodej stavebního pozemku 467 m²", "Pěkný pozemek.", None, None),
    ]
    df = spark.createDataFrame([(n, *r, None, None) for n, r in enumerate(rows)], "n int, title string, description string, disposition string, condition string, rooms int, construction_type string")
    return ingest.enrich(df).select("n", "disposition", "rooms", "condition", "construction_type")


QUERIES["enrich_cases"] = enrich_cases
ORACLES["enrich_cases"] = """SELECT CAST(n AS INTEGER) AS n, disposition, CAST(rooms AS INTEGER) AS rooms, condition, construction_type FROM (VALUES (0, '4+KK', 4, NULL, NULL), (1, NULL, NULL, 'Po rekonstrukci', 'Cihla'), (2, '3+KK', 3, 'Novostavba', NULL),
(3, '5+1', 5, 'Dobrý stav', NULL), (4, NULL, NULL, 'Před rekonstrukcí', 'Dřevo'), (5, '3+1', 3, NULL, 'Panel'), (6, NULL, NULL, NULL, NULL)) AS t(n, disposition, rooms, condition, construction_type)"""
