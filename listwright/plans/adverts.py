"""Queries on adverts, reviews and model answers: texts of the driver tables with the wordings that rules look for.

Every branch of a rule has rows.  The SQL states the rules over the same texts in its own words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, numbers, text
from ..operators import selectors
from .registry import query
from .views import VIEWS

VIEWS |= {
    "adverts": """
SELECT CAST(doc_id AS STRING) AS id, doc_id AS n,
  concat(CASE doc_id % 8 WHEN 0 THEN 'Hledám ' WHEN 1 THEN '  koupíme ' WHEN 2 THEN 'POPTÁVÁM ' WHEN 3 THEN 'Pronájem, hledám ' ELSE 'Prodej ' END, CASE doc_id % 5 WHEN 0 THEN 'Vily' WHEN 1 THEN 'bytu' WHEN 2 THEN 'byt a VILA' WHEN 3 THEN 'Pozemek' ELSE 'stanu' END, ' ', CAST(1 + doc_id % 13 AS STRING), '+', CASE doc_id % 3 WHEN 0 THEN 'kk' WHEN 1 THEN '1' ELSE 'x' END, CASE WHEN doc_id % 4 = 3 THEN concat(', ', CAST(20 + doc_id % 700 AS STRING), ' m²') ELSE '' END) AS title,
  concat(coalesce(text, ''), chr(10), CASE doc_id % 4 WHEN 0 THEN 'Smazat / Upravit' WHEN 1 THEN 'TISK' WHEN 2 THEN 'Pridat do' ELSE 'Tisková zpráva' END, chr(13), chr(10), '  [', CAST(1 + doc_id % 28 AS STRING), '. ', CAST(1 + doc_id % 12 AS STRING), '. 2024]', chr(10), chr(10),
    CASE doc_id % 6 WHEN 0 THEN 'Lokalita: Mapa 669 02 Znojmo  město Vidělo: 5 lidí' WHEN 1 THEN 'lokalita 67181 Nový Šaldorf, u lesa Cena : x' WHEN 2 THEN concat('dům ', CAST(100 + doc_id % 800 AS STRING), ' 11  Horní Věstonice u Nás') ELSE 'bez adresy' END, chr(10),
    CASE doc_id % 7 WHEN 0 THEN concat('CENA: ', CAST(1 + doc_id % 9 AS STRING), ' 590 000 Kč') WHEN 1 THEN 'Cena : 950 Kč' WHEN 2 THEN concat('za ', CAST(1000000 + doc_id AS STRING), ' Kč, cena dohodou') WHEN 3 THEN 'jen 900 Kč' WHEN 4 THEN concat('cena: 2', chr(160), '500', chr(160), '000', chr(160), 'Kč') WHEN 5 THEN '0999 Kč, 12000 Kč' ELSE 'dohodou' END, chr(10),
    CASE doc_id % 9 WHEN 0 THEN concat('pozemku o výměře ', CAST(1 + doc_id % 9 AS STRING), ' ', CAST(100 + doc_id % 800 AS STRING), ' m2') WHEN 1 THEN concat('Zahrada ', CAST(doc_id % 900 AS STRING), '0 m²') WHEN 2 THEN concat('zastavěná plocha cca ', CAST(50 + doc_id % 90 AS STRING), ' m2, parcel 1.200 ㎡') WHEN 3 THEN concat('s užitnou plochou 9', CAST(doc_id % 900 AS STRING), ' m2') WHEN 4 THEN concat('výměra: ', CAST(30 + doc_id % 100 AS STRING), ' m2') WHEN 5 THEN concat('obytných ', CAST(5 + doc_id % 9000 AS STRING), ' m2') ELSE 'plocha neznámá' END) AS body,
  CASE doc_id % 6 WHEN 0 THEN concat('Miroslav ', CAST(doc_id AS STRING)) WHEN 1 THEN 'ZNOJMO - město' WHEN 2 THEN 'Brno, Jihomoravský kraj' WHEN 3 THEN ' ' WHEN 4 THEN concat('Dobšice', CAST(doc_id AS STRING), ', OKRES Znojmo, kraj Vysočina') END AS place,
  CASE doc_id % 5 WHEN 0 THEN concat(' Obec', CAST(doc_id % 40 AS STRING), ' ') WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN 'Znojmo' END AS municipality, CASE doc_id % 4 WHEN 0 THEN 'Brno' WHEN 1 THEN 'ab' WHEN 2 THEN concat('Obec', CAST(doc_id % 40 AS STRING), ' ') END AS district,
  CASE doc_id % 7 WHEN 0 THEN concat(CAST(doc_id % 120 AS STRING), '.5, 16.', CAST(doc_id AS STRING)) WHEN 1 THEN '95,16' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'sever' WHEN 4 THEN concat(' -12.25 ,', CAST(doc_id % 250 AS STRING), ' ') WHEN 5 THEN ',' END AS coords,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id * 7 END AS address_code, concat('prodej-', lower(source), '-dum', CAST(doc_id AS STRING)) AS slug,
  CASE doc_id % 5 WHEN 0 THEN concat(CAST(1 + doc_id % 9 AS STRING), chr(160), CAST(100 + doc_id % 900 AS STRING), ' m²') WHEN 1 THEN concat('cca ', CAST(doc_id AS STRING), ' M2') WHEN 2 THEN 'bez' WHEN 3 THEN concat('2.', CAST(100 + doc_id % 900 AS STRING), ' m2') END AS area_text,
  CASE doc_id % 6 WHEN 0 THEN concat(CAST(doc_id % 30 AS STRING), ' 500 Kč') WHEN 1 THEN concat(CAST(doc_id AS STRING), chr(160), '250 000 za vše') WHEN 2 THEN '5.900.000' WHEN 3 THEN '600 000 000' WHEN 4 THEN 'na dotaz' END AS price_text,
  CAST(doc_id % 50 * 2 AS DOUBLE) AS area_listed, CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id % 50 * 2 AS DOUBLE) + CAST(doc_id % 11 - 5 AS DOUBLE) / 2 END AS area_registered
FROM {documents}""",
    "reviews": """
SELECT CAST(doc_id AS STRING) AS id, concat(coalesce(text, ''), CASE doc_id % 6 WHEN 0 THEN concat(chr(10), '## 🏁 Verdikt', chr(10), 'Koupit ', CAST(doc_id AS STRING), '.', chr(10), '## Další', chr(10), 'x') WHEN 1 THEN concat(chr(10), '## 5. ZÁVĚR', chr(10), 'Ne.', chr(10), '---', chr(10), 'x') WHEN 2 THEN concat(chr(10), 'doporučení: ', coalesce(text, '')) WHEN 3 THEN concat(chr(10), 'Doporučeno  ', chr(10), ' ', chr(10)) WHEN 4 THEN concat(' Shrnutí ', coalesce(text, '')) ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN concat(chr(10), '| a | ', CAST(doc_id AS STRING), ' |', chr(10), '|---|:--|', chr(10), '| 1 | 2 |', chr(10), '| 3 |', chr(10), 'konec') WHEN 1 THEN concat(chr(10), '| a |', chr(10), 'bez') ELSE '' END) AS content
FROM {documents}""",
    "model_answers": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, role, (conv_id * 31 + turn) % 7 AS kind,
  CASE (conv_id * 31 + turn) % 7 WHEN 0 THEN concat('```json', chr(10), chr(123), '"category": "kitchen", "description": "Byt ', CAST(conv_id AS STRING), ' ", "damage_detected": true, "confidence": 0.9', chr(125), chr(10), '```') WHEN 1 THEN concat(coalesce(text, ''), ' ["a", "b', CAST(turn AS STRING), '", ["c"]] konec') WHEN 2 THEN concat(chr(123), '"category" : "attic", "description": "', CAST(conv_id AS STRING), ' zprav') WHEN 3 THEN concat('Zde: ', chr(123), '"price_signal": ', chr(123), '"x": ', CAST(turn AS STRING), chr(125), chr(125), ' ', coalesce(text, ''))
    WHEN 4 THEN concat('  ```', chr(10), '[a', CAST(conv_id AS STRING), chr(10), '``` ') WHEN 5 THEN concat('[1] ', coalesce(text, ''), ' [2') ELSE text END AS raw,
  CASE conv_id % 5 WHEN 0 THEN ' LOW ' WHEN 1 THEN 'Fair' WHEN 2 THEN 'cheap' WHEN 3 THEN 'high' END AS signal, CASE turn % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'maybe' END AS feedback, CAST(turn % 9 - 3 AS DOUBLE) / 4 AS confidence
FROM {conversations}""",
    "uploads": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)) AS id, concat('foto.', CAST(l_orderkey AS STRING), CASE l_orderkey % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' WHEN 3 THEN '.heic' WHEN 4 THEN '' ELSE '.webp.txt' END) AS name, CAST(floor(l_extendedprice * 400) AS BIGINT) AS bytes,
  CASE l_suppkey % 5 WHEN 0 THEN 'image/png; q=1' WHEN 1 THEN 'IMAGE/WEBP' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'text/html' END AS content_type,
  CASE l_linenumber % 4 WHEN 0 THEN concat('https://h.example.org/uploads/', CAST(l_orderkey AS STRING), '/b.jpg') WHEN 1 THEN concat('/uploads/', CAST(l_orderkey AS STRING), '.jpg') WHEN 2 THEN concat(CAST(l_orderkey AS STRING), '.jpg') ELSE concat('http://h.example.org/', CAST(l_orderkey AS STRING), '.jpg') END AS stored_url,
  CASE l_orderkey % 7 WHEN 0 THEN 'Kitchen ' WHEN 1 THEN ' EXTERIOR' WHEN 2 THEN 'nesmysl' WHEN 3 THEN 'bathroom' WHEN 4 THEN '' WHEN 5 THEN 'land' END AS category
FROM {lineitem}""",
}


@query(r"""SELECT id, regexp_matches(title, '(?i)^\s*(hled[aá]m|koup[ií]m|popt[aá]v)') AS demand, nullif(upper(regexp_extract(title, '(?i)[0-9]+\+([0-9]+|kk)')), '') AS disposition, TRY_CAST(nullif(regexp_extract(upper(regexp_extract(title, '(?i)[0-9]+\+([0-9]+|kk)')), '^[0-9]+'), '') AS INTEGER) AS rooms,
CASE WHEN title ILIKE '%vila%' OR title ILIKE '%vily%' THEN 'House' WHEN title ILIKE '%byt%' THEN 'Apartment' ELSE 'Other' END AS kind, array_to_string(list_transform(string_split(slug, '-'), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS slug_title FROM adverts""")
def advert_titles(adverts):
    """Demands, rooms of the disposition, the first needle, titles of slugs."""
    d = text.disposition(F.col("title"))
    return adverts.select("id", text.is_demand(F.col("title")).alias("demand"), d.alias("disposition"), text.rooms(d).alias("rooms"), text.contains_first(F.col("title"), [("vila", "House"), ("vily", "House"), ("byt", "Apartment")], "Other").alias("kind"), text.slug_title(F.col("slug")).alias("slug_title"))


@query(r"""WITH p AS (SELECT id, TRY_CAST(regexp_replace(regexp_extract(body, '(?i)cena\s*:\s*([0-9][0-9\s\x{a0}\x{202f}\x{200d}]*)Kč', 1), '[^0-9]', '', 'g') AS BIGINT) AS near, TRY_CAST(regexp_replace(regexp_extract(body, '([0-9]{4}[0-9\s\x{a0}\x{202f}\x{200d}]*)Kč', 1), '[^0-9]', '', 'g') AS BIGINT) AS far,
TRY_CAST(regexp_replace(regexp_extract(replace(price_text, chr(160), ' '), '[0-9][0-9\s]*'), '[^0-9]', '', 'g') AS BIGINT) AS shown, TRY_CAST(regexp_replace(price_text, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM adverts)
SELECT id, coalesce(near, CASE WHEN far >= 1000 THEN far END) AS labelled, CASE WHEN shown BETWEEN 10000 AND 500000000 THEN shown END AS sane, digits FROM p""")
def advert_prices(adverts):
    """The labelled price, else the first plausible amount; plausible prices; all digits."""
    return adverts.select("id", numbers.price_labelled(F.col("body")).cast("long").alias("labelled"), numbers.price_sane(F.col("price_text")).cast("long").alias("sane"), numbers.digits(F.col("price_text")).cast("long").alias("digits"))


@query(r"""WITH p AS (SELECT id, title, body, title LIKE '%Pozemek%' AS plot, TRY_CAST(regexp_replace(regexp_extract(area_text, '[0-9][0-9\s\x{a0}\x{202f}\x{200d}]*'), '[^0-9]', '', 'g') AS INTEGER) AS first_run, TRY_CAST(regexp_replace(regexp_replace(area_text, '(?i)m[²2]|㎡', '', 'g'), '[^0-9]', '', 'g') AS DOUBLE) AS thousands,
TRY_CAST(regexp_replace(regexp_extract(body, '(?i)(plocha|výměra)[^0-9]{0,20}([0-9][0-9\s]*)(m[²2]|㎡)', 2), '[^0-9]', '', 'g') AS INTEGER) AS labelled, TRY_CAST(regexp_extract(body, '(^|[^0-9])([0-9]{2,4})\s*(m[²2]|㎡)', 2) AS INTEGER) AS lone,
TRY_CAST(regexp_replace(regexp_extract(concat(title, ' ', body), '(?i)(pozemk(u|em|y|ů|a)|zahrad(a|e|y|ou)|parcel)\s+(o\s+(výměře|velikosti|ploše)\s+)?([0-9][0-9\s.]+)(m[²2]|㎡)', 6), '[\s.]', '', 'g') AS DOUBLE) AS l0, TRY_CAST(regexp_extract(concat(title, ' ', body), '(?i)(zastav[eě]n[oaáíé]+\s+ploch(ou|o|em|e)|u[žz]itn[aáíé]+\s+ploch(ou|o|em|e))[^0-9]*([0-9]{2,5})\s*(m[²2]|㎡)', 4) AS DOUBLE) AS b0,
TRY_CAST(regexp_extract(body, '([0-9]{2,5})\s*(m[²2]|㎡)', 1) AS DOUBLE) AS t0, TRY_CAST(regexp_extract(title, '([0-9]{2,5})\s*(m[²2]|㎡)', 1) AS DOUBLE) AS h0, area_listed, area_registered FROM adverts),
q AS (SELECT *, CASE WHEN l0 BETWEEN 10 AND 100000 THEN l0 END AS l1, CASE WHEN b0 BETWEEN 10 AND 2000 THEN b0 END AS b1, CASE WHEN t0 BETWEEN 10 AND 5000 THEN t0 END AS t1, CASE WHEN h0 BETWEEN 10 AND 100000 THEN h0 END AS h1 FROM p),
r AS (SELECT *, CASE WHEN b1 IS NULL THEN t1 END AS t2 FROM q), s AS (SELECT *, coalesce(l1, CASE WHEN plot THEN t2 END) AS l2, coalesce(b1, CASE WHEN NOT (plot AND l1 IS NULL) THEN t2 END) AS b2 FROM r)
SELECT id, first_run, thousands, coalesce(first_run, labelled, CASE WHEN lone > 10 AND lone < 2000 THEN lone END) AS by_strategies, coalesce(b2, CASE WHEN NOT plot AND l2 IS NULL THEN h1 END) AS built, coalesce(l2, CASE WHEN plot AND b2 IS NULL THEN h1 END) AS land, abs(area_registered - area_listed) / CASE WHEN area_listed > 1 THEN area_listed ELSE 1 END < 0.05 AS agrees FROM s""")
def advert_areas(adverts):
    """First runs of digits, thousands with a dot, the chain of strategies, both areas out of the texts, agreement with a registry."""
    built, land = numbers.areas_inferred(F.col("title"), F.col("body"), F.when(F.col("title").contains("Pozemek"), "Pozemek").otherwise("Dům"))
    return adverts.select("id", numbers.area_first(F.col("area_text")).alias("first_run"), numbers.area_thousands(F.col("area_text")).alias("thousands"), numbers.area_by_strategies(F.col("area_text"), F.col("body")).alias("by_strategies"), built.alias("built"), land.alias("land"), numbers.areas_agree(F.col("area_registered"), F.col("area_listed")).alias("agrees"))


@query(r"""WITH p AS (SELECT *, string_split(coords, ',') AS c, trim(regexp_replace(place, '(?i),?\s*(okres|kraj|okr\.)\s+\S+', '', 'g')) AS bare, nullif(regexp_extract(body, '(?i)lokalita\s*:?\s*(mapa\s*)?([0-9]{3}\s?[0-9]{2}\s+[\p{L}\p{N}_][\p{L}\p{N}_\s\x{a0},.-]+?)(\s+vidělo|\s+cena\s*:|\n|$)', 2), '') AS near, nullif(regexp_extract(body, '[0-9]{3}\s?[0-9]{2}\s+\p{Lu}[\p{Ll}\s-]+'), '') AS far FROM adverts),
a AS (SELECT id, CASE WHEN len(c) = 2 THEN TRY_CAST(trim(c[1]) AS DOUBLE) END AS y, CASE WHEN len(c) = 2 THEN TRY_CAST(trim(c[2]) AS DOUBLE) END AS x, * EXCLUDE (id) FROM p),
t AS (SELECT id, string_agg(t, '|' ORDER BY k) AS tries FROM (SELECT id, t, min(k) AS k FROM (SELECT id, unnest([trim(place), CASE WHEN municipality IS NOT NULL THEN trim(concat_ws(', ', municipality, district)) END, trim(district)]) AS t, unnest([1, 2, 3]) AS k FROM adverts) WHERE length(t) >= 3 GROUP BY id, t) GROUP BY id)
SELECT a.id, CASE WHEN coalesce(trim(place), '') = '' THEN 'okres Znojmo' WHEN regexp_matches(place, '(?i)znojmo|jihomoravsk') THEN place ELSE concat(place, ', okres Znojmo') END AS with_district, left(trim(regexp_replace(coalesce(near, far, ''), '[\s\x{a0}]+', ' ', 'g')), 100) AS postal, coalesce(t.tries, '') AS tries,
CASE WHEN y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 THEN y END AS lat, CASE WHEN y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 THEN x END AS lon, coalesce(nullif(trim(municipality), ''), left(bare, 80)) AS asked, CASE WHEN address_code IS NULL THEN 'https://nahlizenidokn.cuzk.cz' ELSE concat('https://vdp.cuzk.cz/vdp/ruian/adresnimista/', address_code) END AS registry FROM a LEFT JOIN t USING (id)""")
def advert_places(adverts):
    """Completed and postal locations, geocoding tries, coordinates, the registry's question and address."""
    point = text.lat_lon(F.col("coords"))
    return adverts.select(
        "id", text.location_with_district(F.col("place")).alias("with_district"), text.location_postal(F.col("body")).alias("postal"), F.array_join(text.geocode_attempts(F.col("place"), F.col("municipality"), F.col("district")), "|").alias("tries"),
        point["lat"].alias("lat"), point["lon"].alias("lon"), text.prefer_municipality(F.col("municipality"), F.col("place")).alias("asked"), text.cadastre_url(F.col("address_code")).alias("registry"),
    )


@query(r"""SELECT id, left(array_to_string(list_filter(list_transform(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^\s*(smazat|upravit|topovat|nahlásit|oblíbené|p[řr]idat do|spam|tisk|facebook|sdílejte|doporučit|podobné)\s*/?\s*(smazat|upravit|topovat)?\s*$')
AND NOT regexp_matches(x, '^[-\s]*\[?[0-9]{1,2}\.\s*[0-9]{1,2}\.\s*[0-9]{4}\]?\s*$')), chr(10)), 5000) AS description FROM adverts""")
def advert_descriptions(adverts):
    return adverts.select("id", text.clean_description(F.col("body")).alias("description"))


@query(r"""WITH l AS (SELECT *, string_split(content, chr(10)) AS lines, list_position(list_transform(string_split(content, chr(10)), lambda x: contains(lower(x), 'verdikt') OR contains(lower(x), 'doporučen')), true) AS line_no, regexp_extract(content, '(?i)(##\s*)?(🏁|verdikt|doporučení)') AS head1, regexp_extract(content, '(?i)(##\s+[0-9]+\.\s*)?(závěr|celkové|shrnutí)') AS head2, left(content, 600) AS h FROM reviews),
s AS (SELECT *, CASE WHEN coalesce(nullif(head1, ''), head2) = '' THEN '' ELSE trim(string_split_regex(substr(content, strpos(content, coalesce(nullif(head1, ''), head2))), '\n##|\n---')[1]) END AS sec, CASE WHEN contains(h, chr(10)) THEN length(h) - strpos(reverse(h), chr(10)) END AS line FROM l),
c AS (SELECT *, CASE WHEN line > 300 THEN left(h, line) ELSE h END AS kept FROM s)
SELECT id, CASE WHEN coalesce(line_no, 0) = 0 THEN CASE WHEN length(content) > 600 THEN concat(h, '…') ELSE content END ELSE regexp_replace(array_to_string(lines[line_no:line_no + 14], chr(10)), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g') END AS verdict, CASE WHEN length(sec) > 1500 THEN concat(left(sec, 1500), chr(10), '…') ELSE sec END AS section,
regexp_extract(content, '\|[^\n]+\|\n\|[-| :]+\|\n(\|[^\n]+\|\n?)+') AS first_table, CASE WHEN length(content) > 600 THEN concat(kept, chr(10), '[…', length(kept) * 100 // length(content), ' %]') ELSE content END AS capped FROM c""")
def review_extracts(reviews):
    """Verdict lines, verdict sections, first tables, capped texts."""
    c = F.col("content")
    return reviews.select("id", text.verdict(c).alias("verdict"), text.verdict_section(c).alias("section"), text.first_table(c).alias("first_table"), text.capped(c, 600).alias("capped"))


@query(r"""WITH s AS (SELECT id, content, trim(s) AS s, k FROM (SELECT id, content, unnest(string_split(content, '.')) AS s, unnest(range(len(string_split(content, '.')))) AS k FROM reviews)), f AS (SELECT id, s, k, trim(regexp_replace(lower(s), '[^a-z0-9 ]', '', 'g')) AS w FROM s WHERE s <> ''),
u AS (SELECT id, s, k, sum(length(s) + 2) OVER (PARTITION BY id ORDER BY k) AS used FROM (SELECT * FROM f WHERE length(w) >= 10 QUALIFY row_number() OVER (PARTITION BY id, w ORDER BY k) = 1)), o AS (SELECT id, trim(string_agg(s || '. ', '' ORDER BY k)) AS out FROM u WHERE used <= 800 GROUP BY id)
SELECT r.id, coalesce(o.out, left(r.content, 800)) AS sentences FROM reviews r LEFT JOIN o USING (id)""")
def review_sentences(reviews):
    """Sentences without repeats and fragments, up to 800 characters."""
    return reviews.select("id", text.sentences_once(F.col("content"), 800).alias("sentences"))


@query(r"""WITH f AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '^\s*```[A-Za-z]*\s*\n?', ''), '\n?\s*```\s*$', '')) AS bare FROM model_answers), g AS (SELECT *, regexp_extract(bare, '(?s)\[.*\]') AS a, regexp_extract(bare, '(?s)\{.*\}') AS o, nullif(regexp_extract(raw, '"category"\s*:\s*"([^"]+)"', 1), '') AS category FROM f)
SELECT id, bare, CASE WHEN json_valid(a) THEN nullif(a, '') END AS island, CASE WHEN json_valid(o) THEN nullif(o, '') END AS object, category, CASE WHEN category IS NOT NULL THEN trim(nullif(regexp_extract(raw, '"description"\s*:\s*"([^"]*)', 1), '')) END AS description, CASE WHEN category IS NOT NULL THEN regexp_matches(raw, '"damage_detected"\s*:\s*true') END AS damage,
CASE WHEN trim(signal) ILIKE 'low' THEN 'low' WHEN signal ILIKE 'fair' THEN 'fair' WHEN signal ILIKE 'high' THEN 'high' END AS price_signal, coalesce(feedback IN ('correct', 'wrong'), true) AS feedback_valid, CASE WHEN confidence < 0 THEN 0.0 WHEN confidence > 1 THEN 1.0 ELSE confidence END AS confidence FROM g""")
def answers_read(model_answers):
    """Answers without fences, their JSON islands, salvaged classifications, price signals, clamped confidences."""
    raw, got = F.col("raw"), jsons.salvage(F.col("raw"))
    return model_answers.select(
        "id", jsons.strip_fences(raw).alias("bare"), jsons.array_island(raw).alias("island"), jsons.object_island(raw).alias("object"), got["category"].alias("category"), got["description"].alias("description"), got["damage_detected"].alias("damage"),
        jsons.price_signal(F.col("signal")).alias("price_signal"), selectors.valid_feedback(F.col("feedback")).alias("feedback_valid"), numbers.clamp(F.col("confidence")).alias("confidence"),
    )


@query(r"""SELECT id, right(lower(name), 4) IN ('.jpg', '.png') AND bytes <= 10485760 OR right(lower(name), 5) = '.heic' AND bytes <= 10485760 AS allowed, CASE lower(string_split(content_type, ';')[1]) WHEN 'image/png' THEN '.png' WHEN 'image/webp' THEN '.webp' WHEN 'image/gif' THEN '.gif' ELSE '.jpg' END AS extension,
concat('/uploads/', regexp_extract(stored_url, '[^/]+(/b\.jpg)?$')) AS path, CASE trim(lower(category)) WHEN 'kitchen' THEN 'kitchen' WHEN 'exterior' THEN 'exterior' WHEN 'bathroom' THEN 'bathroom' WHEN 'land' THEN 'land' ELSE 'other' END AS category FROM uploads""")
def uploads_read(uploads):
    """Which files may be uploaded, extensions by content type, local paths, photo categories."""
    return uploads.select("id", selectors.upload_allowed(F.col("name"), F.col("bytes")).alias("allowed"), text.extension_of(F.col("content_type")).alias("extension"), text.local_path(F.col("stored_url")).alias("path"), text.category(F.col("category")).alias("category"))


@query("SELECT id, price / CASE WHEN built <> 0 THEN built WHEN land <> 0 THEN land END AS per_m2 FROM (SELECT id, CAST(price AS DOUBLE) AS price, CASE WHEN CAST(id AS INT) % 4 = 0 THEN 0.0 ELSE area_built_up END AS built, area_land AS land FROM listings)")
def per_area_batch(listings):
    """The batch job's rule: an area of 0 counts as none."""
    built = F.when(F.col("id").cast("int") % 4 == 0, 0.0).otherwise(F.col("area_built_up"))
    return listings.select("id", numbers.per_area_batch(F.col("price").cast("double"), built, F.col("area_land")).alias("per_m2"))
