"""Queries on reports, retrieval prompts, duplicate candidates, work on places and on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import export, files, ingest, rag, ranking, search
from ..sources import routes
from . import adverts as _adverts  # noqa: F401  its views
from .registry import query
from .views import VIEWS

#: Wordings of every branch of both rule sets, one a document; the rest of the text is the document's own.
WORDINGS = ["Novostavba", "dům VE VÝSTAVBĚ", "na klíč, pod klíč", "developerský projekt", "po kompletní rekonstrukci", "Po Rekonstrukci, dřevostavba", "kompletně zrekonstruovaný", "před rekonstrukcí", "vyžaduje rekonstrukci; z cihel", "k demolici", "havarijní stav", "zachovalý stav, panelový dům", "udržovaný stav", "v zachovalém stavu", "cihlová stavba k rekonstrukci", "PANELÁK", "roubenka", "montovaný dům", "skelet", "zděný dům", "zděná vila", "panel", "stan"]
VIEWS |= {
    "wordings": "SELECT CAST(doc_id AS STRING) AS id, CASE doc_id % 46 "
    + " ".join(f"WHEN {2 * i} THEN '{w}'" for i, w in enumerate(WORDINGS))
    + " ELSE concat('Inzerát ', CAST(doc_id AS STRING)) END AS title, concat(coalesce(text, ''), ' ', CASE doc_id % 46 "
    + " ".join(f"WHEN {2 * i + 1} THEN '{w}'" for i, w in enumerate(WORDINGS))
    + " ELSE '' END) AS description, CASE doc_id % 10 WHEN 0 THEN 'Dobry stav' END AS condition, CASE doc_id % 11 WHEN 0 THEN 'Kámen' END AS construction_type, CAST(NULL AS STRING) AS disposition, CAST(NULL AS INT) AS rooms FROM {documents}",
    "album": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)) AS id, CAST(l_partkey AS STRING) AS listing_id, CAST(l_orderkey % 60 AS INT) AS order_index, CASE l_orderkey % 5 WHEN 0 THEN concat('http://i/', CAST(l_orderkey AS STRING), '.PNG?x=1') WHEN 1 THEN concat('http://i/', CAST(l_orderkey AS STRING), '.gif') WHEN 2 THEN ' ' ELSE concat('http://i/', CAST(l_orderkey AS STRING), '.webp') END AS original_url, CASE l_orderkey % 7 WHEN 0 THEN concat('/uploads/', CAST(l_orderkey AS STRING), '.jpg') END AS stored_url,
  CASE l_linenumber % 3 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'damage' END AS photo_category, CASE l_linenumber % 4 WHEN 0 THEN NULL ELSE concat('Popis ', l_returnflag, CAST(l_orderkey AS STRING)) END AS photo_description, CASE l_linenumber % 5 WHEN 0 THEN NULL ELSE l_linenumber % 2 = 1 END AS damage_detected, CASE l_suppkey % 3 WHEN 0 THEN concat('["plíseň","vada', CAST(l_suppkey AS STRING), '"]') WHEN 1 THEN '[]' END AS photo_labels
FROM {lineitem}""",
}

CONDITION_SQL = r"""CASE WHEN regexp_matches(w, '(?i)novostavb|ve výstavb|pod klíč|developerský projekt') THEN 'Novostavba' WHEN regexp_matches(w, '(?i)po (kompletní |celkové )?rekonstrukci|kompletně zrekon') THEN 'Po rekonstrukci' WHEN regexp_matches(w, '(?i)před rekonstrukcí|(k|vyžaduje|potřebuje) rekonstrukci') THEN 'Před rekonstrukcí' WHEN regexp_matches(w, '(?i)k demolici|velmi špatný stav|havarijní') THEN 'K demolici' WHEN regexp_matches(w, '(?i)(zachovalý|dobrý|udržovaný) stav|v dobrém stavu{0}') THEN 'Dobrý stav' END"""
CONSTRUCTION_SQL = r"""CASE WHEN regexp_matches(w, '(?i)cihlov[áý]|ciheln|cihla|z cihel') THEN 'Cihla' WHEN regexp_matches(w, '(?i)panel[oá]|panelový dům') THEN 'Panel' WHEN regexp_matches(w, '(?i)dřevěn|dřevosta|srubov|rouben|ze dřeva') THEN 'Dřevo' WHEN regexp_matches(w, '(?i)montovan|prefabrikát|skelet') THEN 'Montovaná' WHEN regexp_matches(w, '(?i)(^|[^\p{L}\p{N}_])zděn[aáéý]([^\p{L}\p{N}_]|$)') THEN 'Zděná' END"""


@query(f"""WITH t AS (SELECT *, concat_ws(' ', title, description) AS w FROM wordings) SELECT id, coalesce(condition, {CONDITION_SQL.format("")}) AS condition, coalesce(construction_type, {CONSTRUCTION_SQL}) AS construction, coalesce(condition, {CONDITION_SQL.format("|v zachovalém")}) AS condition_later, coalesce(construction_type, {CONSTRUCTION_SQL}) AS construction_later FROM t""")
def conditions_of_texts(wordings):
    """Conditions and constructions by the ingest's rules and by the later backfill's; present values stay."""
    first = ingest.enrich(wordings.withColumns({"given": F.col("condition"), "given_type": F.col("construction_type")}))
    again = first.select("id", "title", "description", F.col("condition").alias("first"), F.col("construction_type").alias("first_type"), F.col("given").alias("condition"), F.col("given_type").alias("construction_type"))
    return ingest.backfill_condition(again).select("id", F.col("first").alias("condition"), F.col("first_type").alias("construction"), F.col("condition").alias("condition_later"), F.col("construction_type").alias("construction_later"))


@query("""SELECT id, concat_ws(chr(10), concat('# ', title, chr(10)), concat('Typ: ', property_type, ' | Nabídka: ', offer_type), 'Cena: ' || format('{:,}', CAST(price AS BIGINT)) || ' Kč', concat('Lokalita: ', location_text), 'Obec: ' || municipality, 'Okres: ' || district, 'Dispozice: ' || disposition, 'Plocha: ' || CAST(area_built_up AS VARCHAR) || ' m²', 'Pozemek: ' || CAST(area_land AS VARCHAR) || ' m²', 'Stav: ' || condition, 'Konstrukce: ' || construction_type, chr(10) || '## Popis' || chr(10) || description) AS content FROM listings""")
def listing_texts(listings):
    """The text of a listing that is embedded."""
    return listings.select("id", rag.listing_text().alias("content"))


ALBUM_SQL = "SELECT listing_id, k, row_number() OVER (PARTITION BY listing_id ORDER BY k) AS n, original_url, stored_url FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY order_index, id) AS k FROM album) WHERE k <= 50 AND trim(coalesce(stored_url, original_url)) <> ''"
NAME_SQL = "concat('foto_', lpad(CAST(n AS VARCHAR), 2, '0'), CASE WHEN original_url LIKE '%.PNG?x=1' THEN '.png' WHEN original_url LIKE '%.webp' THEN '.webp' ELSE '.jpg' END)"


@query(f"SELECT listing_id, {NAME_SQL} AS name, coalesce(stored_url, original_url) AS direct_url, original_url AS source_url FROM ({ALBUM_SQL})")
def photo_links(album):
    """Each listing's first fifty pictures with names by position."""
    own = search.nested_photos(album).select("listing_id", F.explode(export.photo_links(F.col("photos"))).alias("p"))
    return own.select("listing_id", "p.name", "p.direct_url", "p.source_url")


@query(f"""WITH p AS ({ALBUM_SQL}), l AS (SELECT listing_id, string_agg('- [' || {NAME_SQL} || '](' || original_url || ')', chr(10) ORDER BY n) FILTER (WHERE n <= 10) AS shown, count(*) AS many FROM p GROUP BY listing_id)
SELECT id, concat(CASE WHEN is_new THEN 'N ' ELSE 'S ' END, concat_ws(', ', location_text, municipality, 'okres ' || district, region), '; ', coalesce(format('{{:,}}', CAST(price AS BIGINT)) || ' Kč', 'neuvedena'), '; ', coalesce(nullif(concat_ws(' / ', CAST(area_built_up AS VARCHAR) || ' m² užitná', CAST(area_land AS VARCHAR) || ' m² pozemek'), ''), 'neuvedena'), '; ', coalesce('**Počet pokojů:** ' || rooms || chr(10), ''), coalesce('**Stav dle inzerátu:** ' || condition || chr(10), ''), url, chr(10), coalesce(shown, ''), CASE WHEN many > 10 THEN concat(chr(10), '- … +', many - 10) ELSE '' END, ' složka') AS text
FROM (SELECT *, regexp_matches(concat_ws(' ', condition, description), '(?i)novostavb|ve výstavb|pod klíč|developerský projekt|dokončení 202') OR coalesce(regexp_matches(condition, '(?i)nov[ýá]'), false) AS is_new FROM listings) LEFT JOIN l ON listing_id = id""")
def instruction_texts(listings, album):
    """Instructions by the building's age: a template with the listing's values and the first ten picture links."""
    body = "{{LOCATION}}; {{PRICE}}{{PRICE_NOTE}}; {{AREA}}; {{ROOMS_LINE}}{{CONDITION_LINE}}{{URL}}\n{{PHOTO_LINKS_SECTION}} {{DRIVE_FOLDER_SECTION}}"
    return export.instructions(search.beside(listings, search.nested_photos(album)), "N " + body, "S " + body, "složka")


@query("""SELECT listing_id, left(string_agg(line, chr(10) ORDER BY order_index, line), 3000) AS digest FROM (SELECT listing_id, order_index, concat('[', coalesce(photo_category, 'other'), '] ', photo_description, CASE WHEN damage_detected THEN ' ⚠' ELSE '' END, coalesce(' (' || array_to_string(CAST(photo_labels AS JSON)::VARCHAR[], ', ') || ')', '')) AS line FROM album WHERE photo_description IS NOT NULL) GROUP BY listing_id""")
def photo_digests(album):
    """Numbered picture descriptions of a listing for the prompt."""
    return rag.photo_digest(album)


TOOL_SQL = "concat_ws(' ', body, CASE n % 5 WHEN 0 THEN 'DĚDICTVÍ' WHEN 1 THEN 'Studna' WHEN 2 THEN 'od 2027' WHEN 3 THEN 'pozůstalost, předání ihned' END)"


@query(f"SELECT id, contains(w, 'dědic') OR contains(w, 'pozůstal') AS inherited, contains(w, 'předání') OR contains(w, '2027') AS delayed, contains(w, 'studn') AS well, contains(w, 'pozemek') OR contains(w, 'zahrad') AS land FROM (SELECT id, lower({TOOL_SQL}) AS w FROM adverts)")
def prompt_sections(adverts):
    """Sections of the tool prompt that a text calls for."""
    flags = rag.tool_flags(F.expr(TOOL_SQL))
    return adverts.select("id", *(c.alias(n) for n, c in flags.items()))


@query(r"""WITH w AS (SELECT id, municipality, property_type, price, list_distinct(string_split_regex(lower(title), '[^\p{L}\p{N}+]+')) AS words FROM listings WHERE is_active AND municipality IS NOT NULL AND price > 0)
SELECT a.id AS id1, b.id AS id2, CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / len(list_distinct(list_concat(a.words, b.words))) AS title_similarity FROM w a JOIN w b ON a.municipality = b.municipality AND a.property_type = b.property_type AND a.id < b.id AND abs(a.price - b.price) * 20 <= greatest(a.price, b.price)""")
def duplicate_candidates(listings):
    """Pairs that could be one property: same town and kind, prices within a twentieth."""
    return rag.duplicate_candidates(listings)


@query("SELECT listing_id, id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, id) AS k FROM analyses WHERE source = 'claude') WHERE k = 1")
def latest_of_source(analyses):
    return ranking.latest_analysis(analyses, "claude").select("listing_id", "id")


ASKED = [((i * 29) % 17 - 8) / 20 for i in range(64)]
ASKED_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in ASKED) + "]"


@query(f"""WITH v AS (SELECT a.listing_id, a.id, a.content, a.created_at, list_distance(CAST(e.embedding AS DOUBLE[]), {ASKED_SQL}) AS distance FROM analyses a LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = a.id AND e.vec_id % 2 = 0 WHERE a.listing_id IN ('6', '7')),
k AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY distance, id) AS near, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, id) AS late, count(distance) OVER (PARTITION BY listing_id) AS found FROM v),
h AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY distance, created_at, id) AS pos FROM k WHERE CASE WHEN found > 0 THEN distance IS NOT NULL AND near <= 3 ELSE late <= 3 END)
SELECT listing_id, concat('## Inzerát', chr(10), 'L', listing_id, chr(10), chr(10), '## Uložené analýzy (kontext)', chr(10), string_agg(concat(chr(10), '### Analýza [', pos, ']', chr(10), CASE WHEN length(content) > 300 THEN concat(left(content, 300), '…') ELSE content END), chr(10) ORDER BY pos), chr(10), chr(10), '## Dotaz', chr(10), 'Koupit?') AS prompt, CAST(count(*) AS INTEGER) AS n_chunks FROM h GROUP BY listing_id""")
def asked_prompts(analyses, embeddings):
    """Prompts of two listings: one with vectors, one that falls back to its newest analyses."""
    held = embeddings.filter("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    own, out = analyses.join(held, "id", "left"), None
    for listing in ("6", "7"):
        hits = rag.with_fallback(rag.similar(own, ASKED, 3, listing, vector_column="vector"), own, listing, 3)
        one = rag.ask("Koupit?", rag.chunks(hits).withColumn("content", F.col("content_excerpt")), f"L{listing}").withColumn("listing_id", F.lit(listing))
        out = one if out is None else out.unionByName(one)
    return out.select("listing_id", "prompt", "n_chunks").filter("n_chunks > 0")


@query("""WITH th AS (SELECT listing_id, string_agg(original_url, ' ' ORDER BY order_index, id) AS photos FROM photos GROUP BY listing_id), st AS (SELECT listing_id, arg_max({'s': status, 'n': notes}, last_updated) AS x FROM states WHERE user_id = '5' GROUP BY listing_id)
SELECT l.id, coalesce(th.photos, '') AS photos, coalesce(s.x, p.x).s AS status, coalesce(s.x, p.x).n AS notes FROM listings l LEFT JOIN th ON th.listing_id = l.id LEFT JOIN st s ON s.listing_id = l.id LEFT JOIN st p ON p.listing_id = l.duplicate_of_listing_id""")
def listing_details(listings, photos, states):
    """Nested pictures in order and the user's state, which a duplicate borrows."""
    own = search.details(listings, photos, states, "5")
    return own.select("id", F.coalesce(F.array_join(F.transform("photos", lambda p: p["original_url"]), " "), F.lit("")).alias("photos"), "state.status", "state.notes")


@query("""SELECT r.region AS area_id, concat('{"name":"', r.region, '","radius":', length(r.region) - 1, ',"municipalityCount":', coalesce(n, 0), ',"municipalities":[', coalesce(names, ''), ']}') AS json FROM (SELECT DISTINCT region FROM listings UNION ALL SELECT 'Region9') r LEFT JOIN (SELECT region, count(*) AS n, string_agg('"' || municipality || '"', ',' ORDER BY municipality) AS names FROM (SELECT DISTINCT region, municipality FROM listings WHERE municipality IS NOT NULL) GROUP BY region) m USING (region)""")
def area_documents(listings):
    """Areas with the sorted names of their towns; one area has none."""
    names = listings.select("region").distinct().unionByName(listings.groupBy().agg(F.lit("Region9").alias("region")))
    areas = names.select(F.col("region").alias("area_id"), (F.length("region") - 1).alias("radius"))
    return export.area_json(listings.select(F.col("region").alias("area_id"), F.col("municipality").alias("name")), areas)


DRIVE_SQL = "SELECT concat('f', CAST(doc_id AS STRING), '.', lang) AS name, text AS content, source AS folder_id, CASE WHEN doc_id % 3 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime_type, doc_id % 40 AS modified_at FROM documents"


@query(f"SELECT name FROM ({DRIVE_SQL}) WHERE (contains(content, 'the') OR contains(name, '7.')) AND folder_id = 'src1' AND mime_type = 'text/html' ORDER BY modified_at DESC, name LIMIT 30")
def drive_search(documents):
    """Content or name within a folder and type, the newest thirty."""
    own = documents.selectExpr("concat('f', CAST(doc_id AS STRING), '.', lang) AS name", "text AS content", "source AS folder_id", "CASE WHEN doc_id % 3 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime_type", "doc_id % 40 AS modified_at")
    return files.search_drive(own, "the", "src1", "text/html").unionByName(files.search_drive(own, "7.", "src1", "text/html")).distinct().orderBy(F.col("modified_at").desc(), "name").limit(30).select("name")


@query("""SELECT mode, position, name FROM (SELECT 'name' AS mode, CAST(row_number() OVER (ORDER BY s_nationkey < 5 DESC, lower(s_name), s_name) AS INTEGER) AS position, s_name AS name FROM supplier UNION ALL SELECT 'size', CAST(row_number() OVER (ORDER BY CASE WHEN s_nationkey >= 5 THEN s_acctbal END DESC NULLS LAST, s_name) AS INTEGER), s_name FROM supplier UNION ALL SELECT 'modified', CAST(row_number() OVER (ORDER BY s_suppkey % 30 DESC, s_name) AS INTEGER), s_name FROM supplier) WHERE position <= 20""")
def folder_listings(supplier):
    """The first twenty entries of a folder by name, size and time."""
    own = supplier.select(F.col("s_name").alias("name"), (F.col("s_nationkey") < 5).alias("is_dir"), F.when(F.col("s_nationkey") >= 5, F.col("s_acctbal")).alias("size"), (F.col("s_suppkey") % 30).alias("modified_at"))
    out = None
    for mode in ("name", "size", "modified"):
        kept = files.listed(own, mode).limit(20).agg(F.collect_list("name").alias("n")).select(F.lit(mode).alias("mode"), F.posexplode("n").alias("position", "name"))
        out = kept if out is None else out.unionByName(kept)
    return out.select("mode", (F.col("position") + 1).alias("position"), "name")


@query("""WITH t AS (SELECT id, CAST(id AS INT) % 80 AS y, CAST(id AS INT) % 170 AS x FROM listings) SELECT id, CASE WHEN CAST(id AS INT) % 3 = 0 THEN concat('LINESTRING(1 2, 3 ', id, ')') ELSE concat('LINESTRING(', x, ' ', y, ', ', x + 1, ' ', y + 2, ')') END AS line, CASE WHEN CAST(id AS INT) % 4 = 3 THEN NULL ELSE concat(y, ' ', x, ', ', y + 1, ' ', x, ', ', y, ' ', x) END AS ring FROM t""")
def lines_and_rings(listings):
    """Route lines, straight where none is known, and outlines for display; a text without a polygon has none."""
    n, num = F.col("id").cast("int"), lambda c: F.format_string("%d", c)
    own = listings.select("id", F.col("id").alias("area_id"), (n % 80).cast("double").alias("lat1"), (n % 170).cast("double").alias("lon1"), (n % 80 + 2).cast("double").alias("lat2"), (n % 170 + 1).cast("double").alias("lon2"))
    known = listings.filter(n % 3 == 0).select(F.col("id").alias("area_id"), F.concat(F.lit("LINESTRING(1 2, 3 "), "id", F.lit(")")).alias("wkt"))
    x, y = F.col("lon1").cast("int"), F.col("lat1").cast("int")
    pair = lambda a, b: F.concat_ws(" ", num(a), num(b))
    polygon = F.when(F.col("id").cast("int") % 4 == 3, "POLYGON EMPTY").otherwise(F.concat(F.lit("MULTIPOLYGON((("), F.concat_ws(", ", pair(x, y), pair(x, y + 1), pair(x, y)), F.lit(")), ((1 1, 2 2, 3 1, 1 1)))")))
    ring = F.transform(geo.display_ring(polygon), lambda p: F.concat_ws(" ", num(p["lat"].cast("int")), num(p["lon"].cast("int"))))
    return routes.looked_up(own, known).select("id", F.col("wkt").alias("line"), F.array_join(ring, ", ").alias("ring"))


@query("SELECT n_name AS name, concat('POLYGON((', n_nationkey, ' 1, 2 2, 3 1))') AS wkt, r_name AS district FROM nation JOIN region ON r_regionkey = n_regionkey")
def town_tables(nation, region):
    """Town polygons of a converted table, whatever its columns are called."""
    own = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("nazev"), F.concat(F.lit("POLYGON(("), F.col("n_nationkey").cast("string"), F.lit(" 1, 2 2, 3 1))")).alias("geom"), F.col("r_name").alias("NAZ_OKRES"))
    return routes.municipalities(own).select("name", "wkt", "district")
