"""The query catalogue: every operator family on the driver tables, with SQL where SQL can express it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, jsons, krovak, numbers, text, vector
from ..operators import dataset, export, files, ingest, rag, ranking, search, selectors, spatial, stats
from ..shared import tasks_for
from ..sources import html
from ..streaming import ingest as streams
from . import adverts, records, reports  # noqa: F401
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .stateful import OBSERVED_SQL, observed
from .views import NOW as NOW_SQL
from .views import view  # noqa: F401

NOW = datetime(2024, 2, 1)


# --- search -----------------------------------------------------------------

FLAGSHIP = search.ListingFilter(page=2, page_size=20, property_type="house", price_min=1_000_000, price_max=6_000_000, rooms_min=2, sort_by="price", descending=True)


@query("""SELECT id, title, price, rooms, source_name FROM listings WHERE is_active AND property_type = 'House' AND price BETWEEN 1000000 AND 6000000 AND rooms >= 2
ORDER BY price DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def search_filtered_page(listings):
    return search.search(listings, FLAGSHIP)[0].select("id", "title", "price", "rooms", "source_name")


@query("SELECT count(*) AS total FROM listings WHERE is_active AND property_type = 'House' AND price BETWEEN 1000000 AND 6000000 AND rooms >= 2")
def search_total(listings):
    return search.search(listings, FLAGSHIP)[1]


@query("SELECT id, location_text FROM listings WHERE is_active AND ((municipality IS NOT NULL AND municipality ILIKE '%town1%') OR location_text ILIKE '%town1%') AND ((district IS NOT NULL AND district ILIKE '%district2%') OR location_text ILIKE '%district2%')")
def search_ilike_or(listings):
    return search.filtered(listings, search.ListingFilter(municipality="town1", district="district2")).select("id", "location_text")


@query("""SELECT id, source_code, area_built_up, area_land, condition, construction_type, disposition FROM listings WHERE is_active AND source_code IN ('src1', 'src2', 'src4') AND area_built_up >= 30 AND area_built_up <= 150 AND area_land <= 480
AND offer_type = 'Sale' AND first_seen_at >= TIMESTAMP '2023-05-01 00:00:00'""")
def search_dynamic_and(listings):
    f = search.ListingFilter(sources=["src1", "src2", "src4"], built_min=30, built_max=150, land_max=480, offer_type="SALE", property_type="castle", first_seen_from=datetime(2023, 5, 1))
    return search.filtered(listings, f).select("id", "source_code", "area_built_up", "area_land", "condition", "construction_type", "disposition")


@query("SELECT id FROM listings WHERE is_active AND lower(disposition) = '3+kk' AND condition IN ('Novostavba', 'Dobry stav')")
def search_disposition_condition(listings):
    return search.filtered(listings, search.ListingFilter(disposition="3+kK", conditions=["Novostavba", "Dobry stav"])).select("id")


@query("SELECT id FROM listings WHERE is_active AND construction_type IN ('Cihla', 'Panel') AND rooms >= 2 AND rooms <= 4")
def search_construction_rooms(listings):
    return search.filtered(listings, search.ListingFilter(constructions=["Cihla", "Panel"], rooms_min=2, rooms_max=4)).select("id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9\\x80-\\x{10FFFF}])the([^a-z0-9\\x80-\\x{10FFFF}]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9\\x80-\\x{10FFFF}])erth([^a-z0-9\\x80-\\x{10FFFF}]|$)')")
def fts_and_match(documents):
    return documents.filter(search.matches_text("The, ERTH", "text")).select("doc_id")


@query("SELECT id, price, first_seen_at FROM listings WHERE is_active ORDER BY first_seen_at DESC, price ASC NULLS LAST, id LIMIT 50")
def search_default_order(listings):
    return search.search(listings, search.ListingFilter())[0].select("id", "price", "first_seen_at")


@query("SELECT id FROM listings l WHERE is_active AND EXISTS (SELECT 1 FROM states s WHERE s.listing_id = l.id AND s.user_id = '3' AND s.status = 'Liked')")
def semi_user_status(listings, states):
    return search.filtered(listings, search.ListingFilter(user_status="Liked"), states, "3").select("id")


@query("SELECT id FROM listings l WHERE is_active AND NOT EXISTS (SELECT 1 FROM analyses a WHERE a.listing_id = l.id AND a.source = 'auto')")
def anti_no_analysis(listings, analyses):
    return selectors.without_auto_analysis(listings, analyses).select("id")


@query("SELECT id, latitude, longitude FROM listings WHERE is_active AND latitude >= 48.75 AND latitude <= 49.0 AND longitude >= 15.9 AND longitude <= 16.3")
def bbox_predicates(listings):
    return search.filtered(listings, search.ListingFilter(lat_min=48.75, lat_max=49.0, lon_min=15.9, lon_max=16.3)).select("id", "latitude", "longitude")


# --- projections and joins ------------------------------------------------------


@query("""WITH th AS (SELECT listing_id, arg_min(coalesce(stored_url, original_url), {'order_index': order_index, 'id': id}) AS thumbnail FROM photos GROUP BY listing_id),
st AS (SELECT listing_id, arg_max(status, last_updated) AS status, arg_max({'n': notes}, last_updated).n AS notes FROM states WHERE user_id = '5' GROUP BY listing_id)
SELECT l.id, th.thumbnail, coalesce(st.status, 'New') AS user_status, coalesce(length(trim(st.notes)) > 0, false) AS has_notes FROM listings l LEFT JOIN th ON th.listing_id = l.id LEFT JOIN st ON st.listing_id = l.id""")
def listing_summaries(listings, photos, states):
    return search.summaries(listings, photos, states, "5").select("id", "thumbnail", "user_status", "has_notes")


@query("SELECT l.id, coalesce(p.title, l.title) AS primary_title, coalesce(p.source_name, l.source_name) AS primary_source, coalesce(l.duplicate_of_listing_id, l.id) AS effective_id FROM listings l LEFT JOIN listings p ON p.id = l.duplicate_of_listing_id")
def duplicate_alias(listings, photos, states):
    return search.details(listings, photos, states).select("id", "primary_title", "primary_source", search.effective_id().alias("effective_id"))


@query("SELECT p.listing_id, count(*) AS photo_count, min(original_url) FILTER (WHERE order_index = 0) AS main_photo_url FROM photos p GROUP BY p.listing_id")
def view_child_count(photos):
    return search.photo_counts(photos)


@query("SELECT l.id, l.title, m.original_url AS main_photo_url FROM listings l LEFT JOIN photos m ON m.listing_id = l.id AND m.order_index = 0")
def left_first_child(listings, photos):
    return search.beside(listings, search.main_photo(photos)).select("id", "title", "main_photo_url")


@query("SELECT l.id, s.name FROM listings l JOIN sources s ON s.code = l.source_code")
def join_sources(listings, sources):
    return listings.join(sources.select(F.col("code").alias("source_code"), "name"), "source_code").select("id", "name")


@query("SELECT id, code, name, is_active FROM sources WHERE is_active ORDER BY name, code")
def sources_list(sources):
    return search.sources(sources, only_active=True)


@query("SELECT listing_id, string_agg(original_url, ',' ORDER BY order_index, id) AS urls FROM photos GROUP BY listing_id")
def nested_photos(photos):
    return search.nested_photos(photos).select("listing_id", F.array_join(F.transform("photos", lambda p: p["original_url"]), ",").alias("urls"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(left(text, 300), '…') ELSE text END AS excerpt FROM documents")
def excerpt(documents):
    return documents.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT listing_id, string_agg(concat('[', coalesce(title, 'Analýza'), ']: ', left(content, 600)), chr(10) ORDER BY k) AS snippets FROM
(SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, id) AS k FROM analyses) WHERE k <= 3 GROUP BY listing_id""")
def snippet_concat(analyses):
    return ranking.recent_snippets(analyses).select("listing_id", F.array_join("snippets", "\n").alias("snippets"))


# --- aggregates --------------------------------------------------------------------


@query("SELECT source_code, count(*) AS n, CAST(GROUPING(source_code) AS INTEGER) AS is_total FROM listings WHERE is_active GROUP BY ROLLUP (source_code)")
def active_by_source_rollup(listings):
    return stats.active_by_source(listings)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE latitude IS NOT NULL) AS geocoded, count(*) FILTER (WHERE latitude IS NULL) AS missing, count(*) FILTER (WHERE latitude IS NOT NULL AND geocode_source = 'scraper') AS by_scraper, count(*) FILTER (WHERE latitude IS NOT NULL AND geocode_source = 'nominatim') AS by_service FROM listings WHERE is_active")
def geocode_stats(listings):
    return stats.geocode_stats(listings)


@query("SELECT count(*) AS total, count(smart_tags) AS tagged, count(ai_normalized_data) AS normalized, count(price_signal) AS priced, count(*) FILTER (WHERE price_signal = 'low') AS low, count(*) FILTER (WHERE price_signal = 'fair') AS fair, count(*) FILTER (WHERE price_signal = 'high') AS high FROM listings WHERE is_active")
def conditional_counts(listings):
    return stats.feature_coverage(listings)


@query(f"""WITH o AS (SELECT source_code, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE NOT is_active) AS inactive, max(last_seen_at) AS last_seen_at FROM listings GROUP BY source_code),
h AS (SELECT code, coalesce(active, 0) AS active, coalesce(inactive, 0) AS inactive, last_seen_at, (epoch({NOW_SQL}) - epoch(last_seen_at)) / 86400 AS d FROM sources LEFT JOIN o ON o.source_code = code)
SELECT code, active, inactive, last_seen_at, round_even(d, 1) AS days_stale, CASE WHEN d IS NULL OR active = 0 THEN 'dead' WHEN d > 0 THEN 'stale' ELSE 'ok' END AS status FROM h""")
def source_health(sources, listings):
    return stats.source_health(sources, listings, NOW, stale_days=0)


@query(f"""WITH o AS (SELECT source_code, count(*) FILTER (WHERE is_active) AS active, max(last_seen_at) AS m FROM listings GROUP BY source_code),
h AS (SELECT CASE WHEN m IS NULL OR active = 0 THEN 'dead' WHEN (epoch({NOW_SQL}) - epoch(m)) / 86400 > 0 THEN 'stale' ELSE 'ok' END AS s FROM sources LEFT JOIN o ON o.source_code = code)
SELECT CASE WHEN count(*) FILTER (WHERE s <> 'ok') = 0 THEN 'ok' ELSE 'degraded' END AS overall, count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'stale') AS stale FROM h""")
def health_summary(sources, listings):
    return stats.health_summary(stats.source_health(sources, listings, NOW, stale_days=0))


@query("""SELECT s.id, s.code, s.name, s.is_active, r.runs, r.succeeded, r.failed, r.seen, r.added, r.updated, r.last_run, r.avg_seconds FROM sources s LEFT JOIN (SELECT source_id, count(*) AS runs, count(*) FILTER (WHERE status = 'Succeeded') AS succeeded, count(*) FILTER (WHERE status = 'Failed') AS failed,
CAST(sum(total_seen) AS BIGINT) AS seen, CAST(sum(total_new) AS BIGINT) AS added, CAST(sum(total_updated) AS BIGINT) AS updated, max(started_at) AS last_run, avg(epoch(finished_at) - epoch(started_at)) AS avg_seconds FROM runs GROUP BY source_id) r ON r.source_id = s.id""")
def run_stats_avg_duration(sources, runs):
    return stats.run_stats(sources, runs)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS part, round_even(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 1) AS pct FROM labels")
def pct_stats(labels):
    return stats.share(labels, F.col("toxic") == 1)


@query("SELECT count(*) AS total, count(embedding) AS with_embedding, count(*) - count(embedding) AS without_embedding, count(DISTINCT listing_id) AS listings FROM analyses")
def distinct_count(analyses):
    return stats.rag_status(analyses)


@query(f"SELECT source_code, count(*) AS n FROM listings WHERE first_seen_at >= {NOW_SQL} - INTERVAL '7' DAY GROUP BY source_code")
def new_last_7_days(listings):
    return stats.new_since(listings, NOW)


@query("""SELECT status, count(*) AS n, CASE status WHEN 'Liked' THEN 'Zajímavé' WHEN 'Disliked' THEN 'Nezajímavé' WHEN 'ToVisit' THEN 'K návštěvě' WHEN 'Visited' THEN 'Navštíveno' ELSE 'Nové' END AS label, string_agg(listing_id, ',' ORDER BY last_updated DESC, listing_id) AS ids FROM states WHERE user_id = '7' GROUP BY status""")
def group_with_nested_list(states):
    own = states.filter("user_id = '7'").select("status", "last_updated", F.col("listing_id").alias("title"), F.col("listing_id").alias("id"))
    return stats.my_listings(own).select("status", "n", "label", F.array_join(F.transform("items", lambda x: x["id"]), ",").alias("ids"))


@query("SELECT condition, count(*) AS n FROM listings GROUP BY condition")
def distribution(listings):
    return stats.distribution(listings, "condition")


@query("SELECT count(*) AS total, count(condition) AS condition, count(construction_type) AS construction, count(rooms) AS rooms, count(disposition) AS disposition FROM listings")
def fill_rates(listings):
    return stats.coverage(listings, **{n: F.col(c).isNotNull() for n, c in (("condition", "condition"), ("construction", "construction_type"), ("rooms", "rooms"), ("disposition", "disposition"))})


@query("""WITH h AS (SELECT listing_id, count(*) AS n, arg_min({'p': price}, {'r': recorded_at, 'p': price}).p AS f, arg_max({'p': price}, {'r': recorded_at, 'p': price}).p AS l FROM history GROUP BY listing_id)
SELECT listing_id, n, CASE WHEN n >= 2 AND f IS NOT NULL AND l IS NOT NULL THEN l - f ELSE 0 END AS trend, CASE WHEN n >= 2 AND f IS NOT NULL AND l IS NOT NULL AND f <> 0 THEN CAST(l - f AS DOUBLE) / CAST(f AS DOUBLE) * 100 ELSE 0.0 END AS trend_pct FROM h""")
def price_trend(history):
    return stats.price_trend(history).withColumn("trend_pct", F.when(F.col("trend_pct").isNotNull(), F.col("trend_pct"))).select("listing_id", "n", "trend", F.col("trend_pct").cast("double").alias("trend_pct"))


@query("SELECT count(*) AS n, min(length(text)) AS shortest, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean_floor, max(length(text)) AS longest FROM documents")
def length_stats(documents):
    return stats.length_stats(documents, "text")


@query("SELECT c.code, c.name, coalesce(n.n, 0) AS n FROM sources c LEFT JOIN (SELECT source_code, count(*) AS n FROM listings GROUP BY source_code) n ON n.source_code = c.code")
def counts_or_zero(sources, listings):
    return stats.counts_or_zero(sources, listings.groupBy("source_code").agg(F.count("*").alias("n"))).select("code", "name", "n")


@query("SELECT event_type AS test, count(*) FILTER (WHERE value > 1) / count(*) AS success_rate, avg(value) FILTER (WHERE value > 1) AS mean_s, stddev_samp(value) FILTER (WHERE value > 1) AS sd_s, avg(100 / value) FILTER (WHERE value > 1) AS tokens_per_s FROM events GROUP BY event_type")
def benchmark_summary(events):
    return stats.benchmark(events.select(F.col("event_type").alias("test"), (F.col("value") > 1).alias("ok"), F.col("value").alias("seconds"), F.when(F.col("value") > 0, 100 / F.col("value")).alias("tokens_per_s")))


@query("SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max FROM listings")
def map_bounds(listings):
    return spatial.map_bounds(listings)


# --- ordered picks --------------------------------------------------------------------


@query("SELECT listing_id, id, source FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, id) AS k FROM analyses WHERE source <> 'auto') WHERE k = 1")
def latest_per_key(analyses):
    return ranking.latest_analysis(analyses).select("listing_id", "id", "source")


@query("SELECT listing_id, id, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at DESC, price NULLS LAST) AS INTEGER) AS k, CAST(epoch(recorded_at) AS BIGINT) AS id FROM history) WHERE k <= 3")
def top3_per_key(history):
    return ranking.top(history, ["listing_id"], [F.col("recorded_at").desc(), F.col("price").asc_nulls_last()], 3, "k").select("listing_id", F.unix_timestamp("recorded_at").alias("id"), "k")


@query("""SELECT listing_id, id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY CASE WHEN lower(source) LIKE '%mistral-tools%' THEN 0 WHEN lower(source) LIKE '%mistral%' THEN 1 WHEN lower(source) LIKE '%claude%' THEN 2 ELSE 3 END, created_at DESC, id) AS k FROM analyses) WHERE k = 1""")
def priority_pick(analyses):
    return ranking.best_analysis(analyses).select("listing_id", "id")


@query("""SELECT listing_id, id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY CASE WHEN starts_with(source, 'local:mistral-tools/') THEN 0 WHEN starts_with(source, 'claude') THEN 1 WHEN starts_with(source, 'local:claude/') THEN 2 ELSE 3 END, created_at DESC, id) AS k FROM analyses) WHERE k = 1""")
def priority_pick_prefix(analyses):
    return ranking.best_analysis_by_prefix(analyses).select("listing_id", "id")


@query("SELECT listing_id, price, recorded_at, price - lag(price) OVER (PARTITION BY listing_id ORDER BY recorded_at, price NULLS FIRST) AS delta FROM history")
def price_delta(history):
    return ranking.price_deltas(history)


@query("""SELECT listing_id, price, recorded_at, old_price, CASE WHEN old_price <> 0 THEN round_even(CAST(price - old_price AS DOUBLE) / CAST(old_price AS DOUBLE) * 100, 0) + 0.0 END AS change_pct FROM
(SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY recorded_at, price) AS old_price FROM history WHERE price IS NOT NULL) WHERE old_price IS NULL OR old_price <> price""")
def change_log(history):
    own = ranking.price_log(history)
    return own.withColumn("change_pct", F.when(F.col("old_price") != 0, F.bround((F.col("price") - F.col("old_price")).cast("double") / F.col("old_price").cast("double") * 100, 0) + 0.0))


@query("""SELECT id, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY CASE photo_category WHEN 'exterior' THEN 1 WHEN 'land' THEN 2 WHEN 'kitchen' THEN 5 WHEN 'damage' THEN 12 ELSE 99 END, order_index, id) AS INTEGER) AS new_order FROM photos WHERE photo_category IS NOT NULL""")
def category_renumber(photos):
    return ranking.photos_by_category(photos).select("id", "new_order")


@query("SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS position, max(s_acctbal) OVER () AS max_score FROM supplier")
def rank_with_max(supplier):
    return ranking.ranked_with_best(supplier, "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal", "position", "max_score")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source")
def dedupe_first(documents):
    return ranking.deduplicated_first(documents, ["source"], "doc_id").select("doc_id", "source")


@query("""WITH e AS (SELECT * FROM photos WHERE order_index < 2), n AS (SELECT DISTINCT listing_id, original_url FROM photos WHERE order_index >= 1)
SELECT n.listing_id, n.original_url, CAST(row_number() OVER (PARTITION BY n.listing_id ORDER BY n.original_url) + coalesce((SELECT count(*) FROM e WHERE e.listing_id = n.listing_id), 0) AS BIGINT) AS position FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.listing_id = n.listing_id AND e.original_url = n.original_url)""")
def numbered_after(photos):
    tasks = tasks_for(photos)
    new = photos.filter("order_index >= 1").select("listing_id", "original_url").repartition(tasks, "listing_id", "original_url").distinct()
    return ranking.numbered_after(new, photos.filter("order_index < 2"), "listing_id", "original_url", tasks)


# --- text, numbers, JSON ------------------------------------------------------------------


@query("""SELECT id, coalesce(nullif(disposition, ''), nullif(upper(regexp_extract(concat_ws(' ', title, description), '(?i)([0-9]+\\+(?:[0-9]+|kk))', 1)), '')) AS disposition,
coalesce(condition, CASE WHEN regexp_matches(concat_ws(' ', title, description), '(?i)novostavb|pod klíč') THEN 'Novostavba' WHEN regexp_matches(concat_ws(' ', title, description), '(?i)po rekonstrukci') THEN 'Po rekonstrukci' WHEN regexp_matches(concat_ws(' ', title, description), '(?i)k rekonstrukci') THEN 'Před rekonstrukcí' WHEN regexp_matches(concat_ws(' ', title, description), '(?i)k demolici') THEN 'K demolici' END) AS condition,
coalesce(construction_type, CASE WHEN regexp_matches(concat_ws(' ', title, description), '(?i)cihla') THEN 'Cihla' END) AS construction_type FROM listings""")
def enrichment(listings):
    return ingest.enrich(listings).select("id", "disposition", "condition", "construction_type")


@query("SELECT id, TRY_CAST(nullif(regexp_replace(regexp_extract(description, '(?i)Cena\\s*:\\s*([0-9]+)', 1), '[^0-9]', '', 'g'), '') AS BIGINT) AS price, TRY_CAST(nullif(regexp_extract(description, '([0-9]{2,5})\\s*m2', 1), '') AS DOUBLE) AS area FROM listings")
def regex_numbers(listings):
    return listings.select("id", numbers.digits(numbers.first_group(F.col("description"), r"(?i)Cena\s*:\s*([0-9]+)")).cast("long").alias("price"), numbers.areas_inferred(F.col("title"), F.col("description"), F.lit("Dům"))[0].alias("area"))


@query("""SELECT id, CAST(price AS DOUBLE) / CASE WHEN area_built_up > 0 THEN area_built_up WHEN area_land > 0 THEN area_land END AS per_m2 FROM listings""")
def price_per_unit(listings):
    return listings.select("id", numbers.per_area(F.col("price").cast("double"), F.col("area_built_up"), F.col("area_land")).alias("per_m2"))


@query("""WITH c AS (SELECT id, price, CAST(price * 100 AS BIGINT) AS cents FROM listings), r AS (SELECT *, (cents + 5000000) // 10000000 AS tenths, (cents + 50000) // 100000 AS thousands FROM c)
SELECT id, CASE WHEN price IS NULL THEN 'neuvedena' WHEN price >= 1000000 THEN concat(tenths // 10, '.', tenths % 10, ' M') ELSE concat(thousands, ' k') END AS shown FROM r""")
def price_display_all(listings):
    return listings.select("id", numbers.price_display(F.col("price")).alias("shown"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'House' WHEN 'SMALL' THEN 'Land' ELSE 'Other' END AS kind FROM part")
def map_lookup_default(part):
    from ..model import lookup

    return part.select("p_partkey", lookup({"ECONOMY": "House", "SMALL": "Land"}, F.col("p_type"), F.lit("Other")).alias("kind"))


@query("SELECT event_id, CASE WHEN lower(event_type) IN ('new', 'liked', 'visited') THEN event_type ELSE 'New' END AS status FROM events")
def status_normalize(events):
    return events.select("event_id", text.normalize_status(F.col("event_type")).alias("status"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[;\\n"]') THEN concat('"', replace(text, '"', '""'), '"') ELSE text END AS field FROM documents""")
def csv_quote(documents):
    return documents.select("doc_id", text.csv_field(F.col("text")).alias("field"))


@query("""SELECT doc_id, left(trim(translate(text, '/\\:*?"<>|', '_________')), 100) AS name FROM documents""")
def sanitize(documents):
    return documents.select("doc_id", text.sanitize_name(F.col("text")).alias("name"))


@query("SELECT id, coalesce(lower(concat(coalesce(condition, ''), ' ', coalesce(description, ''))) LIKE '%novostavb%', false) AS is_new FROM listings")
def new_build_flag(listings):
    return listings.select("id", text.is_new_build(F.col("condition"), F.col("description")).alias("is_new"))


@query("""SELECT id, coalesce(CAST(price <= 7500000 AS INT), 0) + coalesce(CAST(area_built_up >= 100 AS INT), 0) + coalesce(CAST(rooms >= 4 AS INT), 0) + CAST(coalesce(municipality IN ('Town1', 'Town2'), false) OR coalesce(location_text ILIKE '%town1%' OR location_text ILIKE '%town2%', false) AS INT)
+ CASE WHEN ai_normalized_data LIKE '%"has_garden": true%' THEN 1 ELSE 0 END AS score FROM listings""")
def target_score(listings):
    return listings.select("id", selectors.target_score(["Town1", "Town2"]).alias("score"))


@query("SELECT id, ai_normalized_data LIKE '%\"has_garden\": true%' AND ai_normalized_data IS NOT NULL AS garden FROM listings")
def json_flag(listings):
    return listings.select("id", jsons.is_true(F.col("ai_normalized_data"), "has_garden").alias("garden"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k FROM events")
def json_key(events):
    return events.select("event_id", jsons.first_key(F.col("props"), "kod", "k").cast("int").alias("k"))


@query("SELECT id, CASE WHEN smart_tags IS NOT NULL THEN 'garden,well,view,garage,attic' END AS tags FROM listings")
def json_tags(listings):
    return listings.select("id", F.array_join(jsons.tags(F.col("smart_tags")), ",").alias("tags"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accents_stripped_all(documents):
    return documents.select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query()
def topic_scores(documents):
    return documents.select("doc_id", text.topic_score(F.col("text")).alias("score"))


@query("SELECT id, regexp_extract(url, '-([0-9]+)$', 1) AS ext FROM listings")
def external_ids(listings):
    return listings.select("id", text.external_id(F.col("url")).alias("ext"))


@query("SELECT id, trim(string_split(location_text, ',')[CASE WHEN regexp_matches(trim(string_split(location_text, ',')[1]), '\\s+[0-9]+$') THEN 2 ELSE 1 END]) AS city FROM listings")
def city_of_location(listings):
    return listings.select("id", text.city(F.col("location_text")).alias("city"))


@query("""WITH r AS (SELECT conv_id, string_agg(concat(chr(10), '### Analýza [', CAST(k AS STRING), ']', chr(10), text), chr(10) ORDER BY k) AS body FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id)
SELECT conv_id, concat('## Uložené analýzy (kontext)', chr(10), body, chr(10), chr(10), '## Dotaz', chr(10), 'Proč?') AS prompt FROM r""")
def rag_chunks(conversations):
    own = conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return own.select("conv_id", rag.prompt(F.lit("Proč?"), F.lit(None).cast("string"), F.col("parts")).alias("prompt"))


# --- vectors and places ------------------------------------------------------------------------

PROBE = [((i * 37) % 19 - 9) / 30 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in PROBE) + "]"


@query(f"SELECT vec_id, round(d, 6) AS distance, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {PROBE_SQL}), 6) AS similarity FROM (SELECT *, list_distance(CAST(embedding AS DOUBLE[]), {PROBE_SQL}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def l2_topk(embeddings):
    return rag.similar(embeddings, PROBE, 10, vector_column="embedding", tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {PROBE_SQL}), 6) AS distance FROM embeddings WHERE label % 2 = 0 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {PROBE_SQL}), vec_id LIMIT 10")
def hybrid_topk(embeddings):
    return rag.similar(embeddings, PROBE, 10, None, F.col("label") % 2 == 0, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {PROBE_SQL}), 6) AS similarity FROM embeddings")
def cosine_score(embeddings):
    q = F.array(*(F.lit(x) for x in PROBE))
    return embeddings.select("vec_id", F.round(vector.cosine(F.col("embedding"), q), 6).alias("similarity"))


@query("""SELECT query_id, item_id, CAST(position AS INTEGER) AS position FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), e.vec_id) AS position
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE position <= 5""")
def nearest_to_each(embeddings):
    qs = embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rag.similar_to_each(qs, embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5).select("query_id", "item_id", "position")


SQUARE = "POLYGON((15.9 48.75, 16.4 48.75, 16.4 49.05, 16.1 48.9, 15.9 49.05, 15.9 48.75), (16.2 48.8, 16.3 48.8, 16.3 48.85, 16.2 48.85, 16.2 48.8))"


@query("""WITH e AS (SELECT * FROM (VALUES (0, 15.9, 48.75, 16.4, 48.75), (0, 16.4, 48.75, 16.4, 49.05), (0, 16.4, 49.05, 16.1, 48.9), (0, 16.1, 48.9, 15.9, 49.05), (0, 15.9, 49.05, 15.9, 48.75), (1, 16.2, 48.8, 16.3, 48.8), (1, 16.3, 48.8, 16.3, 48.85), (1, 16.3, 48.85, 16.2, 48.85), (1, 16.2, 48.85, 16.2, 48.8)) t(ring, x1, y1, x2, y2)),
c AS (SELECT id, ring, count(*) FILTER (WHERE (y2 > latitude) <> (y1 > latitude) AND longitude < x2 + (latitude - y2) * (x1 - x2) / nullif(y1 - y2, 0)) % 2 = 1 OR bool_or((x1 - x2) * (latitude - y2) = (y1 - y2) * (longitude - x2) AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2)) AS inside
FROM listings, (SELECT ring, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1, CAST(x2 AS DOUBLE) x2, CAST(y2 AS DOUBLE) y2 FROM e) WHERE latitude IS NOT NULL GROUP BY id, ring)
SELECT id FROM c GROUP BY id HAVING count(*) FILTER (WHERE inside) % 2 = 1""")
def point_in_polygon(listings):
    return spatial.in_area(listings, SQUARE).select("id")


@query("SELECT id FROM listings WHERE latitude BETWEEN 48.8 AND 48.95 AND longitude BETWEEN 16.0 AND 16.2 AND property_type = 'House' AND price >= 1000000")
def bbox_filter(listings):
    return spatial.in_box(listings, (48.8, 48.95, 16.0, 16.2)).filter(spatial.extra_filters("House", None, 1_000_000)).select("id")


@query("""SELECT l.id, l.latitude, l.longitude, m.original_url AS main_photo_url FROM (SELECT * FROM listings WHERE is_active AND latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY id LIMIT 2000) l LEFT JOIN photos m ON m.listing_id = l.id AND m.order_index = 0""")
def map_points(listings, photos):
    return spatial.map_points(listings, search.main_photo(photos)).select("id", "latitude", "longitude", "main_photo_url")


@query("""WITH a AS (SELECT * FROM (VALUES ('west', 15.8, 16.1), ('east', 16.1001, 16.7), ('none', 10.0, 10.5)) t(area_id, x1, x2))
SELECT area_id, count(*) AS n FROM a JOIN listings ON longitude BETWEEN x1 AND x2 AND latitude BETWEEN 48.7 AND 49.0 GROUP BY area_id""")
def areas_count(listings):
    box = "POLYGON(({0} 48.7, {1} 48.7, {1} 49.0, {0} 49.0, {0} 48.7))"
    areas = listings.sparkSession.createDataFrame([(n, box.format(a, b)) for n, a, b in (("west", 15.8, 16.1), ("east", 16.1001, 16.7), ("none", 10.0, 10.5))], "area_id string, wkt string")
    return spatial.areas_join(listings.select("id", "latitude", "longitude"), areas).groupBy("area_id").agg(F.count("*").alias("n"))


ROUTES = [("znojmo-brno", "LINESTRING(16.05 48.85, 16.35 48.98, 16.6 49.19)", 6000.0), ("short", "LINESTRING(15.9 48.9, 15.95 48.9)", 2000.0)]


@query()
def corridor_count(listings):
    return spatial.corridor_counts(listings, listings.sparkSession.createDataFrame(ROUTES, "area_id string, wkt string, radius double"))


@query()
def corridor_polygons(listings):
    return spatial.build_corridors(listings.sparkSession.createDataFrame(ROUTES, "area_id string, wkt string, radius double"), listings)


@query()
def projected_points(listings):
    own = listings.filter("latitude IS NOT NULL").select("id", krovak.to_plane(F.col("latitude"), F.col("longitude")).alias("q"))
    return own.select("id", F.round("q.x", 3).alias("east"), F.round("q.y", 3).alias("north"))


@query("SELECT id, concat('LINESTRING(', regexp_replace(CAST(longitude AS STRING), '\\.0$', ''), ' ', regexp_replace(CAST(latitude AS STRING), '\\.0$', ''), ', 16.5 49.25)') AS wkt FROM listings WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def straight_line_all(listings):
    return listings.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("id", geo.straight_line(F.col("latitude"), F.col("longitude"), F.lit(49.25), F.lit(16.5)).alias("wkt"))


# --- ingest -------------------------------------------------------------------------------------


@query(f"""WITH {OBSERVED_SQL} SELECT coalesce(l.id, o.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.price ELSE l.price END AS price, coalesce(o.rooms, l.rooms) AS rooms, coalesce(o.latitude, l.latitude) AS latitude, coalesce(l.first_seen_at, o.first_seen_at) AS first_seen_at, o.id IS NOT NULL OR l.is_active AS is_active
FROM listings l FULL JOIN o ON o.source_id = l.source_id AND o.external_id = l.external_id""")
def upsert_merge(listings):
    return ingest.upsert(listings, observed(listings)).select("id", "price", "rooms", "latitude", "first_seen_at", "is_active")


@query(f"""WITH {OBSERVED_SQL} SELECT coalesce(l.id, o.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.price ELSE l.price END AS price, coalesce(o.rooms, l.rooms) AS rooms FROM listings l FULL JOIN o ON o.source_id = l.source_id AND o.external_id = l.external_id""")
def upsert_idempotent(listings):
    once = ingest.upsert(listings, observed(listings))
    return ingest.upsert(once, observed(listings)).select("id", "price", "rooms")


@query(f"""WITH {OBSERVED_SQL} SELECT coalesce(l.id, o.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.rooms ELSE l.rooms END AS rooms, CASE WHEN o.id IS NOT NULL THEN o.latitude ELSE l.latitude END AS latitude FROM listings l FULL JOIN o ON o.source_id = l.source_id AND o.external_id = l.external_id""")
def upsert_replace(listings):
    return ingest.upsert(listings, observed(listings), mode="replace").select("id", "rooms", "latitude")


@query(f"""WITH {OBSERVED_SQL} SELECT coalesce(l.id, o.id) AS listing_id, o.price, l.price AS old_price FROM o LEFT JOIN listings l ON o.source_id = l.source_id AND o.external_id = l.external_id WHERE o.price IS NOT NULL AND (l.price IS NULL OR l.price <> o.price)""")
def history_append(listings):
    return ingest.price_changes(listings, observed(listings), NOW).select("listing_id", "price", "old_price")


@query("SELECT id AS listing_id, price FROM listings l WHERE price IS NOT NULL AND NOT EXISTS (SELECT 1 FROM history h WHERE h.listing_id = l.id AND CAST(h.listing_id AS INT) % 4 <> 1)")
def history_backfill(listings, history):
    """A quarter of the listings has lost its history."""
    kept = history.filter("CAST(listing_id AS INT) % 4 <> 1")
    return ingest.first_history(listings, kept).select("listing_id", "price")


@query("""WITH old AS (SELECT * FROM photos WHERE CAST(listing_id AS INT) % 2 = 0), u AS (SELECT listing_id, original_url, max(i) - 1 AS idx FROM (SELECT listing_id, unnest(us) AS original_url, unnest(range(1, len(us) + 1)) AS i FROM (SELECT listing_id, list_slice(list(original_url ORDER BY original_url), 1, 50) AS us FROM (SELECT DISTINCT listing_id, original_url FROM photos WHERE order_index <> 2) GROUP BY listing_id)) GROUP BY listing_id, original_url)
SELECT coalesce(o.listing_id, u.listing_id) AS listing_id, coalesce(o.original_url, u.original_url) AS original_url, CASE WHEN o.id IS NULL THEN 'insert' WHEN u.idx IS NULL AND classified_at IS NULL THEN 'delete' WHEN u.idx IS NULL THEN 'keep' WHEN order_index <> idx AND stored_url IS NULL THEN 'reorder+retry' WHEN order_index <> idx THEN 'reorder' WHEN stored_url IS NULL THEN 'retry' ELSE 'keep' END AS action
FROM (SELECT * FROM old WHERE listing_id IN (SELECT listing_id FROM u)) o FULL JOIN u ON o.listing_id = u.listing_id AND o.original_url = u.original_url""")
def photo_sync_actions(photos):
    old = photos.filter(F.col("listing_id").cast("int") % 2 == 0)
    tasks = tasks_for(photos)
    new = photos.filter("order_index <> 2").select("listing_id", "original_url").repartition(tasks, "listing_id").groupBy("listing_id").agg(F.array_sort(F.collect_set("original_url")).alias("photos"))
    return ingest.photo_actions(old, new, tasks).select("listing_id", "original_url", "action")


@query(f"SELECT id, CASE WHEN source_code = 'src2' AND last_seen_at < {NOW_SQL} - INTERVAL '5' DAY THEN false ELSE is_active END AS is_active FROM listings")
def deactivate_unseen(listings):
    return ingest.deactivate_unseen(listings, "src2", datetime(2024, 1, 27), True, 10).select("id", "is_active")


@query("SELECT id, reason FROM (SELECT id, CASE WHEN coalesce(price, 0) = 0 THEN 'Missing price' WHEN length(coalesce(description, '')) < 30 THEN 'Description too short (min 30 chars)' WHEN property_type = 'House' AND offer_type NOT IN ('Sale') THEN concat('Offer type ', offer_type, ' not in houses filter') WHEN property_type = 'Land' THEN 'Land disabled' END AS reason FROM listings)")
def admission_reasons(listings):
    rules = ingest.Admission(require_price=True, require_description=True, min_description_length=30, rules=[ingest.TypeRule("House", "houses", offer_types=["Sale"]), ingest.TypeRule("Land", "land", enabled=False)])
    return listings.withColumn("photos", F.array(F.lit("x"))).withColumn("reason", ingest.reject_reason(rules)).select("id", "reason")


@query(f"SELECT id, url FROM listings WHERE is_active AND last_seen_at < {NOW_SQL} - INTERVAL '6' DAY AND coalesce(url, '') <> ''")
def stale_candidates(listings):
    return selectors.stale(listings, NOW, 6).select("id", "url")


@query("SELECT id FROM listings WHERE is_active AND smart_tags IS NULL AND length(description) > 50 ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 50")
def missing_tags(listings):
    return selectors.needs_tags(listings, 500).select("id")


@query("SELECT id FROM photos p WHERE stored_url IS NULL AND EXISTS (SELECT 1 FROM states s WHERE s.listing_id = p.listing_id AND s.status IN ('Liked', 'ToVisit', 'Visited')) ORDER BY listing_id, order_index, id LIMIT 100")
def photos_to_store(photos, states):
    return selectors.not_stored(photos, 100, states).select("id")


@query("SELECT id FROM listings WHERE is_active AND latitude IS NULL AND coalesce(location_text, '') <> '' ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 40")
def to_geocode(listings):
    return selectors.without_location(listings, 40).select("id")


@query("SELECT user_id, listing_id, arg_max(status, {'t': last_updated, 's': status}) AS status FROM states GROUP BY user_id, listing_id")
def state_latest_wins(states):
    old, new = states.filter("user_id < '5'"), states.filter("user_id >= '5'")
    own = ingest.latest_wins(old.select("user_id", "listing_id", "last_updated", "status"), new.select("user_id", "listing_id", "last_updated", "status"), ["user_id", "listing_id"], "last_updated")
    return own.select("user_id", "listing_id", "status")


@query("SELECT o_custkey AS job_id, count(*) AS n, arg_max(o_orderstatus, {'t': o_orderdate, 's': o_orderstatus}) AS status, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey")
def job_fold(orders):
    ev = orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("progress"), F.lit(None).cast("string").alias("error_message"))
    return ingest.job_states(ev).join(ev.groupBy("job_id").agg(F.count("*").alias("n")), "job_id").select("job_id", "n", "status", "created_at")


@query("SELECT CAST(o_custkey AS STRING) AS job_id FROM (SELECT o_custkey, min(o_orderdate) AS c FROM orders GROUP BY o_custkey) ORDER BY c DESC, o_custkey LIMIT 25")
def jobs_newest(orders):
    own = orders.groupBy(F.col("o_custkey").alias("job_id")).agg(F.min("o_orderdate").alias("created_at"), F.lit("x").alias("status"))
    return ingest.jobs_listed(own, limit=25).select(F.col("job_id").cast("string").alias("job_id"))


# --- pages, exports, datasets, files -----------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) <> '' AS has_title FROM pages")
def html_title(pages):
    own = html.parsed(pages)
    return own.select("page_id", (F.coalesce(html.first_text(html.of_tag(F.col("elements"), "title")), F.lit("")) != "").alias("has_title"))


@query()
def html_links(pages):
    own = html.parsed(pages).select("page_id", F.explode(html.links(F.col("elements"), "http://example.com", "^/([^/?#]+)$")).alias("x"))
    return own.select("page_id", "x.external_id", "x.url", "x.title")


@query()
def html_description(pages):
    return html.parsed(pages).select("page_id", html.description(F.col("elements")).alias("description"), F.size(html.images(F.col("elements"), "http://example.com")).alias("images"))


@query("""SELECT id, concat_ws(';', id, source_name, title, CASE property_type WHEN 'House' THEN 'Dům' WHEN 'Apartment' THEN 'Byt' WHEN 'Land' THEN 'Pozemek' WHEN 'Cottage' THEN 'Chata/chalupa' WHEN 'Commercial' THEN 'Komercí' WHEN 'Garage' THEN 'Garáž' END, CASE offer_type WHEN 'Sale' THEN 'Prodej' ELSE 'Pronájem' END, coalesce(disposition, ''), coalesce(printf('%.0f', CAST(price AS DOUBLE)), ''), coalesce(printf('%.0f', area_built_up), ''), coalesce(printf('%.0f', area_land), ''), location_text, coalesce(region, ''), coalesce(district, ''), coalesce(municipality, ''), strftime(first_seen_at, '%Y-%m-%d'), 'Nové') AS line FROM listings""")
def csv_export(listings):
    return export.csv_lines(listings.withColumn("user_status", F.lit("New")), limit=None)


@query("SELECT id, title FROM listings WHERE region LIKE '%gion1%' AND price <= 5000000 AND is_active ORDER BY first_seen_at DESC, id LIMIT 30")
def export_batch(listings):
    return export.batch(listings, "gion1", 5_000_000, True, 30).select("id", "title")


@query()
def export_json(listings, photos):
    return export.data_json(search.beside(listings, search.nested_photos(photos)))


@query()
def export_markdown(listings, photos):
    return search.beside(listings, search.nested_photos(photos)).select("id", export.info_markdown("01.02.2024").alias("markdown"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(left(text, 5)) = '' THEN 'empty_instruction' WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 3000 THEN 'too_long' ELSE 'ok' END AS reason FROM documents) GROUP BY reason")
def dataset_reasons(documents):
    return dataset.reason_counts(documents.select(F.left("text", F.lit(5)).alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output")), shortest=100, longest=3000)


@query()
def dataset_shuffled(documents):
    return dataset.shuffled(documents.select("doc_id", "lang"))


@query("SELECT CAST(doc_id AS STRING) AS path FROM documents WHERE strpos(lower(text), 'thand') > 0 ORDER BY path LIMIT 50")
def file_search(documents):
    return files.search_files(documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), content="Thand").select("path")


# --- time windows and extensions ------------------------------------------------------------------------


@query("SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n, greatest(0, count(*) - 1) AS rejected FROM events GROUP BY user_id, date_trunc('minute', ts)")
def limiter_windows(events):
    return streams.over_limit(events, "user_id", 1)


@query("SELECT user_id, max(ts) AS last_seen_at, count(*) AS n FROM events GROUP BY user_id")
def last_seen(events):
    return streams.last_seen(events, "user_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '3' HOUR THEN 0 ELSE 1 END AS cut FROM events), k AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '3' HOUR AS session_end, count(*) AS n FROM k GROUP BY user_id, s""")
def ext_sessions(events):
    return streams.sessions(events, "user_id", "3 hours")


@query("""SELECT e.event_id, (SELECT h.price FROM history h WHERE h.listing_id = CAST(e.event_id % 2000 AS STRING) AND h.recorded_at <= e.ts - INTERVAL '8000' DAY ORDER BY h.recorded_at DESC LIMIT 1) AS price FROM events e""")
def ext_asof_price(events, history):
    from ..operators.extensions import asof_join

    left = events.select("event_id", F.concat(F.lit(""), (F.col("event_id") % 2000).cast("string")).alias("listing_id"), (F.col("ts") - F.expr("INTERVAL '8000' DAY")).alias("at"))
    return asof_join(left, history.select("listing_id", F.col("recorded_at").alias("at"), "price"), ["listing_id"], "at", ["price"]).select("event_id", "price")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(customer, supplier):
    return customer.select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey"))


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def ext_except_all_suppliers(customer, supplier):
    """Customers' nation keys less one for each supplier's."""
    rest = customer.select(F.col("c_nationkey").alias("k")).exceptAll(supplier.select("s_nationkey"))
    return rest.groupBy("k").agg(F.count("*").alias("n"))


# --- lookups, work lists and state changes --------------------------------------------------------------


@query("SELECT id, title FROM listings WHERE id = '7'")
def listing_by_id(listings):
    return search.by_id(listings, "7").select("id", "title")


@query("SELECT id, title FROM listings WHERE source_id = '3' AND external_id = '8'")
def listing_by_key(listings):
    return search.by_natural_key(listings, "3", "8").select("id", "title")


@query("SELECT id FROM listings WHERE is_active AND source_id = '2'")
def active_of_source(listings):
    return search.active(listings, "2").select("id")


@query("""SELECT count(*) AS total, count(c.listing_id) AS with_row, count(*) FILTER (WHERE fetch_status = 'found') AS found, count(*) FILTER (WHERE fetch_status = 'not_found') AS not_found, count(*) FILTER (WHERE fetch_status = 'error') AS error,
count(*) FILTER (WHERE fetch_status = 'pending') AS pending FROM listings l LEFT JOIN cadastre c ON c.listing_id = l.id WHERE l.is_active""")
def cadastre_counts(listings, cadastre):
    return stats.cadastre_stats(listings, cadastre)


@query("SELECT id FROM listings l WHERE is_active AND NOT EXISTS (SELECT 1 FROM cadastre c WHERE c.listing_id = l.id AND fetch_status IN ('found', 'manual', 'not_found')) ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 40")
def without_cadastre(listings, cadastre):
    return selectors.without_cadastre(listings, cadastre, 40).select("id")


@query("SELECT id FROM listings l WHERE is_active AND NOT EXISTS (SELECT 1 FROM cadastre c WHERE c.listing_id = l.id AND fetch_status NOT IN ('pending', 'error', 'not_found')) ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 60")
def without_cadastre_again(listings, cadastre):
    return selectors.without_cadastre_batch(listings, cadastre, 60, again=True).select("id")


@query("SELECT id FROM photos WHERE classified_at IS NULL AND coalesce(stored_url, original_url) IS NOT NULL ORDER BY listing_id, order_index, id LIMIT 30")
def unclassified_photos(photos):
    return selectors.unclassified(photos, 30).select("id")


@query("SELECT count(*) AS total, count(classified_at) AS classified, count(stored_url) AS stored FROM photos")
def classification_coverage(photos):
    return stats.coverage(photos, classified=F.col("classified_at").isNotNull(), stored=F.col("stored_url").isNotNull())


@query("SELECT count(*) AS n, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_fetch, round(avg(value * 2), 6) AS avg_parse, round(avg(value + 1), 6) AS avg_save FROM events")
def scan_call_metrics(events):
    v = F.col("value")
    own = stats.scan_metrics(events.select((v > 50).alias("ok"), v.alias("fetch"), (v * 2).alias("parse"), (v + 1).alias("save")))
    return own.select("n", *(F.round(c, 6).alias(c) for c in own.columns[1:]))


@query("SELECT string_agg(concat(event_type, '=', n), ',' ORDER BY event_type) AS counts FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def counts_by_status(events):
    own = stats.status_counts(events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n")))
    return own.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""WITH r AS (SELECT s.code, CASE WHEN n.n IS NULL THEN NULL WHEN n.n < 100 THEN 0 ELSE n.n END AS found FROM sources s LEFT JOIN (SELECT source_code, count(*) AS n FROM listings WHERE price > 5000000 GROUP BY source_code) n ON n.source_code = s.code)
SELECT coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE found IS NULL), '') AS failed, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE found = 0), '') AS empty, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE found > 0), '') AS ok, CAST(coalesce(sum(found), 0) AS BIGINT) AS total FROM r""")
def scan_job_summary(sources, listings):
    n = listings.filter("price > 5000000").groupBy(F.col("source_code").alias("code")).agg(F.count("*").alias("n"))
    own = sources.join(n, "code", "left").select(F.col("code").alias("source_code"), F.when(F.col("n") < 100, 0).otherwise(F.col("n")).alias("found"))
    return stats.job_summary(own).select(*(F.array_join(c, ",").alias(c) for c in ("failed", "empty", "ok")), "total")


@query("SELECT count(*) AS processed, count(*) FILTER (WHERE value > 50) AS succeeded, count(*) FILTER (WHERE NOT value > 50) AS failed, 12 AS remaining, round(avg(value), 6) AS avg_ms FROM events")
def batch_job_summary(events):
    return stats.batch_summary(events.select((F.col("value") > 50).alias("ok"), F.col("value").alias("ms")), 12).withColumn("avg_ms", F.round("avg_ms", 6))


@query("""WITH a AS (SELECT event_type AS t, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS r, avg(value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type AS t, avg(value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY event_type)
SELECT count(*) AS tests, round(sum(a.m) FILTER (WHERE r > 0), 6) AS a_total, round(sum(b.m) FILTER (WHERE r > 0), 6) AS b_total, round(sum(a.m * 2) FILTER (WHERE r > 0) / count(*), 6) AS a_tokens, round(sum(b.m * 2) FILTER (WHERE r > 0) / count(*), 6) AS b_tokens FROM a JOIN b USING (t)""")
def benchmark_pairs(events):
    def runs(rest: int) -> DataFrame:
        own = events.filter(F.col("event_id") % 2 == rest).groupBy(F.col("event_type").alias("test")).agg(F.avg("value").alias("mean_s"))
        return own.select("test", F.when(F.col("test") == "error", 0.0).otherwise(1.0).alias("success_rate"), "mean_s", (F.col("mean_s") * 2).alias("tokens_per_s"))

    own = stats.benchmark_compare(runs(0), runs(1))
    return own.select("tests", *(F.round(c, 6).alias(c) for c in own.columns[1:]))


@query("SELECT count(*) FILTER (WHERE s_nationkey < 10) AS folders, count(*) FILTER (WHERE s_nationkey >= 10) AS files FROM supplier")
def folder_counts(supplier):
    return files.folder_counts(supplier.select((F.col("s_nationkey") < 10).alias("is_dir")))


@query("SELECT name FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' ANALysis.md') WHEN 1 THEN concat(p_name, ' ana l.md') ELSE p_name END AS name FROM part) WHERE lower(name) LIKE '%anal%'")
def analysis_files(part):
    n = F.col("p_partkey") % 3
    return files.analysis_files(part.select(F.when(n == 0, F.concat("p_name", F.lit(" ANALysis.md"))).when(n == 1, F.concat("p_name", F.lit(" ana l.md"))).otherwise(F.col("p_name")).alias("name")))


@query("SELECT id, CASE WHEN CAST(id AS INT) % 9 = 0 AND source_code <> 'src4' THEN false ELSE is_active END AS is_active FROM listings")
def deactivate_sold(listings):
    sold = listings.filter("CAST(id AS INT) % 9 = 0").select(F.when(F.col("source_code") == "src4", "other").otherwise(F.col("source_code")).alias("source_code"), "external_id")
    return ingest.deactivate_keys(listings, sold).select("id", "is_active")


@query(f"""WITH c AS (SELECT *, CASE CAST(id AS INT) % 4 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 503 END AS code, is_active AND last_seen_at < {NOW_SQL} - INTERVAL '6' DAY AND coalesce(url, '') <> '' AS stale FROM listings)
SELECT id, CASE WHEN stale AND code = 404 THEN false ELSE is_active END AS is_active, CASE WHEN stale AND (code = 404 OR code < 400) THEN {NOW_SQL} ELSE last_seen_at END AS last_seen_at FROM c""")
def deactivate_dead(listings):
    n = F.col("id").cast("int") % 4
    answers = listings.select("url", F.when(n == 0, 404).when(n == 1, 200).when(n == 2, 503).alias("http_status")).filter("http_status IS NOT NULL")
    return ingest.deactivate_dead(listings, answers, NOW, 6).select("id", "is_active", "last_seen_at")


@query("SELECT id FROM photos WHERE order_index <> 2")
def purge_photos(photos):
    answers = photos.select(F.col("original_url").alias("url"), F.when(F.col("order_index") == 2, 404).when(F.col("order_index") == 1, 503).otherwise(200).alias("http_status"))
    gone = answers.filter("http_status = 404").select("url").distinct()
    # Addresses of the other photos answer otherwise.
    return ingest.purge_photos(photos, answers.join(gone, "url", "left_anti").unionByName(answers.filter("http_status = 404"))).select("id")


@query("""SELECT id, CASE CAST(id AS INT) % 8 WHEN 0 THEN 'low' WHEN 4 THEN NULL ELSE price_signal END AS price_signal, CASE CAST(id AS INT) % 8 WHEN 0 THEN concat('why ', id) WHEN 4 THEN NULL ELSE price_signal_reason END AS price_signal_reason FROM listings""")
def signals_recomputed(listings):
    n = F.col("id").cast("int")
    answers = listings.filter(n % 4 == 0).select(F.col("id").alias("listing_id"), F.when(n % 8 == 0, " LOW ").otherwise("cheap").alias("signal"), F.concat(F.lit("why "), "id").alias("reason"))
    return ingest.recomputed_signals(listings, answers).select("id", "price_signal", "price_signal_reason")


@query("""SELECT id, disposition, coalesce(rooms, TRY_CAST(nullif(regexp_extract(disposition, '^([0-9]+)', 1), '') AS INTEGER)) AS rooms FROM (SELECT id, rooms, coalesce(disposition, nullif(upper(regexp_extract(title, '(?i)([0-9]+\\+(?:[0-9]+|kk))', 1)), ''),
nullif(upper(regexp_extract(description, '(?i)([0-9]+\\+(?:[0-9]+|kk))', 1)), '')) AS disposition FROM listings)""")
def disposition_backfill(listings):
    return ingest.backfill_disposition(listings).select("id", "disposition", "rooms")


@query("SELECT id, original_url FROM photos WHERE order_index < 2 UNION ALL SELECT id, original_url FROM photos p WHERE NOT EXISTS (SELECT 1 FROM photos o WHERE o.order_index < 2 AND o.original_url = p.original_url AND o.listing_id = p.listing_id)")
def photos_appended_once(photos):
    return ingest.appended_once(photos.filter("order_index < 2"), photos, ["listing_id", "original_url"]).select("id", "original_url")


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Succeeded' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 100 ELSE 1 END AS progress FROM orders")
def job_updates(orders):
    old = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("progress"))
    new = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("Succeeded").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, 100).alias("progress"))
    return ingest.completed(old, new, "job_id", ["status", "progress"])


@query("SELECT listing_id, order_index, coalesce(photo_category, 'other') AS category FROM photos")
def photo_descriptions_merged(photos):
    own = photos.select("listing_id", "order_index", F.col("photo_category").alias("category"))
    return ranking.merged_descriptions(own.filter("order_index < 2"), own.filter("order_index >= 2"))


@query("SELECT doc_id, CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) < 429496729 AS held_out FROM documents")
def dataset_split(documents):
    """Every row in one of the parts."""
    train, held = dataset.split(documents.select("doc_id"), 0.1)
    return train.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))


@query("""SELECT trim(text) AS instruction, '' AS input, concat('A', conv_id) AS output FROM conversations WHERE turn = 0""")
def dataset_normalized(conversations):
    lines = conversations.filter("turn = 0").select(F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.lit("A"), F.col("conv_id").cast("string")).alias("answer"))).alias("value"))
    broken = lines.select(F.lit("{broken").alias("value")).limit(1)
    return dataset.normalized(dataset.read_jsonl(lines.unionByName(broken)))


SORTED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS mode, {str(down).lower()} AS descending, CAST(n AS INTEGER) AS position, id FROM (SELECT id, row_number() OVER (ORDER BY {column} {'DESC' if down else 'ASC'} NULLS LAST, id) AS n FROM listings) WHERE n BETWEEN 6 AND 10"
    for name, column in sorted(search.SORTS.items())
    for down in (False, True)
)


@query(SORTED_SQL)
def search_sort_modes(listings):
    """The second page of five under every sort mode, both ways."""
    out = None
    for name in sorted(search.SORTS):
        for down in (False, True):
            order = search.ordering(name.upper(), down)
            own = search.page(listings, order, 2, 5).withColumn("position", (F.row_number().over(Window.partitionBy().orderBy(*order)) + 5).cast("int"))
            own = own.select(F.lit(name).alias("mode"), F.lit(down).alias("descending"), "position", "id")
            out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT id, CASE WHEN NOT (strpos(hay, 'district2') > 0 OR strpos(hay, 'town7') > 0 OR strpos(hay, 'region1') > 0) THEN concat('District not in target list: ', location_text) WHEN property_type = 'Garage' AND price > 4500000 THEN concat('Price ', CAST(price AS VARCHAR), ' exceeds max 4.5e+06') WHEN property_type = 'Garage' AND price <> 0 AND price < 3800000 THEN concat('Price ', CAST(price AS VARCHAR), ' below min 3.8e+06') END AS reason
FROM (SELECT *, lower(concat_ws(' ', location_text, district, municipality, CASE WHEN CAST(id AS INT) % 2 = 0 THEN region END)) AS hay FROM listings)""")
def admission_districts(listings):
    """Target districts in any of the four place columns, then prices of one kind."""
    rules = ingest.Admission(target_districts=["District2", "TOWN7", "Region1"], rules=[ingest.TypeRule("Garage", "garages", min_price=3_800_000, max_price=4_500_000)])
    own = listings.withColumns({"photos": F.array(F.lit("x")), "region": F.when(F.col("id").cast("int") % 2 == 0, F.col("region"))})
    return own.withColumn("reason", ingest.reject_reason(rules)).select("id", "reason")
