"""Listing-shaped views over the driver tables, one SQL text for Spark and DuckDB.

Listings stand on ``part``, photos and price history on ``lineitem``, user states on ``events``, analyses on
``documents``, scan runs on ``orders``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..shared import dealt

NOW = "TIMESTAMP '2024-02-01 00:00:00'"

VIEWS = {
    "listings": f"""
SELECT CAST(p_partkey AS STRING) AS id, CAST(p_partkey % 5 AS STRING) AS source_id, concat('src', CAST(p_partkey % 5 AS STRING)) AS source_code, concat('Source ', CAST(p_partkey % 5 AS STRING)) AS source_name,
  CAST(p_partkey AS STRING) AS external_id, concat('https://example.org/l/', p_type, '-', CAST(p_partkey AS STRING)) AS url,
  concat('Prodej ', p_name, ' ', CAST(1 + p_partkey % 5 AS STRING), CASE p_partkey % 3 WHEN 0 THEN '+kk' WHEN 1 THEN '+1' ELSE ' pokoje' END) AS title,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat(p_type, ' ', p_brand, CASE p_partkey % 11 WHEN 0 THEN ' po rekonstrukci' WHEN 1 THEN ' novostavba z roku 2024' WHEN 2 THEN ' k demolici' WHEN 3 THEN ' k rekonstrukci; cihla' ELSE '' END, ' plocha ', CAST(20 + p_size * 3 AS STRING), ' m2, cena: ', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), ' Kc') END AS description,
  CASE p_size % 6 WHEN 0 THEN 'House' WHEN 1 THEN 'Apartment' WHEN 2 THEN 'Land' WHEN 3 THEN 'Cottage' WHEN 4 THEN 'Commercial' ELSE 'Garage' END AS property_type,
  CASE p_partkey % 4 WHEN 0 THEN 'Rent' ELSE 'Sale' END AS offer_type, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_retailprice * 4000 AS DECIMAL(15,2)) END AS price, CAST(NULL AS STRING) AS price_note,
  concat('Street ', CAST(p_size AS STRING), ', Town', CAST(p_partkey % 23 AS STRING)) AS location_text, concat('Region', CAST(p_partkey % 3 AS STRING)) AS region, CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE concat('District', CAST(p_partkey % 9 AS STRING)) END AS district, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE concat('Town', CAST(p_partkey % 23 AS STRING)) END AS municipality,
  CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE CAST(20 + p_size * 3 AS DOUBLE) END AS area_built_up, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(p_size * 11 AS DOUBLE) END AS area_land, CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE CAST(1 + p_partkey % 6 AS INT) END AS rooms, CAST(NULL AS BOOLEAN) AS has_kitchen,
  CASE WHEN p_partkey % 8 = 0 THEN '3+kk' WHEN p_partkey % 8 = 1 THEN '3+KK' ELSE NULL END AS disposition, CASE p_partkey % 10 WHEN 0 THEN 'Novostavba' WHEN 1 THEN 'Dobry stav' ELSE NULL END AS condition, CASE p_partkey % 9 WHEN 0 THEN 'Cihla' WHEN 1 THEN 'Panel' ELSE NULL END AS construction_type,
  CASE WHEN p_partkey % 12 = 7 THEN NULL ELSE 48.7 + CAST(p_partkey * 37 % 400 AS DOUBLE) / 1000 END AS latitude, CASE WHEN p_partkey % 12 = 7 THEN NULL ELSE 15.8 + CAST(p_partkey * 53 % 900 AS DOUBLE) / 1000 END AS longitude,
  CASE WHEN p_partkey % 12 = 7 THEN NULL WHEN p_partkey % 3 = 0 THEN 'nominatim' ELSE 'scraper' END AS geocode_source, CAST(p_partkey % 50 AS INT) AS view_count,
  {NOW} - (p_partkey * 7 % 300) * INTERVAL '1' DAY AS first_seen_at, {NOW} - (p_partkey % 12) * INTERVAL '1' DAY AS last_seen_at, p_partkey % 7 <> 0 AS is_active,
  CASE WHEN p_partkey % 5 = 0 THEN '["garden","well","view","garage","attic","quiet"]' END AS smart_tags,
  CASE p_partkey % 6 WHEN 0 THEN concat(chr(123), '"has_garden": true, "is_single_floor": false', chr(125)) WHEN 1 THEN concat(chr(123), '"has_garden": "true", "is_single_floor": true', chr(125)) WHEN 2 THEN concat(chr(123), 'broken') ELSE NULL END AS ai_normalized_data,
  CASE p_partkey % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'fair' WHEN 2 THEN 'high' ELSE NULL END AS price_signal, CAST(NULL AS STRING) AS price_signal_reason, CASE WHEN p_partkey % 10 = 9 THEN CAST(p_partkey - 9 AS STRING) END AS duplicate_of_listing_id
FROM {{part}}""",
    "photos": f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING)) AS id, CAST(l_partkey AS STRING) AS listing_id, concat('https://img.example.org/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '.jpg') AS original_url,
  CASE WHEN l_returnflag = 'R' THEN concat('/uploads/', CAST(l_orderkey AS STRING), '.jpg') END AS stored_url, CAST(l_linenumber - 1 AS INT) AS order_index, CASE WHEN l_linestatus = 'F' THEN {NOW} END AS classified_at,
  CASE WHEN l_linestatus = 'F' THEN CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'exterior' WHEN 2 THEN 'damage' WHEN 3 THEN 'land' ELSE 'odd' END END AS photo_category, l_discount > 0.08 AS damage_detected
FROM {{lineitem}}""",
    "history": "SELECT CAST(l_partkey AS STRING) AS listing_id, CAST(CASE WHEN l_quantity < 3 THEN NULL ELSE l_extendedprice END AS DECIMAL(15,2)) AS price, l_shipdate + (l_orderkey * 8 + l_linenumber) * INTERVAL '1' SECOND + l_suppkey * INTERVAL '12' HOUR AS recorded_at FROM {lineitem}",
    "states": "SELECT CAST(user_id AS STRING) AS user_id, CAST(event_id % 2000 AS STRING) AS listing_id, CASE event_type WHEN 'view' THEN 'New' WHEN 'click' THEN 'Liked' WHEN 'purchase' THEN 'ToVisit' WHEN 'error' THEN 'Disliked' ELSE 'Visited' END AS status, CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN 'note' END AS notes, ts AS last_updated FROM {events}",
    "sources": "SELECT CAST(n_nationkey AS STRING) AS id, concat('src', CAST(n_nationkey AS STRING)) AS code, n_name AS name, n_regionkey <> 3 AS is_active FROM {nation}",
    "analyses": f"SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id % 300 AS STRING) AS listing_id, text AS content, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('A', CAST(doc_id AS STRING)) END AS title, CASE doc_id % 7 WHEN 0 THEN 'auto' WHEN 1 THEN 'claude' WHEN 2 THEN 'local:mistral-tools/m' WHEN 3 THEN 'local:claude/s' WHEN 4 THEN 'mistral-large' ELSE 'manual' END AS source, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS embedding, {NOW} - (doc_id * 11 % 97) * INTERVAL '1' HOUR AS created_at FROM {{documents}}",
    "cadastre": "SELECT CAST(p_partkey AS STRING) AS listing_id, CASE p_partkey % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' WHEN 2 THEN 'error' WHEN 3 THEN 'pending' ELSE 'manual' END AS fetch_status FROM {part} WHERE p_partkey % 3 <> 0",
    "runs": "SELECT CAST(o_custkey % 30 AS STRING) AS source_id, CASE o_orderstatus WHEN 'F' THEN 'Succeeded' WHEN 'O' THEN 'Failed' ELSE 'Running' END AS status, o_orderdate AS started_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + (o_orderkey % 600) * INTERVAL '1' SECOND END AS finished_at, o_orderkey % 50 AS total_seen, o_orderkey % 7 AS total_new, o_orderkey % 11 AS total_updated FROM {orders}",
}
#: Views whose rows grow from some bytes to pages that cost milliseconds: their table is dealt over all cores first, for its file is few splits.
DEALT: set[str] = set()
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a raw table."""
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", sql)) & set(RAW)
    spread = dealt if name in DEALT else lambda df: df
    return spark.sql(sql, **{t: spread(view(spark, sf_dir, t)) for t in used})


def duck(sql: str) -> str:
    """``sql`` with the views it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({VIEWS[n].format(**{t: t for t in RAW})})" for n in used]
    rest = sql.strip()
    if rest.upper().startswith("WITH "):
        recursive = rest.upper().startswith("WITH RECURSIVE ")
        rest = rest[15:] if recursive else rest[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*heads, rest])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + rest
