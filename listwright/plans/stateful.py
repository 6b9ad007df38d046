"""Queries that keep tables or state: streams, stored indexes, sketches, table functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import model
from ..functions import tables
from ..operators import ingest, intervals, sketches, spatial, vector_index, word_index
from ..shared import fresh_folder
from ..streaming import ingest as streams
from ..streaming import jobs
from ..streaming.store import BucketStore
from .registry import query

NOW = datetime(2024, 2, 1)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


# --- streaming merge ------------------------------------------------------------------


def observed(listings):
    """A second observation: a third of the listings again with other prices and gaps, some new ones."""
    n = F.col("id").cast("int")
    again = listings.filter(n % 3 == 0).withColumns({"price": F.when(n % 2 == 0, F.col("price")).otherwise((F.col("price") * 2).cast("decimal(15,2)")), "rooms": F.lit(None).cast("int"), "latitude": F.when(n % 4 == 0, F.col("latitude")), "first_seen_at": F.lit(NOW), "last_seen_at": F.lit(NOW), "is_active": F.lit(True)})
    new = listings.filter(n % 5 == 1).withColumns({"external_id": F.concat(F.lit("n"), "external_id"), "id": F.concat(F.lit("n"), "id"), "first_seen_at": F.lit(NOW), "last_seen_at": F.lit(NOW), "is_active": F.lit(True)})
    return again.unionByName(new)


OBSERVED_SQL = f"""o AS (SELECT id, external_id, source_id, CASE WHEN CAST(id AS INT) % 2 = 0 THEN price ELSE CAST(price * 2 AS DECIMAL(15,2)) END AS price, CAST(NULL AS INT) AS rooms, CASE WHEN CAST(id AS INT) % 4 = 0 THEN latitude END AS latitude, {NOW_SQL} AS first_seen_at FROM listings WHERE CAST(id AS INT) % 3 = 0
UNION ALL SELECT concat('n', id), concat('n', external_id), source_id, price, rooms, latitude, {NOW_SQL} FROM listings WHERE CAST(id AS INT) % 5 = 1)"""


def merged_by_stream(listings) -> BucketStore:
    """Listings arrive as files of a stream: one half, the other, then a second observation of some and new ones."""
    spark, n = listings.sparkSession, F.col("id").cast("int")
    root = fresh_folder(spark, "streams")
    store = BucketStore(spark, f"{root}/store")
    for part in (listings.filter(n % 2 == 0), listings.filter(n % 2 == 1), observed(listings)):
        ingest.conform(part).write.mode("append").parquet(f"{root}/in")
        streams.start(spark.readStream.schema(model.LISTING).parquet(f"{root}/in"), store, f"{root}/checkpoint", clock=lambda: NOW).awaitTermination()
    return store


@query(f"""WITH {OBSERVED_SQL} SELECT coalesce(l.id, o.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.price ELSE l.price END AS price, coalesce(o.rooms, l.rooms) AS rooms, coalesce(o.latitude, l.latitude) AS latitude, coalesce(l.first_seen_at, o.first_seen_at) AS first_seen_at, o.id IS NOT NULL OR l.is_active AS is_active
FROM listings l FULL JOIN o ON o.source_id = l.source_id AND o.external_id = l.external_id""")
def streamed_merge(listings):
    return merged_by_stream(listings).read("listings", model.LISTING).select("id", "price", "rooms", "latitude", "first_seen_at", "is_active")


@query(f"""WITH {OBSERVED_SQL} SELECT id AS listing_id, price, {NOW_SQL} AS recorded_at, 'scraper' AS source FROM listings WHERE price IS NOT NULL
UNION ALL SELECT coalesce(l.id, o.id), o.price, {NOW_SQL}, 'scraper' FROM o LEFT JOIN listings l ON o.source_id = l.source_id AND o.external_id = l.external_id WHERE o.price IS NOT NULL AND (l.price IS NULL OR l.price <> o.price)""")
def streamed_history(listings):
    return merged_by_stream(listings).read("history", model.PRICE_HISTORY)


# --- job states and repeats in streams ------------------------------------------------------


@query("""SELECT CAST(o_custkey AS STRING) AS job_id, min(o_orderdate) AS created_at, arg_max(CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' ELSE 'Succeeded' END, {'t': o_orderdate, 's': CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' ELSE 'Succeeded' END}) AS status,
max(o_orderkey % 101) AS progress, max(o_orderdate) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS finished_at, count(*) AS n FROM orders GROUP BY o_custkey""")
def jobs_streamed(orders):
    """Events in an order of batches that is not theirs."""
    spark = orders.sparkSession
    root = fresh_folder(spark, "streams")
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Running").otherwise("Succeeded")
    events = orders.select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), status.alias("status"), (F.col("o_orderkey") % 101).alias("progress"), F.lit(None).cast("string").alias("error_message"), "o_orderkey")
    store = BucketStore(spark, f"{root}/store", 16)
    for k in (2, 0, 1):
        events.filter(F.col("o_orderkey") % 3 == k).drop("o_orderkey").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.drop("o_orderkey").schema).parquet(f"{root}/in")
        jobs.start(stream, store, f"{root}/checkpoint").awaitTermination()
    return store.read("jobs", jobs.FOLDED).select("job_id", "created_at", "status", "progress", "finished_at", "n")


SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def once_by_stream(events):
    """(rows kept, number of late rows) of events that arrive in two files of batches.

    Every seventh event comes twice in its batch, every fifth of the first file's last hours again in the second; in the second
    every eleventh of the first comes under a new id, most of them later than the watermark.
    """
    spark = events.sparkSession
    root, own = fresh_folder(spark, "streams"), events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    first, second = own.filter(f"ts < {SPLIT}"), own.filter(f"ts >= {SPLIT}")
    again = first.filter(f"event_id % 5 = 0 AND ts >= {SPLIT} - INTERVAL '1' HOUR")
    late = first.filter("event_id % 11 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000_000)
    for part in (first.unionByName(first.filter("event_id % 7 = 0")), second.unionByName(second.filter("event_id % 7 = 0")).unionByName(again).unionByName(late)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = streams.once(spark.readStream.schema(own.schema).parquet(f"{root}/in"), ["event_id"], "2 hours")
        n = streams.drained(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(own.schema).parquet(f"{root}/out"), n


LATE_SQL = f"WITH w AS (SELECT max(ts) - INTERVAL '2' HOUR AS mark FROM events WHERE ts < {SPLIT}), x AS (SELECT event_id + 1000000000000 AS event_id, ts FROM events WHERE ts < {SPLIT} AND event_id % 11 = 0)"


@query(f"{LATE_SQL} SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts FROM x, w WHERE ts > mark")
def events_once(events):
    return once_by_stream(events)[0]


@query(f"{LATE_SQL} SELECT count(*) AS late FROM x, w WHERE ts <= mark")
def events_late(events):
    return events.sparkSession.createDataFrame([(once_by_stream(events)[1],)], "late long")


# --- intervals, sketches, table functions ------------------------------------------------------


@query("""SELECT e.event_id, r.source_id, r.status, r.started_at FROM (SELECT event_id, ts - INTERVAL '9000' DAY AS moment FROM events) e
JOIN (SELECT *, coalesce(finished_at, started_at + INTERVAL '1' DAY) AS done FROM runs) r ON e.moment >= r.started_at AND e.moment < r.done""")
def runs_at_events(events, runs):
    spans = runs.select("source_id", "status", "started_at", F.coalesce("finished_at", F.col("started_at") + F.expr("INTERVAL '1' DAY")).alias("done"))
    return intervals.points_in(events.select("event_id", (F.col("ts") - F.expr("INTERVAL '9000' DAY")).alias("moment")), "moment", spans, "started_at", "done").select("event_id", "source_id", "status", "started_at")


@query("SELECT event_type, month(ts) * 100 + day(ts) // 8 AS period, count(*) AS n, count(DISTINCT user_id) AS n_distinct, true AS distinct_close, true AS median_close FROM events GROUP BY ALL")
def sketched_periods(events):
    """Sketches of days merged to spans of eight days, beside the exact counts; close: within three standard errors."""
    spark, path = events.sparkSession, fresh_folder(events.sparkSession, "sketches")
    sketches.refreshed(path, sketches.daily(events, "ts", ["event_type"], "user_id", "value"))
    period = lambda c: (F.month(c) * 100 + F.floor(F.dayofmonth(c) / 8)).cast("long").alias("period")
    about = sketches.merged(spark.read.parquet(path).withColumn("period", period("day")), ["event_type", "period"], [0.45, 0.55]).withColumnsRenamed({"n": "_n", "n_distinct": "_d"})
    exact = events.groupBy("event_type", period("ts")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_distinct"), F.percentile("value", F.lit(0.5)).alias("_m"))
    close = F.abs(F.col("_d") - F.col("n_distinct")) <= F.greatest(F.lit(1.0), 3 * 1.04 / 2 ** (sketches.LG_REGISTERS / 2) * F.col("n_distinct"))
    both = exact.join(about, ["event_type", "period"])
    return both.select("event_type", "period", F.col("_n").alias("n"), "n_distinct", close.alias("distinct_close"), F.col("_m").between(F.col("q45"), F.col("q55")).alias("median_close"))


@query()
def html_elements(pages):
    """Elements of all pages by the table function."""
    spark = pages.sparkSession
    tables.register(spark)
    return spark.sql("SELECT * FROM elements(TABLE({pages}))", pages=pages.select("page_id", "html"))


# --- stored indexes ------------------------------------------------------------------------------------


def indexed(documents) -> word_index.WordIndex:
    """A word index that took documents in with other texts first: a third changed after, some were deleted, some came later."""
    n = F.col("doc_id")
    index = word_index.WordIndex(documents.sparkSession, fresh_folder(documents.sparkSession, "indexes"))
    before = documents.filter(n % 5 != 4).withColumn("text", F.when(n % 3 == 0, F.concat(F.lit("The ERTH, "), F.reverse("text"))).otherwise(F.col("text")))
    gone = documents.filter(n % 7 == 0).withColumn("doc_id", -n - 1)
    index.update(0, "doc_id", ["text"], before.unionByName(gone))
    index.update(1, "doc_id", ["text"], documents.filter((n % 5 != 4) & (n % 3 == 0)), before.filter(n % 3 == 0).unionByName(gone))
    index.update(2, "doc_id", ["text"], documents.filter(n % 5 == 4))
    return index


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9\\x80-\\x{10FFFF}])the([^a-z0-9\\x80-\\x{10FFFF}]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9\\x80-\\x{10FFFF}])erth([^a-z0-9\\x80-\\x{10FFFF}]|$)')")
def fts_indexed(documents):
    return indexed(documents).matching("The, ERTH").select(F.col("id").alias("doc_id"))


@query()
def vectors_indexed(embeddings):
    """The ten nearest of every vector whose id 50 divides, by as many of the index's cells as its sample asks for."""
    items = embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    index = vector_index.VectorIndex.build(items, fresh_folder(embeddings.sparkSession, "indexes"))
    return index.search(items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), 10)


# --- places ---------------------------------------------------------------------------------------------


def towns(listings):
    """Municipality polygons around some listings: diamonds of different sizes, one in three with a hole."""
    own = listings.filter("latitude IS NOT NULL AND CAST(id AS INT) % 8 = 0").withColumn("s", 0.004 + (F.col("id").cast("int") % 9) * 0.02)
    ring = lambda k: F.concat(F.lit("("), F.concat_ws(", ", *(F.concat_ws(" ", (F.col("longitude") + F.col("s") * k * dx).cast("string"), (F.col("latitude") + F.col("s") * k * dy).cast("string")) for dx, dy in ((1.5, 0), (0, 1), (-1.5, 0), (0, -1), (1.5, 0)))), F.lit(")"))
    hole = F.when(F.col("id").cast("int") % 3 == 0, F.concat(F.lit(", "), ring(0.4))).otherwise("")
    return own.select(F.concat(F.lit("town"), "id").alias("name"), F.concat(F.lit("POLYGON("), ring(1.0), hole, F.lit(")")).alias("wkt"))


def routes(listings):
    """Routes of two long legs from some listings, with corridors of 300 m to 4 km."""
    own = listings.filter("latitude IS NOT NULL AND CAST(id AS INT) % 40 = 1")
    point = lambda dx, dy: F.concat_ws(" ", (F.col("longitude") + dx).cast("string"), (F.col("latitude") + dy).cast("string"))
    line = F.concat(F.lit("LINESTRING("), F.concat_ws(", ", point(0.0, 0.0), point(0.21, 0.08), point(0.24, -0.11)), F.lit(")"))
    return own.select(F.concat(F.lit("route"), "id").alias("area_id"), line.alias("wkt"), (300.0 + (F.col("id").cast("int") % 3) * 1850.0).alias("radius"))


@query()
def towns_in_corridors(listings):
    return spatial.municipalities_in_corridors(towns(listings), routes(listings))


@query()
def corridor_outline_members(listings):
    """Active listings inside the dissolved outlines of the corridors."""
    own = listings.filter("is_active").select("id", "latitude", "longitude")
    return spatial.outlines_join(own, routes(listings)).select("area_id", "id")


BOX = "concat('POLYGON((', {l}, ' ', {b}, ', ', {r}, ' ', {b}, ', ', {r}, ' ', {t}, ', ', {l}, ' ', {t}, ', ', {l}, ' ', {b}, '))')"


def boxes(listings, name: str, where: str, size: float):
    ends = {"l": f"CAST(longitude - {size!r}D AS STRING)", "r": f"CAST(longitude + {size!r}D AS STRING)", "b": f"CAST(latitude - {size!r}D AS STRING)", "t": f"CAST(latitude + {size!r}D AS STRING)"}
    return listings.filter(f"latitude IS NOT NULL AND longitude IS NOT NULL AND {where}").select(F.col("id").alias(name), F.expr(BOX.format(**ends)).alias("wkt"))


@query("""WITH p AS (SELECT CAST(id AS INT) AS n, id, longitude AS x, latitude AS y FROM listings WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT a.id AS area_id, t.id AS name FROM p a JOIN p t ON a.n % 20 = 3 AND t.n % 4 = 1 AND a.x - 0.0507 <= t.x + 0.0112 AND t.x - 0.0112 <= a.x + 0.0507 AND a.y - 0.0507 <= t.y + 0.0112 AND t.y - 0.0112 <= a.y + 0.0507""")
def towns_in_areas(listings):
    return spatial.municipalities_in_areas(boxes(listings, "name", "CAST(id AS INT) % 4 = 1", 0.0112), boxes(listings, "area_id", "CAST(id AS INT) % 20 = 3", 0.0507))
