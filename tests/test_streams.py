"""Streams and stored tables: several batches, replays, failed commits, any order."""

from collections import Counter
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from listwright import model
from listwright.operators import ingest, intervals, sketches, word_index
from listwright.plans import stateful
from listwright.plans.registry import QUERIES
from listwright.plans.views import view
from listwright.shared import fresh_folder
from listwright.sources import html
from listwright.streaming import ingest as streams
from listwright.streaming import jobs
from listwright.streaming.store import BucketStore

NOW = datetime(2024, 2, 1)


def rows(df, *names):
    return Counter(tuple(r[c] for c in names or df.columns) for r in df.collect())


def listing(i, price, **more):
    return {"id": f"L{i}", "source_id": str(i % 3), "external_id": str(i), "title": f"t{i}", "price": price, "is_active": True} | more


def frame(spark, *own):
    schema = model.LISTING.replace("\n", " ")
    names = [f.split()[0] for f in schema.strip().split(", ")]
    return ingest.conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in own], schema).withColumn("price", F.col("price")))


def test_merge_survives_a_failed_commit_and_replays(spark, monkeypatch):
    root = fresh_folder(spark, "tests")
    store = BucketStore(spark, f"{root}/store", 8)
    first = frame(spark, *(listing(i, D(100 + i)) for i in range(20)))
    second = frame(spark, listing(3, D(999)), listing(4, D(104)), listing(99, None))
    first.write.parquet(f"{root}/in")

    def run():
        streams.start(spark.readStream.schema(model.LISTING).parquet(f"{root}/in"), store, f"{root}/checkpoint", clock=lambda: NOW).awaitTermination()

    run()
    before = store.folders("listings")
    second.write.mode("append").parquet(f"{root}/in")
    commit = BucketStore.commit

    def broken(self, *args, **more):
        raise OSError("lost")

    monkeypatch.setattr(BucketStore, "commit", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    assert store.version() == 0 and rows(store.read("listings", model.LISTING)) == rows(ingest.upsert(first.limit(0), first))
    monkeypatch.setattr(BucketStore, "commit", commit)
    run()
    run()  # nothing new
    want = ingest.upsert(ingest.upsert(first.limit(0), first), second)
    assert rows(store.read("listings", model.LISTING)) == rows(want)
    assert rows(store.read("history", model.PRICE_HISTORY), "listing_id", "price") == Counter([(f"L{i}", D(100 + i)) for i in range(20)] + [("L3", D(999))])
    # Buckets without a row of the second batch are the first's files; the merge of a version that is there changes nothing.
    after, touched = store.folders("listings"), {r[0] for r in second.select(store.bucket(*ingest.KEY)).collect()}
    assert touched and set(after) > touched and all(after[b] == ([1] if b in touched else before[b]) for b in after)
    assert not streams.merge_listings(store, second.withColumn("price", F.lit(5).cast("decimal(15,2)")), NOW, 1)
    assert rows(store.read("listings", model.LISTING)) == rows(want)
    assert store.vacuum(1) == len(touched & set(before)) and rows(store.read("listings", model.LISTING)) == rows(want)


def test_merge_of_raw_records_equals_the_batch_operators(spark):
    root = fresh_folder(spark, "tests")
    store, rules = BucketStore(spark, f"{root}/store", 4), ingest.Admission(require_price=True)
    schema = "source_id string, source_code string, source_name string, external_id string, url string, title string, description string, property_type string, offer_type string, price decimal(15,2), location_text string, disposition string, rooms int, condition string, construction_type string, latitude double, longitude double, geocode_source string, photos array<string>"
    a = spark.createDataFrame([("1", "s", "S", "x", "u", "Prodej bytu 3+1", "Panelový dům", "Byt", "Prodej", D(10), "Brno", None, None, None, None, 49.0, 16.0, None, ["p1", "p2"]), ("1", "s", "S", "y", "u", "Dům", "", "Dům", "Prodej", None, "Brno", None, None, None, None, None, None, None, ["p9"])], schema)
    b = spark.createDataFrame([("1", "s", "S", "x", "u", "Prodej bytu", "Panelový dům", "Byt", "Prodej", D(12), "Brno", None, None, None, None, None, None, None, ["p2", "p3"])], schema)
    stored, history, photos = (spark.createDataFrame([], s) for s in (model.LISTING, model.PRICE_HISTORY, model.PHOTO))
    for k, raw in enumerate((a, b)):
        bad = streams.merge_batch(store, raw, rules, NOW, k)
        assert bad.count() == (1 if k == 0 else 0)
        new = ingest.mapped(ingest.admitted(ingest.enrich(raw), rules)[0], NOW)
        history = history.unionByName(ingest.conform(ingest.price_changes(stored, ingest.conform(new), NOW), model.PRICE_HISTORY))
        photos = ingest.synced_photos(photos, new.select(F.col("id").alias("listing_id"), "photos"))
        stored = ingest.upsert(stored, new)
    for name, schema, want in (("listings", model.LISTING, stored), ("history", model.PRICE_HISTORY, history), ("photos", model.PHOTO, photos)):
        assert rows(store.read(name, schema)) == rows(want) and want.count() > 0
    # One bucket's folders only are read.
    plan = store.read("listings", model.LISTING, list(store.folders("listings"))[:1]).inputFiles()
    assert plan and all("/listings/v=1/" in f for f in plan)


def test_silent_jobs_are_given_out(spark):
    root = fresh_folder(spark, "tests")
    store = BucketStore(spark, f"{root}/store", 2)
    schema = "job_id string, ts timestamp, status string, progress long, error_message string"
    for k, own in enumerate(([("a", datetime(2024, 1, 2), "Running", 5, None), ("b", datetime(2024, 1, 1), "Failed", None, "x")], [("b", None, "Running", 7, None)], [("a", datetime(2024, 1, 1), "Queued", 1, None)])):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        jobs.start(spark.readStream.schema(schema).parquet(f"{root}/in"), store, f"{root}/checkpoint", "0 seconds" if k < 2 else "1 day").awaitTermination()
        if k == 1:
            assert rows(store.read("jobs", jobs.FOLDED), "job_id", "status", "silent", "n") == Counter([("a", "Running", True, 1), ("b", "Failed", False, 2)])
    assert rows(store.read("jobs", jobs.FOLDED), "job_id", "created_at", "status", "progress", "error_message", "finished_at", "n", "silent") == Counter([("a", datetime(2024, 1, 1), "Running", 5, None, None, 2, False), ("b", datetime(2024, 1, 1), "Failed", 7, "x", datetime(2024, 1, 1), 2, False)])


def test_intervals(spark):
    t = lambda s: datetime.fromtimestamp(1_700_000_000 + s)
    spans = [(1, t(0), t(10)), (2, t(5), t(5)), (3, t(9), t(3)), (4, t(-50_000_000), None), (5, None, t(9)), (6, t(0), t(40_000_000)), (7, t(1), t(2)), (8, datetime(1950, 1, 1), t(3)), (8, datetime(1950, 1, 1), t(3)), (9, datetime(1950, 1, 1), None)]
    points = [(k, t(k)) for k in (-1, 0, 1, 2, 3, 9, 10, 100_000, 39_999_999, 40_000_000)] + [(500, None), (501, datetime(1960, 5, 5))]
    p, s = spark.createDataFrame(points, "k long, at timestamp"), spark.createDataFrame(spans, "i long, a timestamp, b timestamp")
    got = intervals.points_in(p, "at", s, "a", "b")
    assert rows(got, "k", "i") == Counter((k, i) for k, x in points for i, a, b in spans if x and a and a <= x and (b is None or x < b))
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert intervals.points_in(p, "at", s.limit(0), "a", "b").count() == 0
    keyed = intervals.points_in(p.withColumn("g", F.pmod("k", F.lit(2))), "at", s.withColumn("g", F.pmod("i", F.lit(2))), "a", "b", ("g",))
    assert rows(keyed, "k", "i") == Counter((k, i) for k, x in points for i, a, b in spans if x and a and k % 2 == i % 2 and a <= x and (b is None or x < b))


def test_sketches_merge_days(spark, sf):
    events = view(spark, sf, "events")
    path = fresh_folder(spark, "tests")
    sketches.refreshed(path, sketches.daily(events, "ts", [], "event_id", "value"))
    sketches.refreshed(path, sketches.daily(events.filter("day(ts) = 3"), "ts", [], "event_id", "value"))
    got = sketches.merged(spark.read.parquet(path), [], [0.5, 0.9]).first()
    assert got.n == events.count() and abs(got.n_distinct - got.n) <= 0.05 * got.n
    values = sorted(r[0] for r in events.select("value").collect() if r[0] is not None)
    rank = lambda v: sum(x <= v for x in values) / len(values)
    assert abs(rank(got.q50) - 0.5) < 0.04 and abs(rank(got.q90) - 0.9) < 0.04


def test_elements_of_the_table_function(spark, sf):
    pages = view(spark, sf, "pages")
    want = html.parsed(pages).select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")
    text = lambda df: df.select("page_id", "idx", "parent", "tag", F.to_json("attrs").alias("attrs"), "text")
    got = QUERIES["html_elements"](spark, sf)
    assert rows(text(got)) == rows(text(want)) and got.count() > pages.count()
    pages.createOrReplaceTempView("own_pages")
    assert spark.sql("SELECT tag, count(*) AS n FROM elements(TABLE(SELECT page_id, html FROM own_pages) PARTITION BY page_id) GROUP BY tag HAVING tag = 'title'").first().n == want.filter("tag = 'title'").count()


def test_word_index_reads_the_asked_buckets_and_compacts(spark):
    index = word_index.WordIndex(spark, fresh_folder(spark, "tests"), 16)
    d = lambda *r: spark.createDataFrame(list(r), "id long, text string, version long")
    assert index.update(0, "id", ["text"], d((1, "Red house", 0), (2, "red, RED car", 0), (3, None, 0), (None, "red house", 0)))
    assert not index.update(0, "id", ["text"], d((9, "red house", 0)))
    assert rows(index.matching("house RED")) == Counter([("1",)])
    index.update(1, "id", ["text"], d((2, "blue house red", 0)), d((2, "red car", 0), (1, "red house", 0)))
    assert rows(index.matching("red house")) == Counter([("2",)]) and index.matching("car").count() == 0
    for k in range(2, 6):
        index.update(k, "id", ["text"], d((k * 10, "red house", 0)))
    files = index.current([r[0] for r in spark.createDataFrame([("red",)], "word string").select(index.store.bucket("word")).collect()]).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == {str(spark.createDataFrame([("red",)], "word string").select(index.store.bucket("word")).first()[0])}
    before = rows(index.matching("red house"))
    assert index.compact(6, 2) and rows(index.matching("red house")) == before and max(map(len, index.store.folders("postings").values())) <= 2
    with pytest.raises(ValueError):
        index.matching(" , ")


def test_vector_index(spark, sf):
    import numpy as np

    from listwright.operators import vector_index

    own = view(spark, sf.replace("0.001", "0.01"), "embeddings")
    data = {r.vec_id: np.array(r.embedding, float) for r in own.collect()}
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids])
    want = {int(q): [int(i) for i in ids[np.lexsort((ids, np.sqrt(((x - data[q]) ** 2).sum(1))))[:10]]] for q in ids if q % 50 == 0}
    items = own.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    index = vector_index.VectorIndex.build(items.unionByName(items.limit(1).withColumns({"item_id": F.lit(-1).cast("long"), "vector": F.lit(None).cast("array<float>")})), fresh_folder(spark, "tests"))
    for probes, least in ((len(index.centres), 1.0), (None, 0.9)):
        found = {}
        for r in index.search(queries, 10, probes).collect():
            found.setdefault(r.query_id, {})[r.position] = r.item_id
        recall = np.mean([len(set(w) & set(found[q].values())) / 10 for q, w in want.items()])
        assert recall >= least, recall
        if least == 1.0:
            assert {q: [v[k] for k in sorted(v)] for q, v in found.items()} == want


def test_observed_has_new_and_known(spark, sf):
    assert {r.id[0] == "n" for r in stateful.observed(view(spark, sf, "listings")).collect()} == {True, False}
