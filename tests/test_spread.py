"""Steps that must not gather in one task, and equal shapes that are compared once."""

import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listwright.functions import geo
from listwright.operators import intervals, rag, search, spatial, word_index
from listwright import shared
from listwright.plans.registry import QUERIES
from listwright.plans.views import view
from listwright.shared import fresh_folder
from listwright.sources import html
from listwright.streaming import jobs
from listwright.streaming.store import BucketStore


def test_duplicate_candidates_are_dealt(spark):
    """One town and kind still is several tasks; prices exactly a twentieth apart are near."""
    rows = [(str(i), "T", "House", p, f"dům {i % 3}", True) for i, p in enumerate(("1000000.00", "950000.00", "949999.99", "1000000.00"))]
    own = spark.createDataFrame(rows, "id string, municipality string, property_type string, price string, title string, is_active boolean").withColumn("price", F.col("price").cast("decimal(15,2)"))
    found = rag.duplicate_candidates(own)
    assert sorted((r.id1, r.id2, round(r.title_similarity, 6)) for r in found.collect()) == [("0", "1", 0.333333), ("0", "3", 1.0), ("1", "2", 0.333333), ("1", "3", 0.333333)]
    assert "_salt" in found._jdf.queryExecution().optimizedPlan().toString()


LISTED = "id string, municipality string, property_type string, price string, title string, is_active boolean"


def test_duplicate_candidates_with_equal_words_meet_as_lists(spark, monkeypatch):
    """Lists unfold above the join; each pair comes once, with frequent words as bits and rare ones beside."""
    monkeypatch.setattr(rag, "LIST", 3)
    monkeypatch.setattr(rag, "BITS", 2)
    titles = ["dům u lesa", "Dům u vody", "les a dům", "byt", None, "", "byt 2+kk u lesa"]
    rows = [(str(i), "T" if i % 9 else "U", "House", f"{900_000 + i * 7919 % 120_000 if i % 4 else 1_000_000}.{i % 10}0", titles[i // 2 % 7], True) for i in range(120)]
    own = spark.createDataFrame(rows, LISTED).withColumn("price", F.col("price").cast("decimal(15,2)"))
    words = {t: t and frozenset(t.lower().split(" ")) for t in titles}
    words[""] = frozenset([""])
    want = {}
    for i, (a, town, _, p, t, _) in enumerate(rows):
        for b, other, _, q, u, _ in rows[i + 1 :]:
            x, y = (round(float(v) * 100) for v in (p, q))
            if town == other and abs(x - y) * 20 <= max(x, y):
                want[min(a, b), max(a, b)] = None if t is None or u is None else round(len(words[t] & words[u]) / len(words[t] | words[u]), 9)
    got = rag.duplicate_candidates(own)
    found = got.collect()
    assert {(r.id1, r.id2): r.title_similarity if r.title_similarity is None else round(r.title_similarity, 9) for r in found} == want and len(found) == len(want) > 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_right") < plan.index("Generate explode(_left") < plan.index("Join Inner")
    assert rag.duplicate_candidates(own.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["offer_pages", "ad_pages", "pushed_pages", "feed_items"])
def test_page_views_are_dealt(spark, sf, name):
    assert view(spark, sf, name).rdd.getNumPartitions() > view(spark, sf, "part").rdd.getNumPartitions()


def test_elements_leave_in_slices():
    got = list(html.sliced(iter([pd.Series(["<p>a"] * 150), pd.Series([], dtype=object)])))
    assert [len(x) for x in got] == [64, 64, 22] and got[2].iloc[0][0]["text"] == "a"


def test_equal_shapes_form_a_class(spark):
    square = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"
    areas = spark.createDataFrame([("a", square), ("b", square), ("b", "POLYGON((5 5, 6 5, 6 6, 5 5))"), ("c", None)], "area_id string, wkt string")
    members, shapes = spatial.classes(areas, "area_id", "_area", "wkt")
    assert members.count() == 2 and shapes.count() == 3
    points = spark.createDataFrame([("p", 0.5, 0.5), ("q", 0.5, 0.5), ("r", 5.4, 5.8), ("s", None, 1.0)], "id string, latitude double, longitude double")
    got = spatial.areas_join(points, areas, 0.5)
    assert got.columns == ["id", "latitude", "longitude", "area_id"]
    assert sorted((r.id, r.area_id) for r in got.collect()) == [("p", "a"), ("p", "b"), ("q", "a"), ("q", "b"), ("r", "b")]
    towns = spark.createDataFrame([("x", square), ("y", square)], "name string, wkt string")
    assert sorted(map(tuple, spatial.municipalities_in_areas(towns, areas, 0.5).collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_outlines_are_made_once_and_pairs_unfold_where_they_meet(spark, sf, plain_joins):
    """One call of the outline for each distinct route, none below the step that makes them distinct; no exchange above the cell join."""
    plan = QUERIES["corridor_outline_members"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Aggregate" in plan.split("ArrowEvalPython")[1]
    top = plan[: plan.index("Join Inner")]
    assert "Generate explode(_areas" in top and "Generate inline(_rows" in top and "Repartition" not in top and "Aggregate" not in top


def test_places_and_areas_meet_as_lists(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LIST", 2)
    left, right = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", "MULTIPOLYGON(((3 0, 4 0, 4 1, 3 1, 3 0)), ((0.2 0.2, 0.8 0.2, 0.8 0.8, 0.2 0.8)))"
    areas = spark.createDataFrame([(f"a{i}", w) for i in range(5) for w in (left, right, right)] + [("only", left), ("none", None)], "area_id string, wkt string")
    points = spark.createDataFrame([(f"p{i}", 0.5, 0.5) for i in range(5)] + [("edge", 0.5, 1.0), ("far", 0.5, 3.5), ("out", 5.0, 5.0), ("null", None, 0.5)], "id string, latitude double, longitude double")
    got = spatial.areas_join(points, areas, 0.5)
    assert got.columns == ["id", "latitude", "longitude", "area_id"]
    every = [f"a{i}" for i in range(5)]
    assert sorted((r.id, r.area_id) for r in got.collect()) == sorted([(f"p{i}", a) for i in range(5) for a in (*every, "only")] + [("edge", a) for a in (*every, "only")] + [("far", a) for a in every])


def test_sides_agree_with_polygons(spark):
    shapes = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2))", "MULTIPOLYGON(((0 0, 2 3, 4 0, 2 1)), ((2 3, 4 4, 3 2, 2 3)))", "POLYGON((1 1, 1 1, 3 1, 3 1))", "POLYGON EMPTY", None]
    grid = spark.range(0, 441).selectExpr("(id % 21) / 4D - 0.5 AS lon", "(id div 21) / 4D - 0.5 AS lat").crossJoin(spark.createDataFrame([(w,) for w in shapes], "wkt string")).withColumn("r", geo.rings_of_wkt(F.col("wkt")))
    both = grid.select(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("r")).alias("a"), geo.in_sides(F.col("lon"), F.col("lat"), geo.sides_of_rings(F.col("r"))).alias("b"))
    assert both.filter("NOT a <=> b").count() == 0 and both.filter("a").count() > 200


def largest_share(df):
    """The largest part of the rows that one task of the last stage gives out."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


@pytest.fixture
def plain_joins(spark):
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_listings_without_a_primary_are_dealt(spark, sf, plain_joins):
    own = search.details(*(view(spark, sf, n) for n in ("listings", "photos", "states")), "5")
    assert largest_share(own.filter("duplicate_of_listing_id IS NULL")) < 0.5


def test_points_of_one_cell_are_dealt(spark, plain_joins):
    points = spark.range(200).selectExpr("id", "timestamp_micros(1700000000000000 + id) AS at")
    spans = spark.createDataFrame([(1, 1_699_999_999, 1_700_000_001), (2, 100, 200)], "n int, s long, e long").selectExpr("n", "timestamp_seconds(s) AS s", "timestamp_seconds(e) AS e")
    got = intervals.points_in(points, "at", spans, "s", "e")
    assert got.columns == ["id", "at", "n", "s", "e"] and got.count() == 200 and largest_share(got) < 0.5


@pytest.mark.parametrize("cells", [0, 1000])
def test_equal_intervals_meet_a_point_once(spark, monkeypatch, cells):
    """Equal intervals go as lists, unfolded above the join; points that no interval's cell holds stay out where the cells are few."""
    monkeypatch.setattr(intervals, "LIST", 3)
    monkeypatch.setattr(intervals, "CELLS", cells)
    at = [0, 5, 9, 10, 100, 5000, None]
    ends = [(0, 10)] * 8 + [(5, None), (9, 9), (10, 0), (None, 5), (50, 4000), (0, 10)]
    points = spark.createDataFrame([(i, f"k{k}", t) for i, t in enumerate(at) for k in (0, 1)], "id int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    spans = spark.createDataFrame([(f"k{n % 2}", s, None if n == 3 else n // 4, e) for n, (s, e) in enumerate(ends)], "k string, s long, n int, e long").withColumns({c: F.timestamp_seconds(c) for c in ("s", "e")})
    got = intervals.points_in(points, "t", spans, "s", "e", ("k",))
    want = sorted((i, f"k{n % 2}", s, -1 if n == 3 else n // 4) for i, t in enumerate(at) for n, (s, e) in enumerate(ends) if t is not None and s is not None and s <= t and (e is None or t < e))
    assert got.columns == ["id", "k", "t", "s", "n", "e"]
    assert sorted(tuple(r) for r in got.select("id", "k", F.unix_seconds("s"), F.coalesce("n", F.lit(-1))).collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_rows") < plan.index("Join Inner") and ("Join LeftSemi" in plan) == (cells > 0)
    bare = intervals.points_in(points.filter("k = 'k0'").drop("k"), "t", spans.select("s", "e"), "s", "e")
    assert bare.columns == ["id", "t", "s", "e"] and bare.count() == len(want)


def test_nearest_by_id_where_distances_are_equal(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(900, 0, -1)], "item_id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.item_id, r.position) for r in rag.similar_to_each(asked, items, 3).orderBy("position").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_postings_cross_the_exchange_as_lists(spark):
    index = word_index.WordIndex(spark, fresh_folder(spark, "tests"), 4)
    own = spark.range(20_000).selectExpr("id", "'same Words, same words' AS text")
    index.update(0, "id", ["text"], own.unionByName(own.filter("id < 10").withColumn("text", F.lit("words again"))))
    assert index.store.read("postings", word_index.POSTINGS).count() < 1000 and index.matching("same words").count() == 20_000
    assert sorted(r.id for r in index.matching("again words").collect()) == [str(k) for k in range(10)]
    index.update(1, "id", ["text"], own.filter("id = 7").withColumn("text", F.lit("other words")), own.filter("id IN (7, 8)"))
    assert index.matching("words").count() == 19_999 and index.matching("same").count() == 19_998 and [r.id for r in index.matching("other").collect()] == ["7"]


EVENT = "job_id string, ts timestamp, status string, progress long, error_message string"


def test_jobs_are_folded_without_a_call_a_job(spark):
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", at, "Running", 2, "y"), ("a", at, "Running", None, "x"), ("a", None, "Failed", 9, "z"), (None, at, "Failed", None, "w"), (None, None, None, 1, None)], EVENT)
    got = jobs.folded(jobs.states(events, 10), 5)
    assert {(r.job_id, r.status, r.status_at, r.progress, r.error_message, r.finished_at, r.n, r.silent) for r in got.collect()} == {("a", "Running", at, 9, "y", None, 3, False), (None, "Failed", at, 1, "w", at, 2, False)}
    assert "Python" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan


def test_jobs_fall_silent_while_no_events_come(spark):
    root = fresh_folder(spark, "tests")
    store = BucketStore(spark, f"{root}/store", 2)
    spark.createDataFrame([("a", datetime(2024, 1, 2), "Running", 5, None), ("b", datetime(2024, 1, 1), "Failed", None, "x")], EVENT).coalesce(1).write.parquet(f"{root}/in")
    run = jobs.start(spark.readStream.schema(EVENT).parquet(f"{root}/in"), store, f"{root}/checkpoint", "1 second", processingTime="500 milliseconds")
    try:
        for _ in range(60):
            if (own := {r.job_id: r.silent for r in store.read("jobs", jobs.FOLDED).collect()}) == {"a": True, "b": False}:
                break
            time.sleep(1)
        assert own == {"a": True, "b": False} and run.isActive
    finally:
        run.stop()


@pytest.mark.parametrize("name", ["photo_sync_actions", "numbered_after"])
def test_tasks_follow_the_table(spark, sf, name, plain_joins, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 200)
    own = QUERIES[name](spark, sf)
    assert own.rdd.getNumPartitions() == -(-view(spark, sf, "photos").count() // 200) > 8
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and ", 8)" not in plan and ", 8," not in plan
