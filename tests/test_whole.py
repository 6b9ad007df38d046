"""Queries over whole tables, on the cases that a subset of the rows would hide."""

import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from listwright.functions import geo, numbers, text
from listwright.operators import ranking
from listwright.plans import catalog


def test_accents_all_marks(spark, sf):
    samples = [chr(c) for c in range(0xA0, 0x3100) if not unicodedata.category(chr(c)).startswith("C")] + ["señor, garçon, père, à", "ẹ́", "각", "Straße łódź", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.p for r in df.select("i", text.strip_accents(F.col("s")).alias("p")).collect()}
    assert got == {i: s if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for i, s in enumerate(samples)}

    whole = {r.doc_id: r.text for r in catalog.view(spark, sf, "documents").collect()}
    stripped = catalog.QUERIES["accents_stripped_all"](spark, sf).collect()
    assert len(stripped) == len(whole) and all(r.plain == "".join(c for c in unicodedata.normalize("NFD", whole[r.doc_id]) if unicodedata.category(c) != "Mn") for r in stripped)


def test_price_ties(spark, sf):
    ties = {"1050000.00": "1.1 M", "1150000.00": "1.2 M", "1250000.00": "1.3 M", "1049999.99": "1.0 M", "12345650000.00": "12345.7 M", "500.00": "1 k", "1500.00": "2 k", "2500.00": "3 k", "2499.99": "2 k", "999500.00": "1000 k", "0.00": "0 k"}
    df = spark.createDataFrame([(p,) for p in [*ties, None]], "p string").withColumn("shown", numbers.price_display(F.col("p").cast("decimal(15,2)")))
    assert {r.p: r.shown for r in df.collect()} == ties | {None: "neuvedena"}

    listings = catalog.view(spark, sf, "listings")
    shown = catalog.QUERIES["price_display_all"](spark, sf)
    assert listings.select("id").exceptAll(shown.select("id")).isEmpty() and shown.count() == listings.count()


def test_straight_line_all(spark, sf):
    ends = [F.lit(x) for x in (49.0, 16.0, 49.25, 0.1 + 0.2)]
    assert spark.range(1).select(geo.straight_line(*ends)).first()[0] == "LINESTRING(16 49, 0.30000000000000004 49.25)"
    points = catalog.view(spark, sf, "listings").filter("latitude IS NOT NULL AND longitude IS NOT NULL").collect()
    lines = {r.id: r.wkt for r in catalog.QUERIES["straight_line_all"](spark, sf).collect()}
    assert len(points) > 1 and lines == {r.id: f"LINESTRING({repr(r.longitude).removesuffix('.0')} {repr(r.latitude).removesuffix('.0')}, 16.5 49.25)" for r in points}


def test_except_all_subtracts(spark, sf):
    customers, suppliers = (Counter(r[0] for r in catalog.view(spark, sf, t).select(c).collect()) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    got = {r.k: r.n for r in catalog.QUERIES["ext_except_all_suppliers"](spark, sf).collect()}
    assert got == dict(customers - suppliers) and got != dict(customers)


def test_rank_in_ranges(spark):
    rows = [(i, None if i % 50 == 0 else i * 37 % 101) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, s int")
    got = ranking.ranked_with_best(df, "s", "k")
    assert "Window" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "windowspecdefinition(s" not in plan
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.k: (r.position, r.max_score) for r in got.collect()} == {k: (i + 1, 100) for i, (k, _) in enumerate(want)}
    assert ranking.ranked_with_best(df.limit(0), "s", "k").count() == 0
