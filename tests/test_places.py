"""Corridors and areas against brute force in plain Python, on all rows."""

import math

from pyspark.sql import functions as F

from listwright.functions import krovak
from listwright.functions.outline import area, outline
from listwright.operators import spatial
from listwright.plans import stateful
from listwright.plans.registry import QUERIES
from listwright.plans.views import view


def numbers(wkt):
    """Rings or the line of a WKT text as lists of (lon, lat)."""
    import re

    return [[tuple(map(float, p.split())) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", wkt)]


def plane(points):
    x, y = krovak.to_plane_np([p[1] for p in points], [p[0] for p in points])
    return list(zip(map(float, x), map(float, y), strict=True))


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0.0 if dx == dy == 0 else min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def apart(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
        return 0.0
    return min(to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b))


def holds(rings, p):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def test_towns_in_corridors(spark, sf):
    listings = view(spark, sf, "listings")
    towns = {r.name: numbers(r.wkt) for r in stateful.towns(listings).collect()}
    routes = {r.area_id: (numbers(r.wkt)[0], r.radius) for r in stateful.routes(listings).collect()}
    got = {(r.area_id, r.name) for r in QUERIES["towns_in_corridors"](spark, sf).collect()}
    want, missed_by_corners = set(), 0
    flat = {n: [plane(r) for r in rings] for n, rings in towns.items()}
    for a, (line, radius) in routes.items():
        own = plane(line)
        for name, rings in flat.items():
            near = min(apart(p, q, r, s) for p, q in zip(own[:-1], own[1:], strict=True) for ring in rings for r, s in zip(ring[:-1], ring[1:], strict=True))
            if near <= radius or any(holds(towns[name], p) for p in line):
                want.add((a, name))
                ends = min(to_segment(c, p, q) for p, q in zip(own[:-1], own[1:], strict=True) for ring in rings for c in ring)
                missed_by_corners += ends > radius and not any(holds(towns[name], p) for p in line)
    assert got == want and 0 < len(want) < len(towns) * len(routes) and missed_by_corners > 0


def test_towns_in_areas_touching_nested_and_apart(spark):
    box = lambda x0, y0, x1, y1: f"POLYGON(({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}))"  # noqa: E731  not closed
    towns = spark.createDataFrame([("inner", box(1, 1, 2, 2)), ("outer", box(-9, -9, 19, 19)), ("beside", box(20, 0, 21, 1)), ("corner", box(10, 10, 11, 11)), ("cross", "POLYGON((4 -2, 6 -2, 6 12, 4 12, 4 -2))")], "name string, wkt string")
    areas = spark.createDataFrame([("a", box(0, 0, 10, 10)), ("none", box(50, 50, 51, 51))], "area_id string, wkt string")
    assert sorted(map(tuple, spatial.municipalities_in_areas(towns, areas, 0.7).collect())) == [("a", "corner"), ("a", "cross"), ("a", "inner"), ("a", "outer")]


def test_outlines_agree_with_distances(spark, sf):
    """Outside a band of 1 % of the radius around it, the dissolved outline holds what the corridor does."""
    listings = view(spark, sf, "listings")
    routes = {r.area_id: (plane(numbers(r.wkt)[0]), r.radius) for r in stateful.routes(listings).collect()}
    points = {r.id: plane([(r.longitude, r.latitude)])[0] for r in listings.filter("is_active AND latitude IS NOT NULL").collect()}
    inside = {(r.area_id, r.id) for r in QUERIES["corridor_outline_members"](spark, sf).collect()}
    exact = {(r.area_id, r.id) for r in spatial.corridor_members(listings, stateful.routes(listings)).collect()}
    near, n = set(), 0
    for a, (line, radius) in routes.items():
        for i, p in points.items():
            d = min(to_segment(p, b, c) for b, c in zip(line[:-1], line[1:], strict=True))
            n += d <= radius
            if abs(d - radius) <= 0.01 * radius:
                near.add((a, i))
    assert inside - near == exact - near and n > 10


def test_outline_of_knots():
    """Lines on a grid that cross, meet and go back on themselves: points on both sides of the outline."""
    import random

    rng = random.Random(4)
    for k in range(12):
        line = [(0.0, 0.0)]
        for _ in range(25):
            line.append((line[-1][0] + rng.choice((-500, 0, 500)), line[-1][1] + rng.choice((-500, 0, 500))))
        radius = rng.choice((200.0, 250.0, 500.0))
        found = outline(*zip(*line, strict=True), radius) if len(set(line)) > 1 else []
        rings = [[tuple(p) for p in r] for r in found]
        for _ in range(300):
            p = (rng.uniform(-6000, 6000), rng.uniform(-6000, 6000)) if k % 2 else tuple(c + rng.uniform(-600, 600) for c in rng.choice(line))
            d = min(to_segment(p, a, b) for a, b in zip(line[:-1], line[1:], strict=True))
            if abs(d - radius) > 0.006 * radius:
                assert holds(rings, p) == (d <= radius)
        assert sum(area(r) > 0 for r in found) == 1


def test_display_ring_and_areas_of_outline(spark):
    route = spark.createDataFrame([("r", "LINESTRING(16.0 48.9, 16.2 48.9, 16.2 49.0, 16.0 49.0, 16.0 48.905)", 400.0), ("bad", "LINESTRING(16 49, 17 49)", 1.0), ("point", "LINESTRING(16 49)", 500.0)], "area_id string, wkt string, radius double")
    listings = spark.createDataFrame([("in", 48.9, 16.1, True), ("middle", 48.95, 16.1, True)], "id string, latitude double, longitude double, is_active boolean")
    shapes = {r.area_id: r for r in spatial.build_corridors(route, listings).collect()}
    assert shapes["r"].polygon_wkt.count("(") == 3 and shapes["bad"].polygon_wkt is None and "radius" in shapes["bad"].reason and shapes["point"].polygon_wkt is None
    got = spatial.areas_join(listings, spark.createDataFrame([("r", shapes["r"].polygon_wkt)], "area_id string, wkt string")).select("id").collect()
    assert [r.id for r in got] == ["in"]
    assert spark.range(1).select(F.lit(shapes["r"].listing_count)).first()[0] == 1
