"""Area and corridor searches by grid-cell joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, krovak, outline
from ..shared import dealt
from .search import all_of

MAP_POINTS = 2000
#: Rows of one place, or areas of one class, that are tested together.
LIST = 256
MAP_COLUMNS = ["id", "title", "price", "latitude", "longitude", "property_type", "offer_type", "location_text", "source_code"]


def map_points(listings: DataFrame, main: DataFrame, limit: int = MAP_POINTS) -> DataFrame:
    """Ten columns for the map, active listings with coordinates, at most ``limit`` in id order."""
    own = listings.filter("is_active AND latitude IS NOT NULL AND longitude IS NOT NULL").orderBy("id").limit(limit)
    return own.join(main.withColumnRenamed("listing_id", "_m"), F.col("id") == F.col("_m"), "left").select(*MAP_COLUMNS, "main_photo_url")


def extra_filters(property_type: str | None = None, offer_type: str | None = None, price_min=None, price_max=None) -> Column:
    """Exact, case-sensitive."""
    p = [F.col(c) == v for c, v in (("property_type", property_type), ("offer_type", offer_type)) if v]
    p += [F.col("price") >= price_min] if price_min is not None else []
    p += [F.col("price") <= price_max] if price_max is not None else []
    return all_of(p)


def in_box(listings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return listings.filter(geo.in_box(F.col("latitude"), F.col("longitude"), box))


def in_area(listings: DataFrame, wkt: str) -> DataFrame:
    """Listings in one polygon given as WKT."""
    rings = geo.rings_of_wkt(F.lit(wkt))
    return listings.filter(geo.in_polygon(F.col("longitude"), F.col("latitude"), rings))


def _cells(x0: Column, x1: Column, size: float) -> Column:
    return F.sequence(F.floor(x0 / size), F.floor(x1 / size))


def classes(df: DataFrame, key: str, name: str, *shape: str) -> tuple[DataFrame, DataFrame]:
    """(key, name) and (name, shape): keys of equal shapes form a class, and a class with all its shapes goes on alone."""
    own = df.filter(F.col(shape[0]).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*shape))).alias("_shapes")).withColumn(name, F.sha2(F.to_json("_shapes"), 256))
    return own.select(key, name), own.groupBy(name).agg(F.first("_shapes").alias("_shapes")).select(name, F.explode("_shapes").alias("_s")).select(name, "_s.*")


def areas_join(listings: DataFrame, areas: DataFrame, cell: float = 0.05) -> DataFrame:
    """listing rows x (area_id): points in polygons ``areas`` (area_id, wkt); the listings' columns all travel."""
    return _members_in(listings, *classes(areas, "area_id", "_area", "wkt"), cell)


def outlines_join(listings: DataFrame, routes: DataFrame, cell: float = 0.05) -> DataFrame:
    """listing rows x (area_id): points in the dissolved outlines of ``routes`` (area_id, wkt, radius).

    The routes form classes before they are outlined, so the outlines' long texts stay with few rows.
    """
    members, lines = classes(routes, "area_id", "_area", "wkt", "radius")
    shapes = corridor_shapes(lines.withColumnRenamed("_area", "area_id")).select(F.col("area_id").alias("_area"), F.col("polygon_wkt").alias("wkt"))
    return _members_in(listings, members, shapes, cell)


def _members_in(listings: DataFrame, members: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """Listing rows x (area_id) of ``members`` (area_id, _area) whose ``shapes`` (_area, wkt) hold them.

    Places and shapes are compared as lists of LIST rows that share them: both sides meet on grid cells (an equi
    join), the exact test runs there, and what meets unfolds in place.  Only the lists are exchanged, never pairs.
    """
    points = listings.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumns({"_cx": F.floor(F.col("longitude") / cell), "_cy": F.floor(F.col("latitude") / cell)})
    at = ["_cx", "_cy", "latitude", "longitude"]
    place = F.row_number().over(Window.partitionBy(*at).orderBy("id"))
    rows = dealt(points, "_cx", "_cy").withColumn("_list", F.floor((place - 1) / LIST)).groupBy(*at, "_list").agg(F.collect_list(F.struct(*listings.columns)).alias("_rows"))
    tiles = _tiles(shapes.filter("wkt IS NOT NULL"), "_area", cell).groupBy("_area", "_cx", "_cy").agg(F.collect_list("_sides").alias("_shapes"))
    nth = F.row_number().over(Window.partitionBy("_area").orderBy("area_id"))
    lists = members.withColumn("_list", F.floor((nth - 1) / LIST)).groupBy("_area", "_list").agg(F.collect_list("area_id").alias("_areas")).drop("_list")
    held = F.exists("_shapes", lambda s: geo.in_sides(F.col("longitude"), F.col("latitude"), s))
    met = rows.join(dealt(tiles.join(lists, "_area"), "_cx", "_cy"), ["_cx", "_cy"]).filter(held)
    return met.select("_rows", F.explode("_areas").alias("area_id")).select(F.inline("_rows"), "area_id")


def _tiles(areas: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, _sides, _cx, _cy): the grid cells that the box of each of ``areas`` (key, wkt) meets."""
    rings = areas.select(key, geo.rings_of_wkt(F.col("wkt")).alias("_rings"))
    ends = F.flatten("_rings")
    lons, lats = F.transform(ends, lambda p: p["lon"]), F.transform(ends, lambda p: p["lat"])
    boxes = rings.select(key, geo.sides_of_rings(F.col("_rings")).alias("_sides"), _cells(F.array_min(lons), F.array_max(lons), cell).alias("_cxs"), _cells(F.array_min(lats), F.array_max(lats), cell).alias("_cys"))
    return boxes.select(key, "_sides", F.explode("_cxs").alias("_cx"), "_cys").select(key, "_sides", "_cx", F.explode("_cys").alias("_cy"))


def _places_in(listings: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    points = listings.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumns({"_cx": F.floor(F.col("longitude") / cell), "_cy": F.floor(F.col("latitude") / cell)})
    return dealt(points, "_cx", "_cy").join(dealt(_tiles(areas, "area_id", cell), "_cx", "_cy"), ["_cx", "_cy"]).filter(geo.in_sides(F.col("longitude"), F.col("latitude"), F.col("_sides"))).drop("_cx", "_cy", "_sides")


def segments(routes: DataFrame) -> DataFrame:
    """(area_id, radius, x1, y1, x2, y2) in metres, of ``routes`` (area_id, wkt, radius)."""
    pts = routes.select("area_id", "radius", F.posexplode(geo.points_of_wkt(F.col("wkt"))).alias("k", "p"))
    flat = pts.select("area_id", "radius", "k", krovak.to_plane(F.col("p.lat"), F.col("p.lon")).alias("q")).select("area_id", "radius", "k", "q.x", "q.y")
    nxt = flat.select(F.col("area_id").alias("_a"), (F.col("k") - 1).alias("_k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return flat.join(nxt, (F.col("area_id") == F.col("_a")) & (F.col("k") == F.col("_k"))).select("area_id", "radius", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def corridor_members(listings: DataFrame, routes: DataFrame, cell: float = 5000.0) -> DataFrame:
    """(area_id, id) of active listings within ``radius`` metres of a route: exact round-capped buffers."""
    members, own_routes = classes(routes, "area_id", "_area", "wkt", "radius")
    own = listings.filter("is_active AND latitude IS NOT NULL AND longitude IS NOT NULL").select("id", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"))
    places = own.select("_y", "_x").distinct()
    seg = segments(own_routes.withColumnRenamed("_area", "area_id"))
    tiles = seg.withColumn("_cx", F.explode(_cells(F.least("x1", "x2") - F.col("radius"), F.greatest("x1", "x2") + F.col("radius"), cell)))
    tiles = tiles.withColumn("_cy", F.explode(_cells(F.least("y1", "y2") - F.col("radius"), F.greatest("y1", "y2") + F.col("radius"), cell)))
    pts = places.select("_y", "_x", krovak.to_plane(F.col("_y"), F.col("_x")).alias("q")).select("_y", "_x", F.col("q.x").alias("px"), F.col("q.y").alias("py")).withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    near = geo.segment_distance(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))) <= F.col("radius")
    met = dealt(pts, "_cx", "_cy").join(dealt(tiles, "_cx", "_cy"), ["_cx", "_cy"]).filter(near).select(F.col("area_id").alias("_area"), "_y", "_x").distinct()
    return met.join(members, "_area").join(own, ["_y", "_x"]).select("area_id", "id").distinct()


def corridor_counts(listings: DataFrame, routes: DataFrame) -> DataFrame:
    """Every corridor with its number of listings, 0 included."""
    n = corridor_members(listings, routes).groupBy("area_id").agg(F.count("*").alias("n"))
    return routes.select("area_id").join(n, "area_id", "left").select("area_id", F.coalesce("n", F.lit(0)).alias("listing_count"))


def buffer_wkt(points: Column, radius: Column) -> Column:
    """POLYGON or MULTIPOLYGON around a line; null for lines of fewer than two points."""

    def run(lines: pd.Series, radii: pd.Series) -> pd.Series:
        return pd.Series([outlined(p, r) for p, r in zip(lines, radii, strict=True)], dtype=object)

    # As a fixed function it would be called by filters too, on all rows, below the step that makes them distinct.
    return F.pandas_udf(run, "string").asNondeterministic()(points, radius)


def outlined(points, radius) -> str | None:
    """The dissolved buffer of a line as WKT: outer rings with their holes."""
    if points is None or len(points) < 2:
        return None
    x, y = krovak.to_plane_np([p["lat"] for p in points], [p["lon"] for p in points])
    found = outline.outline(x, y, radius)
    parts = [[ring] for ring in found if outline.area(ring) > 0]
    for hole in (ring for ring in found if outline.area(ring) < 0):
        next((p for p in parts if outline.encloses(p[0], hole)), parts[0]).append(hole)
    texts = []
    for part in parts:
        shown = []
        for ring in part:
            lat, lon = krovak.to_degrees_np(*outline.densified(ring).T)
            shown.append("(" + ", ".join(f"{a:.9f} {b:.9f}" for a, b in zip(lon, lat, strict=True)) + ")")
        texts.append("(" + ", ".join(shown) + ")")
    return f"POLYGON{texts[0]}" if len(texts) == 1 else "MULTIPOLYGON(" + ", ".join(texts) + ")"


def build_corridors(routes: DataFrame, listings: DataFrame, smallest: float = 100.0, largest: float = 50_000.0) -> DataFrame:
    """area_id, polygon_wkt, listing_count; radii outside the limits are refused (null polygon, reason)."""
    return corridor_shapes(routes, smallest, largest).join(corridor_counts(listings, routes.filter(F.col("radius").between(smallest, largest))), "area_id", "left")


def corridor_shapes(routes: DataFrame, smallest: float = 100.0, largest: float = 50_000.0) -> DataFrame:
    """area_id, polygon_wkt, reason; equal routes are outlined once."""
    ok = F.col("radius").between(smallest, largest)
    lines = routes.filter(ok & F.col("wkt").isNotNull()).select("wkt", "radius").distinct()
    outlines = dealt(lines).withColumn("polygon_wkt", buffer_wkt(geo.points_of_wkt(F.col("wkt")), F.col("radius")))
    return routes.join(outlines, ["wkt", "radius"], "left").select("area_id", "polygon_wkt", F.when(~ok, F.format_string("radius must be %.0f to %.0f m", F.lit(smallest), F.lit(largest))).alias("reason"))


def _cover(x1: Column, y1: Column, x2: Column, y2: Column, grow: Column, cell: float) -> Column:
    """Grid cells (cx, cy) within ``grow`` of a segment: per column of cells only the rows that its part there needs."""
    left, right = F.least(x1, x2), F.greatest(x1, x2)

    def rows(cx: Column) -> Column:
        a, b = F.greatest(left, cx * cell - grow), F.least(right, (cx + 1) * cell + grow)
        at = lambda x: y1 + (x - x1) / F.nullif(x2 - x1, F.lit(0.0)) * (y2 - y1)
        ya, yb = F.coalesce(at(a), y1), F.coalesce(at(b), y2)
        return F.transform(F.sequence(F.floor((F.least(ya, yb) - grow) / cell), F.floor((F.greatest(ya, yb) + grow) / cell)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor((left - grow) / cell), F.floor((right + grow) / cell)), rows))


def _edges(points: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b")))


def _closed(ring: Column) -> Column:
    return F.when(F.get(ring, F.size(ring) - 1) == F.get(ring, F.lit(0)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _in_plane(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, x1, y1, x2, y2) in metres of ``edges`` (keys, e: struct of two points)."""
    both = edges.filter("e.b IS NOT NULL").select(*keys, krovak.to_plane(F.col("e.a.lat"), F.col("e.a.lon")).alias("p"), krovak.to_plane(F.col("e.b.lat"), F.col("e.b.lon")).alias("q"))
    return both.select(*keys, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def _near_edges(left: DataFrame, right: DataFrame, reach: Column, cell: float) -> DataFrame:
    """Rows of both sides whose segments (x1..y2; u1..v2) lie within ``reach``, a column of the left: an equi-join on cells, then the exact distance."""
    own = left.withColumn("_c", F.explode(_cover(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), reach, cell))).select("*", "_c.cx", "_c.cy").drop("_c")
    other = right.withColumn("_c", F.explode(_cover(*(F.col(c) for c in ("u1", "v1", "u2", "v2")), F.lit(0.0), cell))).select("*", "_c.cx", "_c.cy").drop("_c")
    return dealt(own, "cx", "cy").join(dealt(other, "cx", "cy"), ["cx", "cy"]).filter(geo.segments_distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2"))) <= reach)


def _turned(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})


def municipalities_in_corridors(municipalities: DataFrame, routes: DataFrame, region: str | None = None, district: str | None = None, cell: float = 5000.0) -> DataFrame:
    """(area_id, name) of municipality polygons (name, wkt, region, district) that a corridor meets.

    They meet where an edge is within the radius of a route segment, or where the route lies inside; a polygon
    inside the corridor has edges within the radius.  Filters on absent columns are ignored.
    """
    own = municipalities
    for column, value in (("region", region), ("district", district)):
        if value and column in own.columns:
            own = own.filter(F.col(column) == value)
    names, own = classes(own, "name", "_town", "wkt")
    areas, lines = classes(routes, "area_id", "_area", "wkt", "radius")
    own, routes = own.withColumnRenamed("_town", "name"), lines.withColumnRenamed("_area", "area_id")
    sides = own.select("name", F.explode(geo.rings_of_wkt(F.col("wkt"))).alias("r")).select("name", F.explode(_edges(_closed(F.col("r")))).alias("e"))
    touched = _near_edges(segments(routes), _turned(_in_plane(sides, "name")), F.col("radius"), cell).select("area_id", "name")
    stops = routes.select(F.col("area_id").alias("id"), F.explode(geo.points_of_wkt(F.col("wkt"))).alias("p")).select("id", F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"))
    inside = _corners_in(stops, own.select(F.col("name").alias("area_id"), "wkt")).select(F.col("id").alias("area_id"), F.col("area_id").alias("name"))
    return _of_classes(touched.unionByName(inside).distinct(), areas, names)


def _corners_in(corners: DataFrame, areas: DataFrame, cell: float = 0.05) -> DataFrame:
    return _places_in(corners, areas, cell).select("id", "area_id")


def _of_classes(met: DataFrame, areas: DataFrame, names: DataFrame) -> DataFrame:
    """(area_id, name) of classes that meet; neither side repeats a key, so no pair comes twice."""
    rows = met.select(F.col("area_id").alias("_area"), F.col("name").alias("_town")).join(areas, "_area").select("area_id", "_town")
    return dealt(rows, "_town").join(dealt(names, "_town"), "_town").select("area_id", "name")


def municipalities_in_areas(municipalities: DataFrame, areas: DataFrame, cell: float = 0.05) -> DataFrame:
    """(area_id, name) of municipality polygons (name, wkt) and areas (area_id, wkt) that share a point.

    Edges that meet, or a corner of either inside the other.
    """

    def sides(df: DataFrame, key: str) -> DataFrame:
        e = df.select(key, F.explode(geo.rings_of_wkt(F.col("wkt"))).alias("r")).select(key, F.explode(_edges(_closed(F.col("r")))).alias("e")).filter("e.b IS NOT NULL")
        return e.select(key, F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))

    def corners(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.explode(F.flatten(geo.rings_of_wkt(F.col("wkt")))).alias("p")).select("id", F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"))

    names, own = classes(municipalities, "name", "_town", "wkt")
    keys, shapes = classes(areas, "area_id", "_area", "wkt")
    municipalities, areas = own.withColumnRenamed("_town", "name"), shapes.withColumnRenamed("_area", "area_id")
    touched = _near_edges(sides(areas, "area_id"), _turned(sides(municipalities, "name")), F.lit(0.0), cell).select("area_id", "name")
    towns = municipalities.select(F.col("name").alias("area_id"), "wkt")
    within = _corners_in(corners(areas, "area_id"), towns, cell).select(F.col("id").alias("area_id"), F.col("area_id").alias("name"))
    around = _corners_in(corners(municipalities, "name"), areas.select("area_id", "wkt"), cell).select("area_id", F.col("id").alias("name"))
    return _of_classes(touched.unionByName(within).unionByName(around).distinct(), keys, names)


def map_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"))
