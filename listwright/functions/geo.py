"""Points, boxes, polygons and lines as Columns.

A ring is array<struct<lon double, lat double>>; polygons are arrays of rings, the first the outer one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounding boxes of the two home regions (lat from/to, lon from/to).
REGION_BOX = (48.55, 49.65, 15.5, 17.7)
TOWN_BOX = (48.7, 49.1, 15.7, 16.5)
POINTS = "array<struct<lon:double,lat:double>>"
METRES_PER_DEGREE = 111_000.0


def point(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def in_box(lat: Column, lon: Column, box=REGION_BOX) -> Column:
    """Closed box; rows without coordinates fail."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def in_box_or_unknown(lat: Column, lon: Column, box=REGION_BOX) -> Column:
    return lat.isNull() | lon.isNull() | in_box(lat, lon, box)


def points_of_wkt(wkt: Column) -> Column:
    """All coordinate pairs of a WKT text, in order."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("lon"), F.split(p, r"\s+")[1].cast("double").alias("lat")))


def rings_of_wkt(wkt: Column) -> Column:
    """Rings of all polygons of a POLYGON or MULTIPOLYGON."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(rings, points_of_wkt)


def display_ring(wkt: Column) -> Column:
    """Outer ring of the first polygon as (lat, lon) pairs."""
    return F.transform(F.get(rings_of_wkt(wkt), F.lit(0)), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule; points on the boundary are inside."""
    last = F.size(ring) - 1

    def edge(i):
        a, b = ring[i], F.when(i == 0, ring[last]).otherwise(ring[F.greatest(i - 1, F.lit(0))])
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        on = (cross == 0) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        split = (a["lat"] > lat) != (b["lat"] > lat)
        x = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.struct(on.alias("on"), F.coalesce(split & (lon < x), F.lit(False)).alias("cut"))

    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("cut"))
    got = F.aggregate(F.sequence(F.lit(0), last), start, lambda acc, i: F.struct((acc["on"] | edge(i)["on"]).alias("on"), (acc["cut"] != edge(i)["cut"]).alias("cut")))
    return F.coalesce(got["on"] | got["cut"], F.lit(False))


def sides_of_rings(rings: Column) -> Column:
    """The edges of each ring, the closing one first, as numbers: a test reads each once."""

    def sides(ring):
        before = lambda i: F.when(i == 0, F.element_at(ring, -1)).otherwise(F.get(ring, i - 1))
        return F.transform(ring, lambda a, i: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), before(i)["lon"].alias("x2"), before(i)["lat"].alias("y2")))

    return F.transform(rings, sides)


def in_sides(lon: Column, lat: Column, sides: Column) -> Column:
    """``in_polygon`` by the edges of ``sides_of_rings``; an edge away from the point's latitude costs two comparisons."""

    def on(e):
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
        return lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & (cross == 0)

    def cut(e):
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))

    hits = F.size(F.filter(sides, lambda r: (F.size(F.filter(r, cut)) % 2 == 1) | F.exists(r, on)))
    return F.coalesce(hits % 2 == 1, F.lit(False))


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside an odd number of rings (holes and parts alike), or on a boundary of one."""
    hits = F.size(F.filter(rings, lambda r: in_ring(lon, lat, r)))
    return F.coalesce(hits % 2 == 1, F.lit(False))


def line_wkt(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")"))


def number_text(c: Column) -> Column:
    """The digits that read back to the same double, without ``.0`` after whole numbers."""
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def straight_line(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """LINESTRING between two points; null without one of the coordinates."""
    return F.concat(F.lit("LINESTRING("), number_text(lon1), F.lit(" "), number_text(lat1), F.lit(", "), number_text(lon2), F.lit(" "), number_text(lat2), F.lit(")"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance to a segment in the plane: the foot of the perpendicular, kept between the ends."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - x1 - t * dx, py - y1 - t * dy
    return F.sqrt(ex * ex + ey * ey)


def segments_cross(x1: Column, y1: Column, x2: Column, y2: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Whether two segments have a point in common that is inside both; touching ends are left to the distance."""

    def side(ax, ay, bx, by, px, py):
        return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    return (side(x1, y1, x2, y2, u1, v1) * side(x1, y1, x2, y2, u2, v2) < 0) & (side(u1, v1, u2, v2, x1, y1) * side(u1, v1, u2, v2, x2, y2) < 0)


def segments_distance(x1: Column, y1: Column, x2: Column, y2: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Distance of two segments in the plane: 0 where they cross, else from one of the four ends."""
    ends = F.least(segment_distance(x1, y1, u1, v1, u2, v2), segment_distance(x2, y2, u1, v1, u2, v2), segment_distance(u1, v1, x1, y1, x2, y2), segment_distance(u2, v2, x1, y1, x2, y2))
    return F.when(segments_cross(x1, y1, x2, y2, u1, v1, u2, v2), 0.0).otherwise(ends)


def degrees_of_km(km: float) -> float:
    """The flat fallback: a kilometre is 1/111 of a degree."""
    return km / 111.0


def capsule(x1: float, y1: float, x2: float, y2: float, radius: float, quadrant: int = 8) -> list[tuple[float, float]]:
    """Closed outline of all points within ``radius`` of a segment, ``quadrant`` edges per quarter turn."""
    heading = math.atan2(y2 - y1, x2 - x1)
    steps = 2 * quadrant
    out = [(x + radius * math.cos(heading + turn + i * math.pi / steps), y + radius * math.sin(heading + turn + i * math.pi / steps)) for x, y, turn in ((x2, y2, -math.pi / 2), (x1, y1, math.pi / 2)) for i in range(steps + 1)]
    return [*out, out[0]]
