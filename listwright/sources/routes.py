"""Routes: GPX and GeoJSON texts to points and LINESTRINGs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import POINTS, line_wkt


def _points(gpx: Column, tag: str) -> Column:
    """Coordinates of all elements of a kind, in either order of attributes; out-of-range points go."""
    marks = F.regexp_extract_all(gpx, F.lit(rf"(?s)<{tag}\s([^>]*)>"), F.lit(1))
    number = lambda m, k: F.regexp_extract(m, rf"\b{k}\s*=\s*[\"'](-?[0-9.]+)", 1).try_cast("double")
    pts = F.transform(marks, lambda m: F.struct(number(m, "lon").alias("lon"), number(m, "lat").alias("lat")))
    return F.filter(pts, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))


def gpx_points(gpx: Column, least: int = 2) -> Column:
    """Track points, else route points, else way points; a kind with fewer than ``least`` points is passed over.

    ``least`` 2 suits uploads, 1 the batch loader.
    """
    tracks, routes, ways = (_points(gpx, t) for t in ("trkpt", "rtept", "wpt"))
    return F.when(F.size(tracks) >= least, tracks).when(F.size(routes) >= least, routes).otherwise(ways)


def geojson_points(text: Column) -> Column:
    """LineString or MultiLineString, bare, as a feature, or the first of a collection; incomplete coordinates go."""
    geometry = F.coalesce(F.get_json_object(text, "$.features[0].geometry"), F.get_json_object(text, "$.geometry"), text)
    kind, coords = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    flat = F.when(kind == "LineString", F.from_json(coords, "array<array<double>>")).when(kind == "MultiLineString", F.flatten(F.from_json(coords, "array<array<array<double>>>")))
    points = F.transform(flat, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")))
    return F.filter(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()).cast(POINTS)


def route_points(path: Column, content: Column, least: int = 1) -> Column:
    """By file extension; others are null."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext == ".gpx", gpx_points(content, least)).when(ext.isin(".geojson", ".json"), geojson_points(content))


def routes(files: DataFrame, least: int = 1) -> DataFrame:
    """path, points, wkt, first, last and an error for routes of fewer than two points; ``files``: path, content."""
    out = files.select("path", route_points(F.col("path"), F.col("content"), least).alias("points"))
    ok = F.coalesce(F.size("points") >= 2, F.lit(False))
    return out.select("path", "points", F.when(ok, line_wkt(F.col("points"))).alias("wkt"), F.when(ok, F.col("points")[0]).alias("first"), F.when(ok, F.element_at("points", -1)).alias("last"), F.when(~ok, "a route needs two points").alias("error"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return routes(spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content")))


# Column names under which municipality tables come; the first present is taken.
ALIASES = {"name": ["name", "nazev", "NAZEV", "obec"], "wkt": ["wkt", "geometry", "geom"], "district": ["district", "okres", "NAZ_OKRES"], "region": ["region", "kraj", "NAZ_KRAJ"]}


def municipalities(table: DataFrame) -> DataFrame:
    """name, wkt and, where present, district and region of a converted polygon table."""
    found = {k: next((a for a in names if a in table.columns), None) for k, names in ALIASES.items()}
    if not found["name"] or not found["wkt"]:
        raise ValueError(f"no name or geometry among {table.columns}")
    return table.select(*(F.col(a).alias(k) for k, a in found.items() if a))


def looked_up(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Route lines of (area_id, lat1, lon1, lat2, lon2): known ones by area_id, straight lines for the rest."""
    from ..functions.geo import straight_line

    own = known.select("area_id", F.col("wkt").alias("_w"))
    return pairs.join(own, "area_id", "left").withColumn("wkt", F.coalesce("_w", straight_line(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))))).drop("_w")
