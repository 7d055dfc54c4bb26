"""Searches by place. A box test on the plain columns stands beside the distance, so that file statistics prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import geo


def points(docs: DataFrame, doc: str = "doc", path: str = "point") -> DataFrame:
    """docs with lon and lat of an object {lon, lat} of floats at the path of a JSON column; others are left out."""
    at = f"$.{path}"
    kind = lambda k: F.schema_of_variant(F.try_parse_json(F.get_json_object(doc, f"{at}.{k}")))
    number = lambda k: F.get_json_object(doc, f"{at}.{k}").try_cast("double")
    real = F.lit(True)
    for k in ("lon", "lat"):
        real = real & kind(k).rlike("^(DOUBLE|DECIMAL|FLOAT)") & F.get_json_object(doc, f"{at}.{k}").rlike(r"[.eE]")
    return docs.withColumn("lon", F.when(real, number("lon"))).withColumn("lat", F.when(real, number("lat"))).filter(geo.valid(F.col("lon"), F.col("lat")))


def within_radius(places: DataFrame, lon: float, lat: float, meters: float, *, id_col: str = "id", lon_col: str = "lon", lat_col: str = "lat", limit: int | None = None) -> DataFrame:
    """places no farther than meters, with distance_meters, nearest first, ties by id."""
    if meters < 0:
        raise InvalidInput("a radius is not negative")
    min_lon, min_lat, max_lon, max_lat = geo.box_around(lon, lat, meters)
    x, y = F.col(lon_col), F.col(lat_col)
    near = y.between(min_lat, max_lat) if min_lon is None else geo.in_box(x, y, min_lon, min_lat, max_lon, max_lat)
    out = places.filter(near).withColumn("distance_meters", geo.haversine_m(F.lit(lon), F.lit(lat), x, y)).filter(F.col("distance_meters") <= meters).orderBy("distance_meters", id_col)
    return out if limit is None else out.limit(limit)


def within_bbox(places: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, *, id_col: str = "id", lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """places inside a box, with the distance from its middle, nearest first."""
    geo.check(min_lon, min_lat), geo.check(max_lon, max_lat)
    if min_lat > max_lat:
        raise InvalidInput("the box is upside down")
    x, y = F.col(lon_col), F.col(lat_col)
    middle = F.lit(geo.middle_lon(min_lon, max_lon)), F.lit((min_lat + max_lat) / 2)
    return places.filter(geo.in_box(x, y, min_lon, min_lat, max_lon, max_lat)).withColumn("distance_meters", geo.haversine_m(*middle, x, y)).orderBy("distance_meters", id_col)
