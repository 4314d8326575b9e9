"""Distances on the sphere as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import as_col

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    la1, la2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_lat = F.sin((la2 - la1) / 2)
    half_lon = F.sin((F.radians(as_col(lon2)) - F.radians(as_col(lon1))) / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(half_lat * half_lat + F.cos(la1) * F.cos(la2) * half_lon * half_lon))


def flat_km(lat1, lon1, lat2, lon2) -> Column:
    """Plane approximation for points of one city: degrees times the length of a degree."""
    east = (as_col(lon2) - as_col(lon1)) * F.cos(F.radians((as_col(lat1) + as_col(lat2)) / 2))
    north = as_col(lat2) - as_col(lat1)
    return F.hypot(east, north) * F.lit(KM_PER_DEGREE)


def with_centre_distance(df: DataFrame, centres: dict[str, tuple[float, float]], city: str,
                         lat: str, lon: str, name: str = "distance_to_centre_km") -> DataFrame:
    """Distance to the centre of the row's city; NULL for a city without a centre."""
    dist = F.lit(None).cast("double")
    for key, (clat, clon) in centres.items():
        dist = F.when(F.col(city) == key, haversine_km(lat, lon, F.lit(clat), F.lit(clon))).otherwise(dist)
    return df.withColumn(name, dist)
