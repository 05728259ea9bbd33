"""Coordinates, ratings, counts and what listing links carry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import blank_to_null, first_group, fold_digits

EARTH_RADIUS_KM = 6371.0


def validate_coordinates(lat: Column, lon: Column) -> Column:
    """struct(latitude, longitude), both NULL unless the pair is usable."""
    la, lo = lat.try_cast("double"), lon.try_cast("double")
    usable = la.between(-90.0, 90.0) & lo.between(-180.0, 180.0) & ~((la == 0.0) & (lo == 0.0))
    return F.struct(
        F.when(usable, F.bround(la, 7)).alias("latitude"),
        F.when(usable, F.bround(lo, 7)).alias("longitude"),
    )


def clean_rating(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & value.between(0.0, 5.0), F.bround(value, 2))


def clean_reviews(c: Column) -> Column:
    value = c.try_cast("int")
    return F.when(value >= 0, value)


def place_id_from_url(c: Column) -> Column:
    slug = F.substring(F.regexp_extract(c, V.PLACE_SLUG, 1), 1, V.PLACE_SLUG_LENGTH)
    return F.coalesce(
        *[first_group(c, p) for p in V.PLACE_ID_PATTERNS],
        F.concat(F.lit("slug_"), blank_to_null(slug)),
    )


def coordinates_from_url(c: Column) -> Column:
    """struct(latitude, longitude); the pin is preferred over the view center."""
    pin, at = "(?U)" + V.PIN_COORDINATES, "(?U)" + V.AT_COORDINATES
    pinned = c.rlike(pin)
    pick = lambda g: fold_digits(F.when(pinned, F.regexp_extract(c, pin, g)).otherwise(F.regexp_extract(c, at, g))).try_cast("double")
    return F.struct(pick(1).alias("latitude"), pick(2).alias("longitude"))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)
