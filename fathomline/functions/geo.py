"""Distances and projections on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Earth radius and the decay of the score, in km.
EARTH_KM = 6371.0
SCORE_DECAY_KM = 150.0


def half_chord_squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column, cos2: Column) -> Column:
    """The haversine of two points, given the cosines of their latitudes."""
    half = F.lit(0.5)
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dlat * half), F.lit(2)) + cos1 * cos2 * F.pow(F.sin(dlon * half), F.lit(2))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    chord = half_chord_squared(lat1, lon1, lat2, lon2, F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    # Rounding may lift a chord past 1; a missing position has to stay missing.
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(chord > 1, F.lit(1.0)).otherwise(chord)))


def polar(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """(r km, angle) around a point; east-west degrees shrink with the latitude."""
    return (
        great_circle_km(lat, lon, F.lit(lat0), F.lit(lon0)),
        F.atan2(lat - F.lit(lat0), (lon - F.lit(lon0)) * F.cos(F.radians(lat))),
    )


def similarity(distance_km: Column) -> Column:
    return F.exp(-distance_km / F.lit(SCORE_DECAY_KM))
