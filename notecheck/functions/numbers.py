"""Distances, rounding and small arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def rounded(x: Column, places: int) -> Column:
    """Half up in plain floating steps, the same in any engine; what lies within a millionth of a half counts as one, so that
    the order of a sum does not matter."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def truthy_or(x: Column, default: float) -> Column:
    """x, or the default where x is null or zero."""
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, p: Params = DEFAULT) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * p.earth_radius_km) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, p: Params = DEFAULT) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2, p) * 1000


def quantity_feasibility(quantity_mt: Column, hours: Column, p: Params = DEFAULT) -> Column:
    """1 inside the pump rates, a ratio outside, 0.5 where unknown."""
    rate = F.try_divide(quantity_mt, hours)
    known = F.when(rate < p.min_pump_rate, F.greatest(F.lit(0.0), rate / p.min_pump_rate)).when(rate > p.max_pump_rate, F.greatest(F.lit(0.0), F.lit(p.max_pump_rate) / rate)).otherwise(1.0)
    return F.when(quantity_mt.isNull() | hours.isNull() | (hours <= 0), 0.5).otherwise(known)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, held to 0..1; 0 where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))), F.lit(0.0))


def geo_cell(lat: Column, lon: Column, degrees: float) -> Column:
    return F.struct(F.floor(lat / degrees).cast("long").alias("y"), F.floor(lon / degrees).cast("long").alias("x"))
