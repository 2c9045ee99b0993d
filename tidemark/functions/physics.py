"""Moist-air and wind functions of columns, all inside code generation."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: reference point of the plane fit and kilometres in a degree
LAT0, LON0, KM = 3.0, 101.5, 111.0


def wind_uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward parts of a wind from `direction` degrees."""
    angle = F.radians(direction)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def vapour_pressure(dew_c: Column) -> Column:
    """Vapour pressure in hPa at a dew point in degrees Celsius (Bolton 1980)."""
    return 6.112 * F.exp(17.67 * dew_c / (dew_c + 243.5))


def specific_humidity_surface(dew_c: Column, p_hpa: Column) -> Column:
    e = vapour_pressure(dew_c)
    return 0.622 * e / (p_hpa - e)


def specific_humidity_850(t_c: Column, rh: Column) -> Column:
    e = rh / 100 * vapour_pressure(t_c)
    return 0.622 * e / (850 - 0.378 * e)


def theta_e(t_c: Column, dew_c: Column, p_hpa: Column) -> Column:
    """Equivalent potential temperature in K (Bolton 1980)."""
    t, td = t_c + 273.15, dew_c + 273.15
    e = vapour_pressure(dew_c)
    r = 0.622 * e / (p_hpa - e)
    level = 1.0 / (1.0 / (td - 56.0) + F.log(t / td) / 800.0)
    dry = t * F.pow(1000.0 / (p_hpa - e), 0.2854 * (1 - 0.28 * r))
    return dry * F.exp((3.376 / level - 0.00254) * (r * 1000) * (1 + 0.81 * r))


def phase_sector(pc1: Column, pc2: Column, sectors: int = 8) -> Column:
    """Sector of the phase angle; null without both parts."""
    turn = (F.atan2(pc2, pc1) + F.pi()) / (2 * math.pi / sectors)
    return F.pmod(F.floor(turn).cast("int"), F.lit(sectors))


def plane_slopes(points: Mapping[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """For each point (lat, lon) its weights in the east and north slopes, per km, of a least-squares plane."""
    x = [(lon - LON0) * KM * math.cos(math.radians(LAT0)) for _, lon in points.values()]
    y = [(lat - LAT0) * KM for lat, _ in points.values()]
    inverse = np.linalg.pinv(np.column_stack([np.ones(len(x)), x, y]))
    return {p: (float(inverse[1, k]), float(inverse[2, k])) for k, p in enumerate(points)}


def flux_convergence(df: DataFrame, points: Mapping[str, tuple[float, float]], qu: str, qv: str, time: str = "time", point: str = "point") -> DataFrame:
    """(time, mfc): convergence of the flux (qu, qv), 1e-6 per second; only times at which every point has qu.

    The fit is linear, so it is one sum of fixed weights by time.
    """
    weights = plane_slopes(points)
    east = west = F.lit(None).cast("double")
    for p, (wx, wy) in weights.items():
        east = F.when(F.col(point) == p, wx).otherwise(east)
        west = F.when(F.col(point) == p, wy).otherwise(west)
    slopes = F.sum(east * F.col(qu)) + F.sum(west * F.col(qv))
    inside = df.where(F.col(point).isin(list(points)))
    return inside.groupBy(time).agg((-(slopes / 1000.0) * 1e6).alias("mfc"), F.count(qu).alias("n")).where(F.col("n") == len(points)).drop("n")


def area_mean(df: DataFrame, columns: list[str], winds: list[tuple[str, str, str, str]] = (), time: str = "time") -> DataFrame:
    """Mean over points by time; winds (speed, direction, u, v) are averaged as vectors."""
    parts = {}
    for speed, direction, u, v in winds:
        parts[u], parts[v] = wind_uv(F.col(speed), F.col(direction))
    made = df.withColumns(parts) if parts else df
    return made.groupBy(time).agg(*(F.avg(c).alias(c) for c in [*columns, *parts]))
