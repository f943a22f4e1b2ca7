"""WGS84, ECEF, local frames and web mercator: Column expressions and numpy twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, the radii of points near its surface, the mercator bounds.
A = 6378137.0
E2 = 0.0066943799901413165
B = A * math.sqrt(1 - E2)
EP2 = E2 / (1 - E2)
MIN_RADIUS_M, MAX_RADIUS_M = 6_352_800.0, 6_384_400.0
LAT_BOUND_RAD = 1.4844222297453324
LAT_BOUND_SIN = 0.99627207622075
TILE_SIZE, MAX_ZOOM = 256, 23


# --- Columns ----------------------------------------------------------------------------------


def ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """ECEF metres from radians and metres."""
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * F.lit(1 - E2) + height) * F.sin(lat)


def latitude_longitude(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Radians from ECEF: Bowring's closed form, exact to a billionth of a degree near the surface."""
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * F.lit(A), p * F.lit(B))
    lat = F.atan2(z + F.lit(EP2 * B) * F.pow(F.sin(t), F.lit(3.0)), p - F.lit(E2 * A) * F.pow(F.cos(t), F.lit(3.0)))
    return lat, F.atan2(y, x)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Normalised map position, 0 to 1 on both axes, of radians; latitude is clamped to the map."""
    s = F.sin(F.greatest(F.lit(-LAT_BOUND_RAD), F.least(F.lit(LAT_BOUND_RAD), lat)))
    return F.lit(0.5) + lon / F.lit(2 * math.pi), F.lit(0.5) - F.ln((1 + s) / (1 - s)) / F.lit(4 * math.pi)


def unmercator(mx: Column, my: Column) -> tuple[Column, Column]:
    """Latitude and longitude in radians of a normalised map position, at height 0."""
    e = F.exp((F.lit(0.5) - my) * F.lit(4 * math.pi))
    s = 1 - F.lit(2.0) / (e + 1)
    s = F.greatest(F.lit(-LAT_BOUND_SIN), F.least(F.lit(LAT_BOUND_SIN), s))
    lon = F.greatest(F.lit(-math.pi), F.least(F.lit(math.pi), (mx - 0.5) * F.lit(2 * math.pi)))
    return F.asin(s), lon


def zoomed(m: Column, zoom: int) -> Column:
    """Map pixels at a zoom level; null beyond the last level."""
    return m * float(TILE_SIZE << zoom) if 0 <= zoom <= MAX_ZOOM else F.lit(None).cast("double")


def unzoomed(px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    """Normalised position of map pixels; null unless both lie on the map of that level."""
    if not 0 <= zoom <= MAX_ZOOM:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    size = float(TILE_SIZE << zoom)
    inside = (px >= 0) & (py >= 0) & (px < size) & (py < size)
    return F.when(inside, px / size), F.when(inside, py / size)


def valid_radius(x: Column, y: Column, z: Column) -> Column:
    """Whether an ECEF point lies near the Earth's surface."""
    r = F.sqrt(x * x + y * y + z * z)
    return (r >= MIN_RADIUS_M) & (r <= MAX_RADIUS_M)


# --- numpy ------------------------------------------------------------------------------------


def ecef_np(lat, lon, height) -> np.ndarray:
    lat, lon, height = (np.asarray(v, float) for v in (lat, lon, height))
    n = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
    return np.stack([(n + height) * np.cos(lat) * np.cos(lon), (n + height) * np.cos(lat) * np.sin(lon), (n * (1 - E2) + height) * np.sin(lat)], -1)


def latitude_longitude_np(p) -> np.ndarray:
    p = np.asarray(p, float)
    r = np.hypot(p[..., 0], p[..., 1])
    t = np.arctan2(p[..., 2] * A, r * B)
    lat = np.arctan2(p[..., 2] + EP2 * B * np.sin(t) ** 3, r - E2 * A * np.cos(t) ** 3)
    return np.stack([lat, np.arctan2(p[..., 1], p[..., 0])], -1)


def unmercator_np(mx: float, my: float) -> tuple[float, float]:
    s = 1 - 2 / (math.exp((0.5 - my) * 4 * math.pi) + 1)
    return math.asin(max(-LAT_BOUND_SIN, min(LAT_BOUND_SIN, s))), max(-math.pi, min(math.pi, (mx - 0.5) * 2 * math.pi))


def local_frame(lat: float, lon: float) -> np.ndarray:
    """4 x 4: local east, north, up metres at a point of the surface, from ECEF metres."""
    sa, ca, so, co = math.sin(lat), math.cos(lat), math.sin(lon), math.cos(lon)
    rotation = np.array([[-so, co, 0], [-sa * co, -sa * so, ca], [ca * co, ca * so, sa]])
    out = np.eye(4)
    out[:3, :3] = rotation
    out[:3, 3] = -rotation @ ecef_np(lat, lon, 0.0)
    return out
