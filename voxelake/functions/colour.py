"""Colour arithmetic and colormaps as Column expressions; channels are doubles in [0, 1] or bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Channels = tuple[Column, Column, Column]
# Red, green, blue, alpha.
WHITE, BLACK, RED, GREEN, BLUE, YELLOW, TRANSPARENT = (1, 1, 1, 1), (0, 0, 0, 1), (1, 0, 0, 1), (0, 1, 0, 1), (0, 0, 1, 1), (1, 1, 0, 1), (0, 0, 0, 0)
PURPLISH = (0.8, 0.8, 1.0)


def to_byte(v: Column) -> Column:
    """Truncates and saturates; NaN and null give 0."""
    scaled = F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v) * 255.0
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")


def to_unit(v: Column) -> Column:
    return v.cast("double") / 255.0


def add(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def divide(a: Sequence[Column], by: Column) -> tuple[Column, ...]:
    return tuple(F.try_divide(x, by) for x in a)


def gamma(v: Column, g: float) -> Column:
    """Correction of a byte channel, to [0, 1]."""
    return F.pow(to_unit(v), F.lit(1.0 / g))


def clamp_unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def _ramp(t: Column) -> Column:
    """0 up to -0.75, rising to 1 at -0.25, 1 up to 0.25, falling to 0 at 0.75."""
    return F.when(t <= -0.75, F.lit(0.0)).when(t <= -0.25, (t + 0.75) * 2.0).when(t <= 0.25, F.lit(1.0)).when(t <= 0.75, F.lit(1.0) - (t - 0.25) * 2.0).otherwise(F.lit(0.0))


def jet(value: Column) -> Channels:
    """Red is the ramp half a unit below, blue half a unit above; values are clamped to [0, 1]."""
    t = clamp_unit(value)
    return _ramp(t - 0.5), _ramp(t), _ramp(t + 0.5)


def monochrome(value: Column, rgb: Sequence[float] = PURPLISH) -> Channels:
    """From the colour to black."""
    rest = F.lit(1.0) - clamp_unit(value)
    return rest * float(rgb[0]), rest * float(rgb[1]), rest * float(rgb[2])


COLORMAPS = {"jet": jet, "purplish": monochrome}
