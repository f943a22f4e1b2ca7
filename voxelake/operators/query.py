"""The point query: attributes, a location and closed intervals over numeric attributes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.functions.attributes import POSITION, attribute_types

from .geometry import Aabb, AllPoints, CellUnion, Frustum, Location, MercatorRect, Obb

_KINDS = {k.__name__: k for k in (AllPoints, Aabb, Obb, Frustum, MercatorRect, CellUnion)}


def parse_interval(text: str) -> tuple[float, float]:
    """``"lo,hi"``: exactly two numbers, in order."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError(f"an interval is two numbers with a comma, not {text!r}")
    low, high = map(float, parts)
    if not low <= high:
        raise ValueError(f"{low} is above {high}")
    return low, high


def parse_key_value(text: str) -> tuple[str, str]:
    """``"key=value"``, cut at the first ``=``."""
    key, sep, value = text.partition("=")
    if not sep:
        raise ValueError(f"no = in {text!r}")
    return key, value


def within(col: Column, low: float, high: float) -> Column:
    """Closed interval; NaN fails (it would pass no upper bound)."""
    return col.cast("double").between(F.lit(float(low)), F.lit(float(high)))


@dataclass(frozen=True)
class PointQuery:
    """``attributes`` None: all of them. Attributes that intervals name must be among those asked for."""

    attributes: Sequence[str] | None = None
    location: Location = field(default_factory=AllPoints)
    intervals: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def check(self, points: DataFrame) -> list[str]:
        """The attributes to return, after checking names and types."""
        kinds = attribute_types(points)
        wanted = sorted(kinds) if self.attributes is None else list(self.attributes)
        for name in wanted:
            if name not in kinds:
                raise KeyError(f"the cloud has no attribute '{name}'")
        for name in self.intervals:
            if name not in wanted:
                raise ValueError(f"filter attribute '{name}' is not among the attributes asked for")
            if kinds[name].endswith("Vec3"):
                raise ValueError(f"attribute '{name}' is a vector and can't be filtered")
        return wanted

    def condition(self, location: Column | None = None) -> Column:
        """The whole test of a row; ``location`` stands in for the location's own test."""
        x, y, z = (F.col(c) for c in POSITION)
        out = self.location.contains(x, y, z) if location is None else location
        for name, (low, high) in self.intervals.items():
            out = out & within(F.col(name), low, high)
        return out

    def run(self, points: DataFrame) -> DataFrame:
        """The rows of an unindexed cloud: one filter and a projection. Besides the location's test there are
        comparisons with its bounds, which the scan can use to skip row groups."""
        wanted = self.check(points)
        bounds = None if isinstance(self.location, Aabb) else self.location.bounds()
        for c, low, high in zip(POSITION, *bounds, strict=True) if bounds is not None else ():
            points = points.where((F.col(c) >= float(low)) & (F.col(c) <= float(high)))
        return points.where(self.condition()).select(*POSITION, *wanted)

    def to_json(self) -> str:
        where = {"kind": type(self.location).__name__, **asdict(self.location)}
        return json.dumps({"attributes": None if self.attributes is None else list(self.attributes), "location": where, "intervals": {k: list(v) for k, v in self.intervals.items()}})

    @classmethod
    def from_json(cls, text: str) -> PointQuery:
        def frozen(v):
            return tuple(map(frozen, v)) if isinstance(v, list) else v

        d = json.loads(text)
        where = d["location"]
        location = _KINDS[where.pop("kind")](**{k: frozen(v) for k, v in where.items()})
        return cls(d["attributes"], location, {k: tuple(v) for k, v in d["intervals"].items()})
