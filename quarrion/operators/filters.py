"""A filter algebra that compiles to one Column, so that filters reach the scan.

    And(Eq("tenant", "a"), Not(In("label", [1, 2])), Range("rating", 3, 7))
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import in_polygon, within_km


class Filter:
    def column(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Eq(Filter):
    field: str
    value: object

    def column(self) -> Column:
        return F.col(self.field) == F.lit(self.value)


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: list = field(default_factory=list)

    def column(self) -> Column:
        return F.col(self.field).isin(list(self.values)) if self.values else F.lit(False)


@dataclass(frozen=True)
class Range(Filter):
    """Both ends belong to it; None leaves an end open."""

    field: str
    low: object = None
    high: object = None

    def column(self) -> Column:
        out = F.col(self.field).isNotNull()
        if self.low is not None:
            out = out & (F.col(self.field) >= F.lit(self.low))
        return out & (F.col(self.field) <= F.lit(self.high)) if self.high is not None else out


@dataclass(frozen=True)
class GeoRadius(Filter):
    lat: str
    lon: str
    centre: tuple[float, float]
    km: float

    def column(self) -> Column:
        return within_km(F.col(self.lat), F.col(self.lon), self.centre, self.km)


@dataclass(frozen=True)
class GeoWithin(Filter):
    lat: str
    lon: str
    ring: tuple

    def column(self) -> Column:
        return in_polygon(F.col(self.lat), F.col(self.lon), list(self.ring))


class And(Filter):
    """Nothing to satisfy matches nothing."""

    def __init__(self, *parts: Filter):
        self.parts = parts

    def column(self) -> Column:
        return reduce(and_, (p.column() for p in self.parts)) if self.parts else F.lit(False)


class Or(Filter):
    def __init__(self, *parts: Filter):
        self.parts = parts

    def column(self) -> Column:
        return reduce(or_, (p.column() for p in self.parts)) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    """Rows for which the part is false or unknown."""

    part: Filter

    def column(self) -> Column:
        return ~F.coalesce(self.part.column(), F.lit(False))


def matches(expected: dict[str, str]) -> Column:
    """All fields equal the given values, as text."""
    return reduce(and_, (F.col(k).cast("string") == F.lit(str(v)) for k, v in expected.items()), F.lit(True))


def row_security(tenant_column: str, tenant: str) -> Column:
    """Rows of one tenant; a missing tenant hides the row."""
    return F.coalesce(F.col(tenant_column) == F.lit(tenant), F.lit(False))
