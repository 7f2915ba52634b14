"""Fixed-point numbers: bigint with 32 fractional bits, saturating at the ends of its range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 1 << 32
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_WIDE = "decimal(38,0)"


def _saturated(x: Column) -> Column:
    return F.when(x > F.lit(HIGH).cast(_WIDE), F.lit(HIGH)).when(x < F.lit(LOW).cast(_WIDE), F.lit(LOW)).otherwise(x.cast("bigint"))


def from_double(x: Column) -> Column:
    """Null for what is not finite or out of range."""
    scaled = x * float(ONE)
    return F.when(F.isnan(x) | (F.abs(scaled) >= float(1 << 63)), F.lit(None)).otherwise(scaled.cast("bigint"))


def to_double(x: Column) -> Column:
    return x.cast("double") / float(ONE)


def add(a: Column, b: Column) -> Column:
    return _saturated(a.cast(_WIDE) + b.cast(_WIDE))


def multiply(a: Column, b: Column) -> Column:
    """Product rounded towards negative infinity, as an arithmetic shift does."""
    return _saturated(F.floor(a.cast("decimal(20,0)") * b.cast("decimal(18,0)") / F.lit(ONE).cast("decimal(10,0)")).cast(_WIDE))


def ratio(a: Column, b: Column) -> Column:
    """a / b of two counts; 0 where b is 0."""
    return F.when(b == 0, F.lit(0)).otherwise(F.floor(a.cast("decimal(20,0)") * ONE / b.cast("decimal(20,0)"))).cast("bigint")
