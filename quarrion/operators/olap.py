"""Column aggregates, with a similarity mask if wanted, and sparse multidimensional arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregates(value: str) -> list[Column]:
    """Nulls are skipped; the variance of fewer than two values is 0."""
    x = F.col(value).cast("double")
    return [F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance")]


def aggregate(rows: DataFrame, value: str, mask: Column | None = None) -> DataFrame:
    return (rows if mask is None else rows.where(mask)).agg(*aggregates(value))


def running_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, m2, stddev)."""
    x = F.col(value).cast("double")
    return rows.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias("m2"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"))


def morton(coords: list[Column], bits: int) -> Column:
    """Index that interleaves the bits of the coordinates, the first one lowest; bits * len(coords) <= 63."""
    out = F.lit(0).cast("bigint")
    for bit in range(bits):
        for d, c in enumerate(coords):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("bigint"), bit).bitwiseAND(F.lit(1)), bit * len(coords) + d))
    return out


def unmorton(index: Column, dimensions: int, bits: int) -> list[Column]:
    out = []
    for d in range(dimensions):
        c = F.lit(0).cast("bigint")
        for bit in range(bits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(index, bit * dimensions + d).bitwiseAND(F.lit(1)), bit))
        out.append(c)
    return out


class Cube:
    """Sparse array: cells (coords array<int>, value) within a shape."""

    def __init__(self, cells: DataFrame, shape: list[int]):
        self.cells, self.shape = cells, shape

    def inside(self) -> Column:
        out = F.size("coords") == len(self.shape)
        for d, n in enumerate(self.shape):
            out = out & F.get("coords", F.lit(d)).between(0, n - 1)
        return out

    def get(self, coords: list[int]) -> DataFrame:
        return self.cells.where(F.col("coords") == F.array(*[F.lit(c) for c in coords]))

    def set(self, changes: DataFrame) -> Cube:
        """Cells of changes replace those at the same place; places outside the shape are an error when read."""
        checked = changes.withColumn("value", F.when(self.inside(), F.col("value")).otherwise(F.raise_error("outside the shape")))
        return Cube(self.cells.join(changes.select("coords"), "coords", "left_anti").unionByName(checked), self.shape)

    def box(self, low: list[int], high: list[int]) -> DataFrame:
        """Cells within both corners, which belong to the box."""
        wanted = F.lit(True)
        for d, (a, b) in enumerate(zip(low, high, strict=True)):
            wanted = wanted & F.get("coords", F.lit(d)).between(a, b)
        return self.cells.where(wanted)

    def clustered(self, bits: int = 16) -> DataFrame:
        """Cells with their Morton index, near ones in the same files."""
        index = morton([F.get("coords", F.lit(d)) for d in range(len(self.shape))], bits)
        return self.cells.withColumn("morton", index).repartitionByRange("morton").sortWithinPartitions("morton")

    @property
    def volume(self) -> int:
        out = 1
        for n in self.shape:
            out *= n
        return out

    @property
    def strides(self) -> list[int]:
        out = [1]
        for n in self.shape[:0:-1]:
            out.append(out[-1] * n)
        return out[::-1]
