"""Lattice points, bivectors, phase rotations, regimes and lossy codes of vectors, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i)).cast("double")


def _round_away(x: Column) -> Column:
    """Halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def _coset(v: Column, shift: float, n: int) -> tuple[Column, Column]:
    """(nearest point of the even-sum lattice moved by shift, squared distance): an odd sum moves the worst coordinate."""
    x = [_d(v, i) - shift for i in range(n)]
    r = [_round_away(c) for c in x]
    errors = F.array(*[F.abs(a - b) for a, b in zip(x, r, strict=True)])
    worst = F.array_position(errors, F.array_max(errors)) - 1
    odd = reduce(lambda a, b: a + b, r) % 2 != 0
    point = [F.when(odd & (worst == i), F.when(x[i] >= r[i], r[i] + 1).otherwise(r[i] - 1)).otherwise(r[i]) + shift for i in range(n)]
    distance = reduce(lambda a, b: a + b, [(_d(v, i) - p) * (_d(v, i) - p) for i, p in enumerate(point)])
    return F.array(*point), distance


def e8_nearest(v: Column) -> Column:
    """Nearest point of the E8 lattice to the first eight elements; the integer coset wins ties."""
    whole, dw = _coset(v, 0.0, 8)
    half, dh = _coset(v, 0.5, 8)
    return F.when(dw <= dh, whole).otherwise(half)


def regime(novelty: Column, reversibility: Column) -> Column:
    return F.when(reversibility < 0.2, "critical").when((novelty > 0.8) & (reversibility > 0.8), "curious").otherwise("neutral")


def wedge(a: Column, b: Column, n: int = 8) -> Column:
    """Directed bivector a_i b_j - a_j b_i for i > j, n * (n - 1) / 2 elements."""
    return F.array(*[_d(a, i) * _d(b, j) - _d(a, j) * _d(b, i) for i in range(n) for j in range(i)])


def strength(bivector: Column) -> Column:
    return F.sqrt(F.aggregate(bivector, F.lit(0.0), lambda s, x: s + x * x))


def contract(bivector: Column, v: Column, n: int = 8) -> Column:
    """Vector that a bivector (as wedge() lays it out) makes of v."""
    place = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i))}
    part = lambda i: reduce(lambda s, x: s + x, [(F.get(bivector, F.lit(place[i, j])) if i > j else -F.get(bivector, F.lit(place[j, i]))) * _d(v, j) for j in range(n) if j != i])
    return F.array(*[part(i) for i in range(n)])


def phase_shift(v: Column, angle: Column, n: int) -> Column:
    """Rotates every complex component (elements 2i, 2i + 1) of the first n by an angle."""
    c, s = F.cos(angle), F.sin(angle)
    return F.array(*[x for i in range(0, n, 2) for x in (_d(v, i) * c - _d(v, i + 1) * s, _d(v, i) * s + _d(v, i + 1) * c)])


def quantize_polar(v: Column) -> Column:
    """array<struct<a, p>>: amplitude in 255 steps of the largest one, phase in 256 steps of the circle."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1)
    at = lambda i, k: F.get(v, 2 * i + k).cast("double")
    size = F.transform(pairs, lambda i: F.hypot(at(i, 0), at(i, 1)))
    most = F.greatest(F.array_max(size), F.lit(1e-12))
    turn = 2 * 3.141592653589793
    return F.transform(pairs, lambda i: F.struct(F.round(F.get(size, i) / most * 255).cast("int").alias("a"), (F.round((F.atan2(at(i, 1), at(i, 0)) + turn) / turn * 256) % 256).cast("int").alias("p")))


def dequantize_polar(codes: Column, most: Column) -> Column:
    turn = 2 * 3.141592653589793
    part = lambda c: F.array(*[f(c["p"] / 256.0 * turn) * c["a"] / 255.0 * most for f in (F.cos, F.sin)])
    return F.flatten(F.transform(codes, part))


def blade_sign(a: Column, b: Column, dimensions: int = 8) -> Column:
    """Sign of the product of two basis blades given as bit masks: parity of the swaps that sort it."""
    swaps = reduce(lambda s, x: s + x, [F.when(F.shiftright(b, k).bitwiseAND(F.lit(1)) == 1, F.bit_count(F.shiftright(a, k + 1))).otherwise(0) for k in range(dimensions)])
    return F.when(swaps % 2 == 0, 1.0).otherwise(-1.0)
