"""Vector arithmetic as Column expressions over array<float>; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    return _fold(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def norm2(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: _d(x) * _d(x)))


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 where a norm is next to nothing."""
    denominator = F.sqrt(norm2(a) * norm2(b))
    return F.when(denominator <= 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / denominator)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))))


def _pairs(a: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(a) / 2).cast("int")))


def hermitian(a: Column, b: Column) -> tuple[Column, Column]:
    """Real and imaginary part of sum conj(a) * b, elements 2i and 2i + 1 being one complex number."""
    at = lambda v, i, k: _d(F.element_at(v, 2 * i - 1 + k))
    real = _fold(F.transform(_pairs(a), lambda i: at(a, i, 0) * at(b, i, 0) + at(a, i, 1) * at(b, i, 1)))
    imaginary = _fold(F.transform(_pairs(a), lambda i: at(a, i, 0) * at(b, i, 1) - at(a, i, 1) * at(b, i, 0)))
    return real, imaginary


def overlap(a: Column, b: Column) -> Column:
    """Projective overlap |<a, b>|^2 / (|a|^2 |b|^2) within [0, 1]."""
    real, imaginary = hermitian(a, b)
    denominator = norm2(a) * norm2(b)
    return F.when(denominator <= 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (real * real + imaginary * imaginary) / denominator)))


def sine_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.lit(1.0) - overlap(a, b))


def chordal_distance(a: Column, b: Column) -> Column:
    return F.sqrt(2.0 * (F.lit(1.0) - F.sqrt(overlap(a, b))))


def phase_alignment(a: Column, b: Column) -> Column:
    real, imaginary = hermitian(a, b)
    size = F.hypot(real, imaginary)
    return F.when(size < 1e-9, F.lit(0.0)).otherwise(real / size)


def normalize(a: Column) -> Column:
    """Non-finite elements count as 0; a vector shorter than 1e-9 becomes zeros."""
    finite = F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(_d(x)) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(_d(x)))
    length = F.sqrt(_fold(F.transform(finite, lambda x: x * x)))
    return F.when(length < 1e-9, F.transform(finite, lambda x: F.lit(0.0))).otherwise(F.transform(finite, lambda x: x / length))


def amplitudes(a: Column) -> Column:
    return F.transform(_pairs(a), lambda i: F.hypot(_d(F.element_at(a, 2 * i - 1)), _d(F.element_at(a, 2 * i))))


def phases(a: Column) -> Column:
    return F.transform(_pairs(a), lambda i: F.atan2(_d(F.element_at(a, 2 * i)), _d(F.element_at(a, 2 * i - 1))))


def from_polar(amplitude: Column, phase: Column) -> Column:
    """Complex vector of amplitudes and phases, as pairs of neighbours."""
    return F.flatten(F.zip_with(amplitude, phase, lambda r, p: F.array(r * F.cos(p), r * F.sin(p))))


def unfold(a: Column, length: Column) -> Column:
    """The real vector of `length` elements that fold() made pairs of."""
    return F.slice(a, F.lit(1), length)


def split_fold(a: Column) -> Column:
    """Real vector as a complex one: the first half real parts, the second half imaginary ones; an odd middle has 0 beside it."""
    half = F.ceil(F.size(a) / 2).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.array(F.get(a, i), F.coalesce(F.get(a, i + half), F.lit(0.0).cast("float")))))


def fold(a: Column) -> Column:
    """Real vector as a complex one: pairs of neighbours, an odd tail with 0."""
    return F.when(F.size(a) % 2 == 1, F.concat(a, F.array(F.lit(0.0).cast("float")))).otherwise(a)


#: name -> score, higher is better.
METRICS = {
    "inner": dot,
    "cosine": cosine,
    "euclidean": lambda a, b: -euclidean(a, b),
    "overlap": overlap,
    "sine": lambda a, b: F.lit(1.0) - sine_distance(a, b),
    "chordal": lambda a, b: F.lit(2.0) - chordal_distance(a, b),
}
