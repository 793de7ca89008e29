"""Vector algebra on triples of double columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Triple = tuple[Column, Column, Column]


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def lits(values) -> tuple[Column, ...]:
    return tuple(F.lit(float(v)) for v in values)


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Triple, b: Triple) -> Triple:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Triple, b: Triple) -> Triple:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Triple, s: Column) -> Triple:
    return tuple(p * s for p in a)


def cross(a: Triple, b: Triple) -> Triple:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )
