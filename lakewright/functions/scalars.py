"""Dates, numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def parsed_time(c: Column | str, otherwise: Column) -> Column:
    """ISO-8601 with an optional Z, else the given time."""
    return F.coalesce(F.try_to_timestamp(col(c)), otherwise)


def seconds_to_midnight(ts: Column | str) -> Column:
    return F.lit(86400) - F.unix_seconds(F.date_trunc("second", col(ts))) % 86400


def page_count(n: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / per_page))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Half-even, with a whole of zero counted as one."""
    return F.bround(100 * part / F.greatest(whole, F.lit(1)), digits)


def dot(a: Column | str, b: Column | str) -> Column:
    """Scalar product in doubles, in order."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance_to(vector: Column | str, query: list[float]) -> Column:
    """cosine_distance() to a given vector, whose own product is made once."""
    own = 0.0
    for x in query:
        own += float(x) * float(x)
    return 1 - dot(vector, F.array(*[F.lit(float(x)) for x in query])) / F.sqrt(dot(vector, vector) * F.lit(own))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def reciprocal_rank(position: Column, k: int = 60) -> Column:
    """For positions from 0."""
    return 1.0 / (k + 1 + position)


def backoff(attempt: Column, most: int = 30) -> Column:
    return F.least(F.pow(F.lit(2), attempt), F.lit(most)).cast("int")


def megabytes(n: Column) -> Column:
    return F.floor(n / (1024 * 1024))


def utf8_bytes(c: Column | str) -> Column:
    return F.octet_length(col(c))
