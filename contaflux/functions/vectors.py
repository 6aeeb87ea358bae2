"""Vectors: cosine, hashed term frequencies, Hamming distance, row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def token_bucket(token: Column) -> Column:
    """The second byte of the token's SHA-1, 0 to 255."""
    return F.conv(F.substring(F.sha1(token.cast("binary")), 3, 2), 16, 10).cast("int")


def hamming(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(F.slice(pairs, 1, F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda s, x: s + x) / F.length(a)


def row_hash(date: Column, amount: Column, description: Column, reference: Column) -> Column:
    """SHA-256 of the ISO date, the amount with two decimals and the trimmed texts, joined by bars."""
    parts = F.concat_ws("|", F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.format_string("%.2f", amount), F.trim(description), F.coalesce(F.trim(reference), F.lit("")))
    return F.sha2(parts, 256)


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), payload), 256)
