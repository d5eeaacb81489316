"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def stand_in(text: Column, size: int = 768) -> Column:
    """A vector that depends on nothing but the text: byte i mod 32 of its SHA-256 plus i, folded into [0, 1)."""
    digest = F.sha2(text, 256)
    table = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((F.element_at(table, (i % 32 + 1).cast("int")) + i) % 255 / F.lit(255.0)).cast("float"))
