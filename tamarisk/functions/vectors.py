"""Vector and score functions as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one width; 0 if either is zero. Different widths are an error."""
    product = l2_norm(a) * l2_norm(b)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("dimension mismatch: query and index need the same embedding")))
    return checked.otherwise(F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(product == 0, F.lit(1.0)).otherwise(product)))


def saturate(score: Column, scale: float = 4.0) -> Column:
    """Maps a score from [0, inf) to [0, 1); 0 and below give 0."""
    return F.when(score <= 0, F.lit(0.0)).otherwise(score / (F.greatest(score, F.lit(0.0)) + F.lit(float(scale))))


def encode_vector(v) -> bytes:
    """Little-endian 32-bit floats, for import and export."""
    return np.asarray(v, dtype="<f4").tobytes()


def decode_vector(data: bytes) -> list[float]:
    return np.frombuffer(data, dtype="<f4").tolist()
