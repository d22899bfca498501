"""Vectors as arrays of numbers: decoding, truncation, norms and cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def truncated(a: Column, dims: int) -> Column:
    return F.slice(a, 1, dims)


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Zero for a zero vector, null for vectors of different dimension."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(s: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null for blobs of another length."""
    return s.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)


def from_json_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def fake_embedding(c: Column, dims: int = 8) -> Column:
    """A deterministic vector of a text: bytes of its SHA-256, centred and of length one."""
    digest = F.sha2(c, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.conv(F.substr(digest, k * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return unit(raw)
