"""Column builders for vectors: arrays of floats, sums in double precision."""

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


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


@F.pandas_udf(T.BinaryType())
def to_half(vectors: pd.Series) -> pd.Series:
    """Half-precision bytes of a vector, as a cache keeps them (Spark has no such type)."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float16).tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, np.float16).astype(np.float32).tolist())
