"""Vector arithmetic on array<float> columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the shorter vector counts as padded with nulls, so lengths must agree."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    norm = F.greatest(l2_norm(v), F.lit(least))
    return F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))


def closeness(a: Column, b: Column) -> Column:
    """struct(cosine, most): cosine of two vectors and their greatest difference at one place."""
    norms = F.greatest(l2_norm(a) * l2_norm(b), F.lit(1e-12))
    most = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    return F.struct((dot(a, b) / norms).alias("cosine"), most.alias("most"))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; zeros where none is."""
    size = F.size(vectors[0])
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), size), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))


@F.pandas_udf(BinaryType())
def half_bytes(s: pd.Series) -> pd.Series:
    """Half-precision bytes of a vector, as matrix files store a row."""
    return s.map(lambda v: None if v is None else np.asarray(v, np.float16).tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_half_bytes(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else np.frombuffer(b, np.float16).astype(np.float32))
