"""What the operators on embedding vectors share: which vectors take part, and matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Is a vector not null, not empty, and free of null and non-finite entries?"""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def usable(vectors: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """(the rows whose vector is finite and has the commonest length, that length). Vectors of other lengths than most have no
    products with them; of two lengths as common the longer counts. No rows: length 0."""
    good = vectors.where(finite(F.col(vec_col)))
    most = good.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most.d if most else 0
    return good.where(F.size(vec_col) == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column without nulls, all of length d, as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)
