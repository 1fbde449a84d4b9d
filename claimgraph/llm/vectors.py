"""Vectors that take part in a search or a join, equal ones under one key, and their bytes as matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec_col: str) -> Column:
    """True for vectors that are not null or zero and have finite components."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dimensions(vectors: DataFrame, vec_col: str) -> list[int]:
    """The dimensions of usable vectors, one at least: vectors of different dimensions never meet."""
    found = vectors.filter(usable(vec_col)).select(F.size(vec_col).alias("d")).distinct().collect()
    return sorted(r["d"] for r in found) or [1]


def keyed(vectors: DataFrame, vec_col: str) -> DataFrame:
    """With h1 and h2, 128 bits that equal vectors share; 0 and -0 are equal."""
    same = F.transform(F.col(vec_col), lambda x: x + 0.0)
    return vectors.withColumn("h1", F.xxhash64(same)).withColumn("h2", F.xxhash64(F.lit(1), same))


def matrix(column) -> np.ndarray:
    """Rows of doubles from an Arrow list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def packed(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows, dtype=np.float64)]


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
