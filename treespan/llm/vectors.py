"""Embeddings as rows of numbers: which take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, written


def usable(v: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def spaces(df: DataFrame, id_col: str, vector_col: str) -> list[DataFrame]:
    """``id`` and ``v`` array<double> of the usable vectors with an id, a written table for each length: only vectors of one length can be compared."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = written(rows.withColumn("d", F.size("v")), "vectors")
    lengths = sorted(r.d for r in rows.select("d").distinct().collect())  # one row a length
    return [rows.where(F.col("d") == d).select("id", "v") for d in lengths]


def matrix(column: pa.Array, dtype=float) -> np.ndarray:
    """A matrix from a list column without nulls, lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)
