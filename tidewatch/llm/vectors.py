"""Vectors as rows and as blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_row_per_id(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>); of rows repeating an id the one with the greatest vector counts. Null ids stay as they are."""
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    named = out.where("vec_id is not null")
    if not named.groupBy("vec_id").count().where("count > 1").isEmpty():
        out = named.groupBy("vec_id").agg(F.max("v").alias("v")).union(out.where("vec_id is null"))
    return out


def usual_length(vectors: DataFrame) -> int | None:
    """The length most vectors have (the smaller one of two as common)."""
    row = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else None


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
