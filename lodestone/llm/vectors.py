"""What the operators on embeddings share: usable rows as tables, Arrow lists as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def usable(df: DataFrame, vector_col: str, below: float, **keep: str) -> tuple[DataFrame, int]:
    """(kept columns under new names, v as doubles) of the rows whose vector can be used, and the number of dimensions.

    Left out are vectors that are null, hold null or non-finite entries, or entries of `below` and
    more in size, which integer arithmetic could not hold; and vectors of another length than the
    commonest one (of equally common ones the longer). The table is written once, as it is read
    several times.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(below))))  # NaN is above all numbers
    rows = df.where(F.col(vector_col).isNotNull() & fine).select(*[F.col(c).alias(name) for name, c in keep.items()], v.alias("v"))
    rows = materialize(rows)
    common = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    return rows.where(F.size("v") == length), length


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix; all lists have `width` entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)
