"""Which vectors of a table take part, for operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Not null and without null, NaN or infinite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def components(rows: DataFrame, id_col: str, vector: str, *others: str) -> DataFrame:
    """vec_id, v array<double> and the other named columns."""
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), *others)


def of_common_length(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is as long as that of the smallest id (null ids last, then the shorter one); empty vectors never count."""
    rows = rows.where(F.size(vector) > 0)
    least = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size(vector)))).first()[0]
    return rows.where(F.size(vector) == (least[2] if least else -1))
