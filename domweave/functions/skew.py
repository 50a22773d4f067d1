"""Joins against one-row-per-key tables that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_per_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], how: str = "left", salts: int = 16
) -> DataFrame:
    """Join many rows per key with exactly one row per key.

    A third of ``rows`` may share a key, so each key is split into ``salts`` parts by
    a hash of ``spread_by`` and the one-row side is repeated for every part.  ``how``
    must keep unmatched rows only on the left ("left", "inner", "left_semi",
    "left_anti").  The repeated side is one row per key, so it grows by a constant.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return salted.join(per_key.withColumn("_salt", parts), [*keys, "_salt"], how).drop("_salt")
