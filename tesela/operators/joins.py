"""Joins that stay whole under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a written, counted side is broadcast (keys and a few numbers: under 50 MB).
BROADCAST_ROWS = 500_000
#: Copies of the smaller side when it is too large to broadcast.
SALTS = 16


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large, possibly skewed ``left`` with a small written ``right``.

    ``right`` is counted (it must be cheap to count, as a written table is). Up to
    ``limit`` rows it is broadcast; beyond that both sides are salted: ``left`` by the
    hash of ``spread``, ``right`` copied for every salt, so that a hot key is spread
    over SALTS tasks. ``how`` is inner, left_semi or left_anti.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("salt_", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*keys, "salt_"], how).drop("salt_")


#: A key is hot from this fraction of all rows; at most its inverse keys can be hot.
HOT_FRACTION = 1e-4


def skew_join(left: DataFrame, right: DataFrame, key: str, rows_col: str, total_rows: int, spread: str) -> DataFrame:
    """Left join of ``left`` with ``right`` (one row a key) that survives hot keys.

    ``rows_col`` of ``right`` says how many rows of ``left`` the key has. The hot keys,
    at most 1 / HOT_FRACTION of them, are broadcast; all others are joined by shuffle,
    where rows already answered are spread by the hash of ``spread``.
    """
    cols = [c for c in right.columns if c != key]
    least = max(2.0, total_rows * HOT_FRACTION)
    hot = right.where(F.col(rows_col) >= least).select(key, *[F.col(c).alias(f"hot_{c}") for c in cols])
    cold = right.where(F.col(rows_col) < least).select(F.col(key).cast("string").alias("cold_key_"), *[F.col(c).alias(f"cold_{c}") for c in cols])
    answered = left.join(F.broadcast(hot), key, "left")
    dummy = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(spread), F.lit(100_000)).cast("string"))
    keyed = answered.withColumn("join_key_", F.when(F.col(f"hot_{rows_col}").isNull(), F.col(key).cast("string")).otherwise(dummy))
    joined = keyed.join(cold, F.col("join_key_") == F.col("cold_key_"), "left")
    return joined.select(*left.columns, *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in cols])
