"""Positions in a global order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ranges(df: DataFrame, *order) -> DataFrame:
    """The written rows with ``parte_``, the number of the range of ``order`` they lie in; rows of one key may lie in several."""
    return materialize(df.repartitionByRange(*order).withColumn("parte_", F.spark_partition_id()), "ranges")


def global_position(df: DataFrame, *order, name: str = "posicion") -> DataFrame:
    """Adds the 0-based position in ``order``: ranges are sorted apart, then shifted by what lies before them."""
    parted = ranges(df, *order)
    before = F.coalesce(F.sum("n_").over(Window.orderBy("parte_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parted.groupBy("parte_").agg(F.count("*").alias("n_")).select("parte_", before.alias("antes_"))
    within = F.row_number().over(Window.partitionBy("parte_").orderBy(*order))
    return parted.withColumn("k_", within).join(F.broadcast(shifts), "parte_").withColumn(name, F.col("antes_") + F.col("k_") - 1).drop("parte_", "k_", "antes_")
