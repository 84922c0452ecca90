"""Seed lists and the text repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def parse_seeds(lines: DataFrame) -> DataFrame:
    """``linea, semilla, canonica, host`` of ``linea, value`` rows: comments cut, first form of every canonical URL kept.

    A line that is no http(s) URL gives a row with ``canonica`` null, so that callers can refuse the file.
    """
    raw = lines.select("linea", F.trim(F.split("value", "#")[0]).alias("semilla")).where(F.col("semilla") != "")
    ok = raw.withColumn("canonica", F.when(urls.is_http(F.col("semilla")), urls.canonical(F.col("semilla"))))
    first = ok.where(F.col("canonica").isNotNull()).groupBy("canonica").agg(F.min(F.struct("linea", "semilla")).alias("m")).select("m.linea", "m.semilla", "canonica")
    bad = ok.where(F.col("canonica").isNull()).select("linea", "semilla", "canonica")
    return first.unionByName(bad).withColumn("host", urls.origin_host(F.col("semilla")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a file; raises if a line is no URL or there is none."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "value")).select((F.col("pos") + 1).alias("linea"), "value")
    out = parse_seeds(rows)
    bad = out.where(F.col("canonica").isNull()).orderBy("linea").first()
    if bad is not None:
        raise ValueError(f"line {bad.linea} is no http(s) URL: {bad.semilla!r}")
    if out.limit(1).count() == 0:
        raise ValueError(f"{path} holds no seed")
    return out


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """``ruta, texto`` of the text files under a repository, decoded with replacement."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("ruta"), F.make_valid_utf8(F.col("content").cast("string")).alias("texto"))
