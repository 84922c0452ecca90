"""Corpus reports: domains, word frequencies, Zipf reference, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from .ranking import global_position


def by_domain(docs: DataFrame) -> DataFrame:
    """``dominio, documentos, bytes, porcentaje`` with a total row (``TOTAL``)."""
    rows = docs.rollup("dominio").agg(F.count("*").alias("documentos"), F.sum("bytes").alias("bytes"), F.grouping("dominio").alias("g"))
    total = docs.agg(F.count("*").alias("n"))
    name = F.when(F.col("g") == 1, "TOTAL").otherwise(F.coalesce("dominio", F.lit("(desconocido)")))
    return rows.crossJoin(F.broadcast(total)).select(name.alias("dominio"), "documentos", "bytes", F.round(100.0 * F.col("documentos") / F.col("n"), 4).alias("porcentaje"))


def word_frequency(docs: DataFrame, text_col: str = "texto") -> DataFrame:
    """``rango, palabra, frecuencia, relativa`` of lower-case words with their accents."""
    words = docs.select(F.explode(normalize.lower_tokens(normalize.tokenize(normalize.clean(F.col(text_col))))).alias("palabra"))
    counts = words.groupBy("palabra").agg(F.count("*").alias("frecuencia"))
    ranked = global_position(counts, F.desc("frecuencia"), F.asc("palabra"))
    total = ranked.agg(F.sum("frecuencia").alias("t"))
    return ranked.crossJoin(F.broadcast(total)).select((F.col("posicion") + 1).alias("rango"), "palabra", "frecuencia", (F.col("frecuencia") / F.col("t")).alias("relativa"))


def zipf(ranked: DataFrame) -> DataFrame:
    """Slope and fit of log frequency on log rank, and the reference constant (the top frequency)."""
    y, x = F.ln("frecuencia"), F.ln("rango")
    return ranked.agg(F.max("frecuencia").alias("c"), F.regr_slope(y, x).alias("pendiente"), F.regr_r2(y, x).alias("r2"))


def hapax(ranked: DataFrame) -> DataFrame:
    once = F.sum((F.col("frecuencia") == 1).cast("long"))
    return ranked.agg(F.count("*").alias("palabras"), once.alias("hapax"), (once / F.count("*")).alias("proporcion"))


def actions(log: DataFrame, action: Column | None = None) -> DataFrame:
    """Audit rows per action."""
    return log.groupBy((action if action is not None else F.upper(F.trim("accion"))).alias("accion")).agg(F.count("*").alias("n"))


# FIXED VALUES: words of the trade that reports look up.
TRADE_WORDS = ("scene", "cut", "act", "int", "ext", "fade", "voz", "escena", "interior")


def lookup(ranked: DataFrame, words: tuple[str, ...] = TRADE_WORDS) -> DataFrame:
    """``palabra, rango, frecuencia`` of the words looked up; absent ones have no rank and frequency 0."""
    asked = ranked.sparkSession.createDataFrame([(w,) for w in words], "palabra string")
    found = ranked.where(F.col("palabra").isin(*words)).select("palabra", "rango", "frecuencia")
    return asked.join(found, "palabra", "left").select("palabra", "rango", F.coalesce("frecuencia", F.lit(0)).alias("frecuencia"))
