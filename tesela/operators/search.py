"""Ranked retrieval of batches of free-text queries over an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize, weighting
from ..session import materialize
from .index import Index
from .joins import bounded_join

SUGGESTIONS = 5
PREFIX = 4


def lookup(index: Index, term: str) -> DataFrame:
    """The dictionary row of a term, if there is one."""
    return index.terminos.where(F.col("termino") == term)


def prefix_lookup(index: Index, prefix: str, limit: int = 10) -> DataFrame:
    """The first terms with a prefix, in order; an empty prefix has none."""
    hits = index.terminos.where(F.col("termino").startswith(prefix)) if prefix else index.terminos.limit(0)
    return hits.orderBy("termino").limit(limit)


def term_report(index: Index, term: str, limit: int = 10) -> DataFrame:
    """First postings of a term, else look-alikes: ``clase, termino, doc_id, tf, peso, df``."""
    found = index.postings.where(F.col("termino") == term).orderBy("doc_id").limit(limit).join(lookup(index, term).select("termino", "df"), "termino")
    alike = prefix_lookup(index, term[:PREFIX], limit).join(lookup(index, term).select(F.lit(1).alias("uno")), how="left_anti", on=F.lit(True))
    return found.select(F.lit("posting").alias("clase"), "termino", "doc_id", "tf", "peso", "df").unionByName(alike.select(F.lit("parecido").alias("clase"), "termino", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tf"), F.lit(None).cast("double").alias("peso"), "df"))


def query_tokens(queries: DataFrame, index: Index, id_col: str = "consulta_id", text_col: str = "consulta") -> DataFrame:
    """``consulta_id, token, tf, pos`` of the distinct tokens, normalised by the index's own policy."""
    split = normalize.tokens(queries.select(F.col(id_col).alias("consulta_id"), F.col(text_col).alias("texto")), index.policy)
    words = split.select("consulta_id", "idioma_doc", F.posexplode("tokens").alias("pos", "token"))
    if index.policy.stemming:
        stems = normalize.stem_vocabulary(words, "token")
        words = words.join(stems, ["token", "idioma_doc"]).drop("token").withColumnRenamed("raiz", "token")
    return words.groupBy("consulta_id", "token").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))


def resolve(tokens: DataFrame, index: Index) -> DataFrame:
    """``consulta_id, token, tf, pos, termino, df, idf, orden``: variants found in the dictionary, most frequent first."""
    variants = tokens.withColumn("termino", F.explode(normalize.search_variants(F.col("token"), index.policy)))
    found = variants.join(index.terminos, "termino")
    order = Window.partitionBy("consulta_id", "token").orderBy(F.desc("df"), "termino")
    return found.withColumn("orden", F.row_number().over(order))


def query_weights(resolved: DataFrame, index: Index) -> DataFrame:
    """``consulta_id, termino, peso_q``; of tokens that resolve to one term the first counts."""
    weight = weighting.tf_weight(F.col("tf"), index.model.esquema_tf) * F.col("idf")
    return resolved.groupBy("consulta_id", "termino").agg(F.min_by(weight, F.struct("pos", "orden")).alias("peso_q"))


def scores(weights: DataFrame, index: Index) -> DataFrame:
    """``consulta_id, doc_id, similitud`` of every document that shares a term."""
    # a batch of queries is small beside the postings: written and counted, it is broadcast and the postings stay where they are
    weights = materialize(weights, "query-weights")
    norms = weights.groupBy("consulta_id").agg(F.sqrt(F.sum(F.col("peso_q") * F.col("peso_q"))).alias("norma_q"))
    dots = bounded_join(index.postings, weights, ["termino"], "doc_id").groupBy("consulta_id", "doc_id").agg(F.sum(F.col("peso") * F.col("peso_q")).alias("producto"))
    joined = dots.join(norms, "consulta_id").join(index.documentos, "doc_id")
    value = weighting.similarity(F.col("producto"), F.col("norma_q"), F.col("norma"), index.model.normalizacion_coseno)
    return joined.select("consulta_id", "doc_id", "hash_url", "num_tokens", F.round(value, 6).alias("similitud"))


def search(queries: DataFrame, index: Index, top: int = 10, id_col: str = "consulta_id", text_col: str = "consulta") -> DataFrame:
    """``consulta_id, puesto, doc_id, hash_url, num_tokens, similitud``; ``top`` <= 0 gives all."""
    ranked = scores(query_weights(resolve(query_tokens(queries, index, id_col, text_col), index), index), index)
    ranked = ranked.withColumn("puesto", F.row_number().over(Window.partitionBy("consulta_id").orderBy(F.desc("similitud"), "doc_id")))
    return ranked.where(F.col("puesto") <= top) if top > 0 else ranked


def missing_terms(tokens: DataFrame, index: Index) -> DataFrame:
    """``consulta_id, token`` of the tokens none of whose variants is in the dictionary."""
    return tokens.join(resolve(tokens, index).select("consulta_id", "token").distinct(), ["consulta_id", "token"], "left_anti").select("consulta_id", "token")


def suggestions(tokens: DataFrame, index: Index, limit: int = SUGGESTIONS) -> DataFrame:
    """``consulta_id, puesto, termino`` for queries that match nothing: terms that begin like their tokens."""
    matched = resolve(tokens, index).select("consulta_id").distinct()
    lost = tokens.join(matched, "consulta_id", "left_anti").withColumn("prefijo", F.substring("token", 1, PREFIX))
    prefixes = lost.select("prefijo").distinct()
    # prefixes of one to PREFIX characters: an equi-join on the same cut of the dictionary's terms
    cut = prefixes.withColumn("n", F.char_length("prefijo"))
    terms = index.terminos.select("termino", F.explode(F.sequence(F.lit(1), F.lit(PREFIX))).alias("n")).withColumn("prefijo", F.expr("substring(termino, 1, n)")).where(F.char_length("prefijo") == F.col("n"))
    first = terms.join(cut, ["prefijo", "n"]).withColumn("k", F.row_number().over(Window.partitionBy("prefijo").orderBy("termino"))).where(F.col("k") <= limit).select("prefijo", "termino", "k")
    offered = lost.join(first, "prefijo").groupBy("consulta_id", "termino").agg(F.min(F.struct("pos", "k")).alias("o"))
    ranked = offered.withColumn("puesto", F.row_number().over(Window.partitionBy("consulta_id").orderBy("o", "termino")))
    return ranked.where(F.col("puesto") <= limit).select("consulta_id", "puesto", "termino")
