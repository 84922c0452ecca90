"""Distinctiveness of terms (PPMI) and frequencies of all terms kept by signed deltas.

Odd input: rows with a null term or record are no occurrences and are left out;
rows repeated for the same term and record count once, with the largest tf; a
null or non-positive tf counts as no occurrence.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import materialize
from .state import Counts

#: Exponent that smooths the records' marginal distribution.
CONTEXT_EXPONENT = 0.75
#: Marks: too rare up to this many records, too common above this share of them.
RARE_RECORDS = 1
COMMON_SHARE = 1 / 3


def occurrences(postings: DataFrame) -> DataFrame:
    """``termino, doc_id, tf``: one row per term and record."""
    return postings.where(F.col("termino").isNotNull() & F.col("doc_id").isNotNull() & (F.col("tf") > 0)).groupBy("termino", "doc_id").agg(F.max("tf").alias("tf"))


def ppmi(postings: DataFrame, exponent: float = CONTEXT_EXPONENT) -> DataFrame:
    """``termino, doc_id, tf, df, ppmi`` over the whole collection.

    ppmi = max(0, log2(p(t, d) / (p(t) p_a(d)))), where p_a(d) is proportional to the
    record's count to the power ``exponent``. Empty input gives no rows.
    """
    seen = materialize(occurrences(postings), "occurrences")
    terms = seen.groupBy("termino").agg(F.sum("tf").alias("n_t"), F.count("*").alias("df"))
    docs = materialize(seen.groupBy("doc_id").agg(F.sum("tf").alias("n_d"), F.count("*").alias("terminos_d")), "records")
    total = docs.agg(F.sum("terminos_d"), F.sum(F.pow(F.col("n_d").cast("double"), F.lit(exponent)))).first()
    rows, z = int(total[0] or 0), float(total[1] or 1.0)
    joined = skew_join(skew_join(seen, terms, "termino", "df", rows, "doc_id"), docs, "doc_id", "terminos_d", rows, "termino")
    ratio = F.col("tf") * F.lit(z) / (F.col("n_t") * F.pow(F.col("n_d").cast("double"), F.lit(exponent)))
    return joined.select("termino", "doc_id", "tf", "df", F.greatest(F.lit(0.0), F.log2(ratio)).alias("ppmi"))


def p3_found(postings: DataFrame) -> DataFrame:
    """``doc_id, termino``: terms that are positively bound to the record, frequent in it, shared by few records, and spelt of letters."""
    scored = ppmi(postings).where((F.col("ppmi") > 0) & (F.col("tf") >= 4) & F.col("df").between(2, 6) & F.col("termino").rlike(r"^[a-z'\-]{6,}$"))
    return scored.select("doc_id", "termino")


def p3_top(postings: DataFrame, top: int = 10) -> DataFrame:
    """``doc_id, puesto, termino, ppmi``: the most characteristic terms of every record, of equal scores the first in order."""
    scored = ppmi(postings).where(F.col("ppmi") > 0).select("doc_id", "termino", F.round("ppmi", 6).alias("ppmi"))
    return scored.withColumn("puesto", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("ppmi"), "termino"))).where(F.col("puesto") <= top)


def term_counts(spark: SparkSession, path: str | None = None, version: int | None = None) -> Counts:
    """Persistent counts ``termino, ocurrencias, registros`` under a shared path (without one: an empty table of this run)."""
    return Counts.load(spark, path, "termino string, ocurrencias long, registros long", ("termino",), version)


def signed_delta(added: DataFrame | None, removed: DataFrame | None = None) -> DataFrame:
    """``termino, ocurrencias, registros`` as changes: added records count plus, removed ones minus.

    A changed record is one removed (as it was) and one added (as it is).
    """
    parts = [occurrences(df).withColumn("signo", F.lit(sign)) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("termino").agg(F.sum(F.col("tf") * F.col("signo")).cast("long").alias("ocurrencias"), F.sum("signo").cast("long").alias("registros"))


def merge_terms(state: Counts, delta: DataFrame, batch: str | None = None) -> Counts:
    """Merge signed changes into the persistent counts; terms without records leave."""
    return state.merge(delta, "registros", batch)


def marked(state: Counts, records: int) -> DataFrame:
    """``termino, ocurrencias, registros, marca``: marca is raro, comun or null."""
    mark = F.when(F.col("registros") <= RARE_RECORDS, F.lit("raro")).when(F.col("registros") > F.lit(records * COMMON_SHARE), F.lit("comun"))
    return state.read().select("termino", "ocurrencias", "registros", mark.alias("marca"))


def _records(coleccion: DataFrame) -> int:
    return coleccion.select("doc_id").where(F.col("doc_id").isNotNull()).count()


def p5_counts(postings: DataFrame, coleccion: DataFrame, path: str | None = None) -> DataFrame:
    """Every term with its counts and mark."""
    return marked(merge_terms(term_counts(postings.sparkSession, path), signed_delta(postings)), _records(coleccion))


def p5_found(postings: DataFrame, coleccion: DataFrame) -> DataFrame:
    """``termino, clase`` of the terms too rare or too common."""
    return p5_counts(postings, coleccion).where(F.col("marca").isNotNull()).select("termino", F.col("marca").alias("clase"))


def p5_by_blocks(postings: DataFrame, coleccion: DataFrame, path: str | None = None) -> DataFrame:
    """The same counts by deltas: all blocks but the last; the last one comes and the first one is taken back; the first one comes again."""
    ends = postings.agg(F.min("bloque").alias("a"), F.max("bloque").alias("b")).first()
    first, last = F.col("bloque").eqNullSafe(F.lit(ends.a)), F.col("bloque").eqNullSafe(F.lit(ends.b))
    state = merge_terms(term_counts(postings.sparkSession, path), signed_delta(postings.where(~last)))
    if ends.a != ends.b:
        state = merge_terms(state, signed_delta(postings.where(last), postings.where(first)))
        state = merge_terms(state, signed_delta(postings.where(first)))
    else:
        state = merge_terms(state, signed_delta(postings.where(last)))
    return marked(state, _records(coleccion))
