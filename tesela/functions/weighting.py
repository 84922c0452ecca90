"""Weights of terms and similarity of documents, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import Model


def tf_weight(tf: Column, scheme: str = "logaritmico") -> Column:
    """``logaritmico`` and ``sublineal`` 1 + ln tf, ``binario`` 1, ``natural`` tf; 0 without occurrences."""
    Model(esquema_tf=scheme)
    value = {"binario": F.lit(1.0), "natural": tf.cast("double")}.get(scheme, F.lit(1.0) + F.ln(tf.cast("double")))
    return F.when(tf <= 0, 0.0).otherwise(value)


def idf_weight(n_docs: Column, df: Column, scheme: str = "estandar", smooth: bool = True) -> Column:
    Model(esquema_idf=scheme)
    if scheme == "ninguno":
        return F.lit(1.0)
    n, d = n_docs.cast("double"), df.cast("double")
    ratio = n / d if scheme == "estandar" else (n - d) / d
    value = F.ln(ratio + 1) if smooth else F.ln(F.when(ratio > 0, ratio))
    if scheme == "probabilistico":
        value = F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))
    return F.when((df <= 0) | (n_docs <= 0), 0.0).otherwise(value)


def similarity(dot: Column, query_norm: Column, doc_norm: Column, cosine: bool = True) -> Column:
    """Cosine; a document norm of 0 counts as 1, a denominator of 0 gives 0."""
    if not cosine:
        return dot
    below = query_norm * F.when(doc_norm == 0, F.lit(1.0)).otherwise(doc_norm)
    return F.when(below <= 0, 0.0).otherwise(dot / below)
