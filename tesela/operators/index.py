"""Inverted index as ordinary tables: documents, terms, postings, meta."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize, weighting
from ..functions.policy import Model, Policy
from ..session import materialize
from .joins import BROADCAST_ROWS, skew_join

#: Sizes of the records of the single-file form. FIXED VALUES.
HEADER_BYTES, DOC_BYTES, TERM_BYTES, POSTING_BYTES = 64, 44, 22, 12
#: Signature of the single-file form, 8 bytes; files of other programs carry their own (see ``sources.idx``).
SIGNATURE = "TESELAIX"
#: Longest term in UTF-8 bytes.
TERM_LIMIT = 65535
#: Documents of a block that is built apart.
BLOCK_DOCS = 5000


@dataclass
class Index:
    """``documentos``: doc_id, hash_url, num_tokens, norma; ``terminos``: termino, df, idf;
    ``postings``: termino, doc_id, tf, peso; ``meta``: one row of totals and settings."""

    documentos: DataFrame
    terminos: DataFrame
    postings: DataFrame
    meta: DataFrame
    policy: Policy
    model: Model


def occurrences(docs: DataFrame, policy: Policy, text_col: str = "texto", keep: bool = False) -> DataFrame:
    """``termino, doc_id, tf`` of ``doc_id, texto`` rows. ``keep``: counts of unstemmed words are written, not made twice."""
    split = normalize.tokens(docs.select("doc_id", F.col(text_col).alias("texto")), policy)
    words = split.select("doc_id", "idioma_doc", F.explode("tokens").alias("termino"))
    if not policy.stemming:
        tf = words.groupBy("termino", "doc_id").agg(F.count("*").alias("tf"))
    else:
        raw = words.groupBy("termino", "idioma_doc", "doc_id").agg(F.count("*").alias("tf"))
        raw = materialize(raw, "word-frequencies") if keep else raw
        stems = normalize.stem_vocabulary(raw)
        tf = raw.join(stems, ["termino", "idioma_doc"]).groupBy(F.col("raiz").alias("termino"), "doc_id").agg(F.sum("tf").alias("tf"))
    return tf.where(F.octet_length("termino") <= TERM_LIMIT)


def build_index(docs: DataFrame, policy: Policy, model: Model = Model(), text_col: str = "texto", keep: bool = False) -> Index:
    """Index of ``doc_id, hash_url, texto`` rows. Documents without tokens stay, with norm 0.

    ``keep`` writes the term counts to the shared folder, so that the tables share one pass over the texts.
    """
    tf = occurrences(docs, policy, text_col, keep)
    return weigh(materialize(tf, "term-frequencies") if keep else tf, docs, policy, model, keep)


def write_blocks(docs: DataFrame, policy: Policy, path: str, block_docs: int = BLOCK_DOCS, text_col: str = "texto") -> None:
    """Term counts of blocks of ``block_docs`` documents as sorted runs, one folder a block; a block written again replaces its run."""
    counts = occurrences(docs, policy, text_col).withColumn("bloque", F.floor(F.col("doc_id") / block_docs).cast("int"))
    runs = counts.repartitionByRange("bloque", "termino", "doc_id").sortWithinPartitions("bloque", "termino", "doc_id")
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bloque").parquet(path)


def merge_blocks(spark: SparkSession, path: str, docs: DataFrame, policy: Policy, model: Model = Model(), keep: bool = False) -> Index:
    """One index of separately written blocks: document frequencies, weights and norms over all of them."""
    tf = spark.read.schema("termino string, doc_id long, tf long, bloque int").parquet(path).select("termino", "doc_id", "tf")
    return weigh(tf, docs, policy, model, keep)


def reconcile_blocks(postings: DataFrame, terminos: DataFrame, n_docs: DataFrame, model: Model = Model()) -> DataFrame:
    """``termino, bloques, df, idf, df_guardada``: what the blocks of a stored index give together, beside the sum of what they stored.

    postings: termino, doc_id, bloque (repeated rows count once). terminos: bloque, termino, df (of several rows of a
    block the largest counts). ``n_docs`` has the one row ``n_docs``.
    """
    true = postings.where(F.col("termino").isNotNull() & F.col("doc_id").isNotNull()).groupBy("termino").agg(F.count_distinct("bloque").cast("int").alias("bloques"), F.count_distinct("doc_id").alias("df"))
    stored = terminos.where(F.col("termino").isNotNull()).groupBy("termino", "bloque").agg(F.max("df").alias("df")).groupBy("termino").agg(F.sum("df").alias("df_guardada"))
    rows = true.crossJoin(F.broadcast(n_docs)).join(stored, "termino", "left")
    return rows.select("termino", "bloques", "df", weighting.idf_weight(F.col("n_docs"), F.col("df"), model.esquema_idf, model.suavizado_idf).alias("idf"), F.coalesce("df_guardada", F.lit(0)).alias("df_guardada"))


def weigh(tf: DataFrame, docs: DataFrame, policy: Policy, model: Model = Model(), keep: bool = False) -> Index:
    """Index from term counts ``termino, doc_id, tf``; with ``keep`` they must be a written table."""
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    terms = tf.groupBy("termino").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    terms = terms.select("termino", "df", weighting.idf_weight(F.col("n_docs"), F.col("df"), model.esquema_idf, model.suavizado_idf).alias("idf"))
    weight = weighting.tf_weight(F.col("tf"), model.esquema_tf) * F.col("idf")
    if keep:
        # a small written dictionary is broadcast; else terms of very many documents are split from the rest
        terms = materialize(terms, "dictionary")
        small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        joined = tf.join(F.broadcast(terms), "termino") if small else skew_join(tf, terms, "termino", "df", tf.count(), "doc_id")
    else:
        joined = tf.join(terms, "termino")
    postings = joined.select("termino", "doc_id", "tf", weight.alias("peso"))
    # every token that passed the filters is one of its term's occurrences, so the counts add up to num_tokens
    norms = postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("peso") * F.col("peso"))).alias("norma"), F.sum("tf").cast("int").alias("num_tokens"))
    documents = docs.select("doc_id", "hash_url").join(norms, "doc_id", "left").select("doc_id", "hash_url", F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"), F.coalesce("norma", F.lit(0.0)).alias("norma"))
    totals = terms.agg(F.count("*").alias("total_terminos"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"), F.coalesce(F.sum(F.octet_length("termino")), F.lit(0)).alias("bytes_terminos"))
    meta = totals.crossJoin(n_docs).select(
        F.lit(SIGNATURE).alias("firma"), F.lit(1).alias("version"), F.lit(policy.flags()).alias("flags"), F.col("n_docs").alias("total_docs"), "total_terminos", "total_postings",
        F.lit(HEADER_BYTES).cast("long").alias("offset_docs"), (HEADER_BYTES + DOC_BYTES * F.col("n_docs")).alias("offset_diccionario"),
        (HEADER_BYTES + DOC_BYTES * F.col("n_docs") + TERM_BYTES * F.col("total_terminos") + F.col("bytes_terminos")).alias("offset_postings"),
        F.lit(model.esquema_tf).alias("esquema_tf"), F.lit(model.esquema_idf).alias("esquema_idf"), F.lit(model.normalizacion_coseno).alias("coseno"), F.lit(model.suavizado_idf).alias("suavizado"),
    )
    return Index(documents, terms, postings, meta, policy, model)


def layout(index: Index) -> DataFrame:
    """``termino, df, offset, bytes``: where each term's postings stand in the single-file form.

    The running sum goes over term ranges first and within each range after, so no
    task holds the whole dictionary.
    """
    ranged = index.terminos.repartitionByRange("termino").withColumn("parte", F.spark_partition_id())
    ranged = materialize(ranged.select("termino", "df", "parte"), "term-ranges")
    sizes = ranged.groupBy("parte").agg(F.min("termino").alias("t"), F.sum("df").alias("n"))
    before = sizes.withColumn("previos", F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("parte", "previos")
    within = F.coalesce(F.sum("df").over(Window.partitionBy("parte").orderBy("termino").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("antes", within).join(F.broadcast(before), "parte").crossJoin(F.broadcast(index.meta.select("offset_postings")))
    return placed.select("termino", "df", (F.col("offset_postings") + POSTING_BYTES * (F.col("previos") + F.col("antes"))).alias("offset"), (POSTING_BYTES * F.col("df")).alias("bytes"))


def verify(index: Index) -> DataFrame:
    """``comprobacion, problemas``: violations per structural check (all zero in a sound index)."""
    m = index.meta
    t = index.terminos.agg(F.count("*").alias("n"), F.count_distinct("termino").alias("d"), F.coalesce(F.sum("df"), F.lit(0)).alias("s"))
    p = index.postings.agg(F.count("*").alias("p"))
    per_term = index.postings.groupBy("termino").agg(F.count("*").alias("n")).join(index.terminos, "termino", "full").where(~F.col("n").eqNullSafe(F.col("df"))).agg(F.count("*").alias("malos"))
    strange = index.postings.select("doc_id").join(index.documentos.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("ajenos"))
    row = m.crossJoin(t).crossJoin(p).crossJoin(per_term).crossJoin(strange)
    checks = {
        "offset_docs": F.col("offset_docs") != HEADER_BYTES, "offset_diccionario": F.col("offset_diccionario") != HEADER_BYTES + DOC_BYTES * F.col("total_docs"), "offsets_en_orden": F.col("offset_diccionario") > F.col("offset_postings"),
        "terminos": F.col("n") != F.col("total_terminos"), "terminos_repetidos": F.col("n") != F.col("d"), "postings": F.col("p") != F.col("total_postings"), "postings_df": F.col("s") != F.col("total_postings"),
    }
    stack = [F.struct(F.lit(k).alias("comprobacion"), c.cast("long").alias("problemas")) for k, c in checks.items()]
    stack += [F.struct(F.lit(k).alias("comprobacion"), F.col(c).cast("long").alias("problemas")) for k, c in (("df_por_termino", "malos"), ("documentos_ajenos", "ajenos"))]
    return row.select(F.inline(F.array(*stack)))


def metrics(index: Index, name: str) -> DataFrame:
    """Deterministic figures of a build, for comparing policies."""
    return index.meta.select(
        F.lit(name).alias("politica"), "total_docs", "total_terminos", "total_postings", (F.col("offset_postings") + POSTING_BYTES * F.col("total_postings")).alias("bytes"),
        F.when(F.col("total_terminos") > 0, F.round(F.col("total_postings") / F.col("total_terminos"), 6)).otherwise(0.0).alias("postings_por_termino"),
        F.when(F.col("total_docs") > 0, F.round((F.col("offset_postings") + POSTING_BYTES * F.col("total_postings")) / F.col("total_docs"), 6)).otherwise(0.0).alias("bytes_por_documento"),
    )


def document(index: Index, doc_id: int) -> Row:
    """The row of a document number; IndexError outside 0 … total_docs - 1."""
    total = index.meta.first().total_docs
    if not 0 <= doc_id < total:
        raise IndexError(f"document {doc_id} of {total}")
    return index.documentos.where(F.col("doc_id") == doc_id).first()


def write_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Parquet tables under ``path``; documents sorted by number, terms and postings by term, so that filters prune row groups.

    The meta table comes last: an index is there once its meta is.
    """
    index.documentos.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode(mode).parquet(f"{path}/documentos")
    index.terminos.repartitionByRange("termino").sortWithinPartitions("termino").write.mode(mode).parquet(f"{path}/terminos")
    index.postings.repartitionByRange("termino", "doc_id").sortWithinPartitions("termino", "doc_id").write.mode(mode).parquet(f"{path}/postings")
    index.meta.write.mode(mode).parquet(f"{path}/meta")


def read_index(spark, path: str) -> Index:
    """Index written by ``write_index``; policy and model come from its meta row."""
    meta = spark.read.parquet(f"{path}/meta")
    m = meta.first()
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("documentos", "terminos", "postings")}
    return Index(**tables, meta=meta, policy=Policy.from_flags(m.flags), model=Model(m.esquema_tf, m.esquema_idf, m.coseno, m.suavizado))
