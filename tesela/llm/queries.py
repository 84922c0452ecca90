"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, text_table
from . import boilerplate, language, leaks, mixing, quality, repeated_lines, spam, splitting, terms

#: Tables whose texts are worked on in Python.
TEXTS = ("coleccion", "documents", "resultado_html")
Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: function(*[(text_table if t in TEXTS else table)(spark, sf_dir, t) for t in tables])


def p1_documentos(coleccion: DataFrame, etiquetas: DataFrame, documents: DataFrame) -> DataFrame:
    """Language, confidence and declared language of every text of both tables."""
    return language.p1_labelled(coleccion, etiquetas, documents).select("tabla", "doc_id", "declarado", "idioma", F.round("confianza", 3).alias("confianza"), "clase", "mixto")


def p1_lineas(coleccion: DataFrame, etiquetas: DataFrame, documents: DataFrame, bound: language.TrainingBound = language.TrainingBound()) -> DataFrame:
    """Language and confidence of every sizable line of the mixed texts of both tables."""
    texts = language.p1_labelled(coleccion, etiquetas, documents, bound, every=False).where("mixto")
    lines = texts.select("tabla", "doc_id", "clase", F.explode("segmentos").alias("s"))
    return lines.select("tabla", "doc_id", "clase", "s.linea", "s.n_caracteres", "s.n_palabras", "s.idioma", F.round("s.confianza", 3).alias("confianza"))


def p2_estadisticas(coleccion: DataFrame) -> DataFrame:
    """Statistics and class of every collection text."""
    return quality.text_statistics(coleccion.select("doc_id", "texto"))


def p2_cuentas(coleccion: DataFrame) -> DataFrame:
    """The statistics that SQL can express."""
    stats = quality.text_statistics(coleccion.select("doc_id", "texto"))
    return stats.select("doc_id", "n_caracteres", "n_palabras", *[F.round(c, 6).alias(c) for c in ("largo_medio", "proporcion_simbolos", "lineas_con_punto", "palabras_comunes")])


def p2_tamanos(coleccion: DataFrame, documentos: DataFrame) -> DataFrame:
    return quality.size_mismatches(coleccion, documentos)


def p4_incremental(coleccion: DataFrame, documentos: DataFrame) -> DataFrame:
    """All texts after the later half of the downloads joined the earlier half."""
    dates = documentos.groupBy(F.col("id").alias("db_id")).agg(F.max("fecha_descarga").alias("f"))
    span = documentos.agg(F.min("fecha_descarga").cast("double").alias("a"), F.max("fecha_descarga").cast("double").alias("b")).first()
    cut = F.timestamp_seconds(F.lit(((span.a or 0.0) + (span.b or 0.0)) / 2))
    dated = coleccion.select("doc_id", "db_id", "dominio", "texto").join(dates, "db_id", "left")
    late = F.coalesce(F.col("f") >= cut, F.lit(False))
    return repeated_lines.p4_incremental(dated.where(~late), dated.where(late))


def p3_ppmi(postings: DataFrame) -> DataFrame:
    return terms.ppmi(postings).select("termino", "doc_id", "tf", "df", F.round("ppmi", 6).alias("ppmi"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(language.p1_found, "coleccion", "etiquetas_idioma", "documents"),
        "p1_documentos": _over(p1_documentos, "coleccion", "etiquetas_idioma", "documents"),
        "p1_lineas": _over(p1_lineas, "coleccion", "etiquetas_idioma", "documents"),
        "p2_found": _over(quality.p2_found, "coleccion", "documentos"),
        "p2_estadisticas": _over(p2_estadisticas, "coleccion"),
        "p2_cuentas": _over(p2_cuentas, "coleccion"),
        "p2_tamanos": _over(p2_tamanos, "coleccion", "documentos"),
        "p3_found": _over(terms.p3_found, "postings"),
        "p3_ppmi": _over(p3_ppmi, "postings"),
        "p3_caracteristicos": _over(terms.p3_top, "postings"),
        "p4_found": _over(repeated_lines.p4_found, "coleccion"),
        "p4_incremental": _over(p4_incremental, "coleccion", "documentos"),
        "p4_textos": _over(repeated_lines.p4_clean, "coleccion"),
        "p5_found": _over(terms.p5_found, "postings", "coleccion"),
        "p5_frecuencias": _over(terms.p5_counts, "postings", "coleccion"),
        "p5_por_bloques": _over(terms.p5_by_blocks, "postings", "coleccion"),
        "p6_found": _over(boilerplate.p6_found, "coleccion", "resultado_html", "documentos"),
        "p6_cuerpos": _over(boilerplate.p6_bodies, "coleccion", "resultado_html"),
        "p7_found": _over(spam.p7_found, "coleccion", "documentos"),
        "p7_paginas": _over(spam.p7_scores, "coleccion", "documentos"),
        "p8_found": _over(leaks.p8_found, "documents", "evaluacion"),
        "p8_fugas": _over(leaks.leaks, "documents", "evaluacion"),
        "p8_editadas": _over(leaks.p8_edited, "documents", "evaluacion"),
        "p9_mezcla": _over(lambda d, m: mixing.mixture(d, m)[0], "documents", "mezcla_objetivo"),
        "p9_desvios": _over(mixing.p9_gaps, "documents", "mezcla_objetivo"),
        "p9_proporciones": _over(lambda d, m: mixing.mixture(d, m)[1], "documents", "mezcla_objetivo"),
        "p10_found": _over(splitting.p10_found, "documents"),
        "p10_trozos": _over(splitting.pieces, "documents"),
        "p10_reunidos": _over(splitting.p10_reunited, "documents"),
    }


_OCCURRENCES = "SELECT termino, doc_id, max(tf) AS tf FROM postings WHERE termino IS NOT NULL AND doc_id IS NOT NULL AND tf > 0 GROUP BY termino, doc_id"

_PPMI = f"""
WITH o AS ({_OCCURRENCES}),
t AS (SELECT termino, sum(tf) AS n_t, count(*) AS df FROM o GROUP BY termino),
d AS (SELECT doc_id, sum(tf) AS n_d FROM o GROUP BY doc_id),
z AS (SELECT sum(pow(n_d::DOUBLE, 0.75)) AS z FROM d)
SELECT o.termino, o.doc_id, o.tf, t.df, greatest(0.0, log2(o.tf * z.z / (t.n_t * pow(d.n_d::DOUBLE, 0.75)))) AS ppmi
FROM o JOIN t USING (termino) JOIN d USING (doc_id) CROSS JOIN z
"""

_COUNTS = f"""
WITH o AS ({_OCCURRENCES}),
t AS (SELECT termino, sum(tf)::BIGINT AS ocurrencias, count(*) AS registros FROM o GROUP BY termino),
n AS (SELECT count(*) AS n FROM coleccion WHERE doc_id IS NOT NULL)
SELECT termino, ocurrencias, registros,
       CASE WHEN registros <= 1 THEN 'raro' WHEN registros > n.n / 3.0 THEN 'comun' END AS marca
FROM t CROSS JOIN n
"""

_LINES = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(trim(dominio)), '^www\.', '') AS fuente, string_split(texto, chr(10)) AS l FROM coleccion),
e AS (SELECT doc_id, fuente, unnest(range(1, len(l) + 1))::INTEGER AS linea, unnest(l) AS s FROM d),
n AS (SELECT doc_id, fuente, linea,
        trim(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(s)), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]', '', 'g'), '[0-9]+', '0', 'g'), '[\s\x{A0}]+', ' ', 'g')) AS s FROM e),
k AS (SELECT * FROM n WHERE length(s) >= 15),
c AS (SELECT fuente, s, count(DISTINCT doc_id) AS n FROM k GROUP BY fuente, s),
t AS (SELECT fuente, count(DISTINCT doc_id) AS docs FROM d GROUP BY fuente),
r AS (SELECT c.fuente, c.s FROM c JOIN t USING (fuente) WHERE c.n >= 4 AND c.n * 10 >= t.docs)
"""

_CLEANED = _LINES + ", q AS (SELECT DISTINCT k.doc_id, k.linea FROM k JOIN r USING (fuente, s)) SELECT doc_id, string_agg(s, chr(10) ORDER BY linea) FILTER (q.linea IS NULL) AS texto_limpio FROM e LEFT JOIN q USING (doc_id, linea) GROUP BY doc_id"

_SIZES = """
SELECT c.doc_id, g.guardado, strlen(c.texto) AS medido
FROM coleccion c JOIN (SELECT id, arg_max(tamano_texto_bytes, fecha_descarga) AS guardado FROM documentos GROUP BY id) g ON g.id = c.db_id
WHERE g.guardado <> strlen(c.texto)
"""


def _statistics_sql() -> str:
    common = "[" + ", ".join(f"'{w}'" for w in sorted(quality._COMMON)) + "]"
    blank = r"[\s\x{0B}\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    clean = "replace(regexp_replace(nfc_normalize(s), '[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{AD}]', '', 'g'), chr(160), ' ')"
    return f"""
WITH e AS (SELECT doc_id, unnest(string_split(texto, chr(10))) AS s FROM coleccion),
l AS (SELECT doc_id, length(s) AS c, {clean} AS s FROM e),
k AS (SELECT doc_id, c, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+(?:[''’\\-][\\p{{L}}\\p{{N}}_]+)*') AS w, regexp_replace(s, '{blank}', '', 'g') AS solid FROM l),
n AS (SELECT doc_id, c, len(w) AS words, list_sum(list_transform(w, lambda x: length(x))) AS chars, length(solid) AS solid_n, (solid <> '')::INTEGER AS lines,
        length(regexp_replace(solid, '[\\p{{L}}\\p{{N}}_.,;:!?¡¿''"()«»“”‘’…\\-]+', '', 'g')) AS symbols, regexp_matches(solid, '[.!?…。][''"»”’)\\]]*$')::INTEGER AS ends,
        len(list_filter(w, lambda x: list_contains({common}, lower(x)))) AS common FROM k)
SELECT doc_id, sum(c)::BIGINT AS n_caracteres, sum(words)::BIGINT AS n_palabras, CASE WHEN sum(words) > 0 THEN round(sum(chars)::DOUBLE / sum(words), 6) END AS largo_medio,
       CASE WHEN sum(solid_n) > 0 THEN round(sum(symbols)::DOUBLE / sum(solid_n), 6) END AS proporcion_simbolos, CASE WHEN sum(lines) > 0 THEN round(sum(ends)::DOUBLE / sum(lines), 6) END AS lineas_con_punto,
       CASE WHEN sum(words) > 0 THEN round(sum(common)::DOUBLE / sum(words), 6) END AS palabras_comunes FROM n GROUP BY doc_id
"""


def _runs_sql(key: str, text: str, source: str) -> str:
    """Distinct runs of 12 words of a table's texts."""
    words = f"regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}\\p{{N}}]+')"
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {leaks.WINDOW - 2}), lambda i: array_to_string(w[i:i + {leaks.WINDOW - 1}], ' '))) AS g FROM (SELECT {key}, {words} AS w FROM {source} WHERE {text} IS NOT NULL AND {key} IS NOT NULL) WHERE len(w) >= {leaks.WINDOW})"


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"SELECT DISTINCT item_id, doc_id FROM {_runs_sql('item_id', 'texto', 'evaluacion')} JOIN {_runs_sql('doc_id', 'text', 'documents')} USING (g)",
        "p2_cuentas": _statistics_sql(),
        "p4_textos": _CLEANED,
        "p2_tamanos": _SIZES,
        "p4_incremental": _CLEANED,
        "p3_found": f"SELECT doc_id, termino FROM ({_PPMI}) WHERE ppmi > 0 AND tf >= 4 AND df BETWEEN 2 AND 6 AND regexp_matches(termino, '^[a-z''\\-]{{6,}}$')",
        "p3_ppmi": f"SELECT termino, doc_id, tf, df, round(ppmi, 6) AS ppmi FROM ({_PPMI})",
        "p3_caracteristicos": f"SELECT doc_id, puesto, termino, ppmi FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ppmi DESC, encode(termino))::INTEGER AS puesto FROM (SELECT doc_id, termino, round(ppmi, 6) AS ppmi FROM ({_PPMI}) WHERE ppmi > 0)) WHERE puesto <= 10",
        "p4_found": _LINES + "SELECT k.doc_id, k.linea FROM k JOIN r USING (fuente, s)",
        "p5_found": f"SELECT termino, marca AS clase FROM ({_COUNTS}) WHERE marca IS NOT NULL",
        "p5_frecuencias": _COUNTS,
        "p5_por_bloques": _COUNTS,
        "p9_desvios": """WITH d AS (SELECT lower(trim(source)) AS fuente, count(*) AS n FROM documents WHERE text <> '' AND source IS NOT NULL GROUP BY 1),
m AS (SELECT lower(trim(fuente)) AS fuente, sum(peso_objetivo) AS p, max(max_repeticiones) AS r FROM mezcla_objetivo WHERE fuente IS NOT NULL GROUP BY 1),
w AS (SELECT m.fuente, coalesce(n, 0) AS n, CASE WHEN n > 0 AND p > 0 AND r > 0 THEN p ELSE 0.0 END AS p FROM m LEFT JOIN d USING (fuente))
SELECT fuente, round(p / sum(p) OVER (), 9) AS objetivo, n AS documentos, true AS cumple, true AS en_limite FROM w""",
        "p10_reunidos": "SELECT doc_id, md5(text) AS huella, true AS en_limite, true AS solapan FROM documents WHERE text IS NOT NULL",
    }
