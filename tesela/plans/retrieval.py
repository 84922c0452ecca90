"""Queries over normalisation, weighting, index and search, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, normalize, weighting
from ..functions.policy import FLAGS, PRESETS, Model, Policy
from ..operators import index as ix
from ..operators import search as se
from ..session import scratch_path, table, text_table
from . import stems

Query = Callable[[SparkSession, str], DataFrame]
_MINIMAL = PRESETS["minimo"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "coleccion").select("doc_id", "hash_url", "texto")


def _index(spark: SparkSession, d: str, policy: str = "minimo", model: Model = Model(), keep: bool = True) -> ix.Index:
    return ix.build_index(_docs(spark, d), PRESETS[policy], model, keep=keep)


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, d: str, policy: str = "minimo") -> ix.Index:
    """The written index of a collection, which the searches read; built on the first call of a session."""
    key = (spark.sparkContext.applicationId, d, policy)
    if key not in _WRITTEN:
        path = scratch_path(spark, f"index-{policy}-{uuid.uuid4().hex[:12]}")
        ix.write_index(_index(spark, d, policy), path)
        _WRITTEN[key] = path
    return ix.read_index(spark, _WRITTEN[key])


def i7_blocks(spark, d):
    """Blocks built apart and merged give the postings of one build."""
    path = scratch_path(spark, f"blocks-{uuid.uuid4().hex[:12]}")
    docs = _docs(spark, d)
    ix.write_blocks(docs, _MINIMAL, path, 500)
    return ix.merge_blocks(spark, path, docs, _MINIMAL).postings.select("termino", "doc_id", "tf", F.round("peso", 6).alias("peso"))


def i9_reconciled(spark, d):
    n = table(spark, d, "coleccion").agg(F.count("*").alias("n_docs"))
    return ix.reconcile_blocks(table(spark, d, "postings"), table(spark, d, "terminos"), n).withColumn("idf", F.round("idf", 9))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluacion").select(F.col("item_id").alias("consulta_id"), F.col("texto").alias("consulta"))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """The query batch that grows with the collection: the rows whose id is divisible by 100 (``c…``), and the evaluation texts (``e…``)."""
    own = table(spark, d, "coleccion").where(F.col("doc_id") % 100 == 0).select(F.concat(F.lit("c"), "doc_id").alias("consulta_id"), F.col("texto").alias("consulta"))
    return own.unionByName(_questions(spark, d).withColumn("consulta_id", F.concat(F.lit("e"), "consulta_id")))


def n1_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(normalize.clean(F.col("texto"))).alias("huella"))


def _strings(spark, d):
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    return o.join(p, F.pmod(F.col("o_orderkey"), F.lit(197)) == F.col("p_partkey")).select(
        "o_orderkey", F.concat_ws(" ", F.col("p_name"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy"), F.col("p_size").cast("string"), F.format_string("%d.5", F.col("o_custkey"))).alias("texto"))


def _line_strings(spark, d):
    """One text per order line, by the tables' own keys: every part that was ever ordered occurs."""
    li, p, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey").join(p.select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(o.select("o_orderkey", "o_orderdate", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.concat_ws(" ", F.col("p_name"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy"), F.col("p_size").cast("string"), F.format_string("%d.5", F.col("o_custkey"))).alias("texto"))


def _tagged(df, *keys):
    t = normalize.tag_dates(F.col("texto"))
    return df.select(*keys, F.md5(t).alias("fechas"), F.md5(normalize.tag_numbers(t, "token")).alias("numeros"), F.md5(normalize.tag_numbers(t, "descartar")).alias("sin_numeros"))


def n2_tags(spark, d):
    return _tagged(_strings(spark, d), "o_orderkey")


def n2_line_tags(spark, d):
    return _tagged(_line_strings(spark, d), "l_orderkey", "l_linenumber")


def _joined(tokens):
    return F.md5(F.array_join(tokens, " "))


def n5_tokens(spark, d):
    t = normalize.tokenize(normalize.clean(F.col("texto")))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n"), _joined(t).alias("tokens"), _joined(normalize.lower_tokens(t)).alias("minusculas"))


def n7_accents(spark, d):
    return table(spark, d, "terminos").select("termino").distinct().select("termino", normalize.strip_accents(F.col("termino")).alias("sin_acentos"))


def n8_language(spark, d):
    t = normalize.base_tokens(F.col("texto"), _MINIMAL)
    return _docs(spark, d).select("doc_id", normalize.votes(t, lexicon.spanish_stopwords()).alias("votos_es"), normalize.votes(t, lexicon.english_stopwords()).alias("votos_en"), normalize.detect_language(t).alias("idioma"))


def n9_language_text(spark, d):
    return _docs(spark, d).select("doc_id", normalize.detect_text_language(F.col("texto")).alias("idioma"))


def _filtered(spark, d, policy):
    return normalize.tokens(_docs(spark, d), policy).select("doc_id", "idioma_doc", "tokens")


def n10_length(spark, d):
    return _filtered(spark, d, _MINIMAL).select("doc_id", F.size("tokens").alias("n"), _joined("tokens").alias("tokens"))


def n11_stopwords(spark, d):
    return _filtered(spark, d, Policy(stemming=False)).select("doc_id", F.size("tokens").alias("n"), _joined("tokens").alias("tokens"))


def n12_thesaurus(spark, d):
    return _filtered(spark, d, Policy(stemming=False, stopwords=False, expandir_sinonimos=True)).select("doc_id", F.size("tokens").alias("n"), _joined("tokens").alias("tokens"))


def n13_stems(spark, d):
    vocab = table(spark, d, "terminos").select("termino").distinct().crossJoin(F.broadcast(spark.createDataFrame([("es",), ("en",)], "idioma_doc string")))
    return normalize.stem_vocabulary(vocab)


def n14_advanced(spark, d):
    """Ordered tokens of the fullest policy, stems joined from the vocabulary."""
    words = _filtered(spark, d, PRESETS["avanzado"]).select("doc_id", "idioma_doc", F.posexplode("tokens").alias("pos", "termino"))
    return words.join(normalize.stem_vocabulary(words), ["termino", "idioma_doc"]).select("doc_id", "pos", F.col("raiz").alias("termino"))


def n15_token_rows(spark, d):
    return _filtered(spark, d, _MINIMAL).select("doc_id", F.posexplode("tokens").alias("pos", "termino"))


def n16_variants(spark, d):
    return table(spark, d, "terminos").select("termino").distinct().withColumn("variantes", normalize.search_variants(F.col("termino"), Policy()))


def m1_tf(spark, d):
    tf = table(spark, d, "postings").select("tf").distinct()
    return tf.select("tf", *[F.round(weighting.tf_weight(F.col("tf"), s), 9).alias(s) for s in ("logaritmico", "sublineal", "binario", "natural")])


def m2_idf(spark, d):
    dfs = table(spark, d, "terminos").select("df").distinct().crossJoin(table(spark, d, "coleccion").agg(F.count("*").alias("n")))
    cols = [F.round(weighting.idf_weight(F.col("n"), F.col("df"), s, smooth), 9).alias(f"{s}_{'suave' if smooth else 'crudo'}") for s in ("estandar", "probabilistico", "ninguno") for smooth in (True, False)]
    return dfs.select("df", *cols)


def m5_similarity(spark, d):
    p = table(spark, d, "postings").groupBy("doc_id").agg(F.sum("tf").alias("producto"), F.max("tf").alias("norma_d"))
    s = lambda norm, cosine=True: F.round(weighting.similarity(F.col("producto").cast("double"), F.lit(2.0), norm.cast("double"), cosine), 9)
    return p.select("doc_id", s(F.col("norma_d")).alias("coseno"), s(F.lit(0.0)).alias("norma_cero"), s(F.col("norma_d"), False).alias("producto_punto"))


def i1_frequencies(spark, d):
    return ix.occurrences(_docs(spark, d), _MINIMAL)


def i2_dictionary(spark, d):
    return _index(spark, d).terminos.select("termino", "df", F.round("idf", 9).alias("idf"))


def i3_postings(spark, d):
    return _index(spark, d).postings.select("termino", "doc_id", "tf", F.round("peso", 6).alias("peso"))


def i4_documents(spark, d):
    return _index(spark, d).documentos.select("doc_id", "hash_url", "num_tokens", F.round("norma", 6).alias("norma"))


def i6_totals(spark, d):
    return _index(spark, d).meta


def i11_probabilistic(spark, d):
    return _index(spark, d, model=Model("binario", "probabilistico", True, False)).postings.select("termino", "doc_id", F.round("peso", 6).alias("peso"))


def i12_policies(spark, d):
    out = None
    for name in PRESETS:
        m = ix.metrics(_index(spark, d, name), name)
        out = m if out is None else out.unionByName(m)
    return out


def i12_build(spark, d, policy):
    """The build of one policy and its figures."""
    return ix.metrics(_index(spark, d, policy), policy)


def s4_document(spark, d):
    """Point reads by document number."""
    return _stored(spark, d).documentos.where(F.col("doc_id").isin(0, 7, 77)).select("doc_id", "hash_url", "num_tokens")


def s7_postings(spark, d):
    return _stored(spark, d).postings.where(F.col("termino") == "guion").select("doc_id", "tf", F.round("peso", 6).alias("peso"))


def s10_layout(spark, d):
    return ix.layout(_stored(spark, d))


def s11_verify(spark, d):
    return ix.verify(_stored(spark, d))


def s12_inspect(spark, d):
    """First terms with their first postings."""
    index = _stored(spark, d)
    first = index.terminos.orderBy("termino").limit(5)
    top = Window.partitionBy("termino").orderBy("doc_id")
    return index.postings.join(F.broadcast(first), "termino").withColumn("k", F.row_number().over(top)).where(F.col("k") <= 4).select("termino", "df", "k", "doc_id", "tf")


def s13_term(spark, d):
    index = _stored(spark, d)
    return se.term_report(index, "guion").unionByName(se.term_report(index, "guioxyz")).withColumn("peso", F.round("peso", 6))


def s19_flags(spark, d):
    rows = [(name, p.flags(), *[bool(p.flags() & bit) for bit in FLAGS.values()]) for name, p in PRESETS.items()]
    return spark.createDataFrame(rows, "politica string, mascara int, " + ", ".join(f"{n} boolean" for n in FLAGS))


def q1_lookup(spark, d):
    return se.lookup(_stored(spark, d), "guion").select("termino", "df", F.round("idf", 9).alias("idf"))


def q2_prefix(spark, d):
    return se.prefix_lookup(_stored(spark, d), "gui").select("termino", "df")


def q3_variants(spark, d, questions=_questions, policy="minimo"):
    index = _stored(spark, d, policy)
    return se.resolve(se.query_tokens(questions(spark, d), index), index).select("consulta_id", "token", "termino", "df", "orden")


def q4_weights(spark, d, questions=_questions, policy="minimo"):
    index = _stored(spark, d, policy)
    w = se.query_weights(se.resolve(se.query_tokens(questions(spark, d), index), index), index)
    return w.select("consulta_id", "termino", F.round("peso_q", 6).alias("peso_q"))


def _ranking(spark, d, policy, top=10, questions=_questions):
    return se.search(questions(spark, d), _stored(spark, d, policy), top).select("consulta_id", "puesto", "doc_id", "hash_url", "num_tokens", "similitud")


def q5_scores(spark, d, questions=_questions):
    return _ranking(spark, d, "minimo", 0, questions).select("consulta_id", "doc_id", "similitud")


def q6_ranking(spark, d):
    return _ranking(spark, d, "minimo")


def q6_standard(spark, d):
    return _ranking(spark, d, "estandar")


def q6_advanced(spark, d):
    return _ranking(spark, d, "avanzado")


def q7_missing(spark, d, questions=_questions):
    index = _stored(spark, d)
    return se.missing_terms(se.query_tokens(questions(spark, d), index), index)


def q8_suggestions(spark, d):
    """Misspelt single words: the opening letters of evaluation texts with a wrong ending."""
    index = _stored(spark, d)
    wrong = _questions(spark, d).select("consulta_id", F.concat(F.substring(F.lower("consulta"), 1, 5), F.lit("qzx")).alias("consulta"))
    return se.suggestions(se.query_tokens(wrong, index), index)


def queries() -> dict[str, Query]:
    named = {
        "n1_clean": n1_clean, "n2_n4_tags": n2_tags, "n2_n4_lineas": n2_line_tags, "n5_n6_tokens": n5_tokens, "n7_accents": n7_accents, "n8_language": n8_language, "n9_language_text": n9_language_text, "n10_n14_minimal": n10_length,
        "n11_stopwords": n11_stopwords, "n12_thesaurus": n12_thesaurus, "n13_stems": n13_stems, "n14_advanced": n14_advanced, "n15_token_rows": n15_token_rows, "n16_variants": n16_variants,
        "m1_tf": m1_tf, "m2_m4_idf": m2_idf, "m5_similarity": m5_similarity, "i1_frequencies": i1_frequencies, "i2_s6_dictionary": i2_dictionary, "i3_postings": i3_postings, "i4_i5_s5_documents": i4_documents,
        "i6_q9_totals": i6_totals, "i7_i9_blocks": i7_blocks, "i9_reconciled": i9_reconciled, "i11_probabilistic": i11_probabilistic, "i12_minimal": partial(i12_build, policy="minimo"), "i12_estandar": partial(i12_build, policy="estandar"), "i12_avanzado": partial(i12_build, policy="avanzado"), "i12_policies": i12_policies, "s4_document": s4_document, "s7_postings": s7_postings, "s10_layout": s10_layout,
        "s11_verify": s11_verify, "s12_inspect": s12_inspect, "s13_term": s13_term, "s19_flags": s19_flags, "q1_lookup": q1_lookup, "q2_prefix": q2_prefix, "q3_variants": q3_variants, "q4_weights": q4_weights, "q3_variants_estandar": partial(q3_variants, policy="estandar"), "q4_weights_estandar": partial(q4_weights, policy="estandar"),
        "q5_scores": q5_scores, "q6_ranking": q6_ranking, "q6_standard": q6_standard, "q6_advanced": q6_advanced, "q7_missing": q7_missing, "q8_suggestions": q8_suggestions,
    }
    for name, f in (("q3_variants", q3_variants), ("q4_weights", q4_weights), ("q5_scores", q5_scores), ("q7_missing", q7_missing)):
        named[f"{name}_lote"] = partial(f, questions=_batch)
    for name, policy in (("q6_ranking", "minimo"), ("q6_standard", "estandar"), ("q6_advanced", "avanzado")):
        named[f"{name}_lote"] = partial(_ranking, policy=policy, questions=_batch)
    return named


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


#: Compatibility forms that occur in the texts: ellipsis and no-break space.
_CLEAN = "replace(replace(replace(replace(translate(replace(replace(nfc_normalize({t}), '…', '...'), chr(160), ' '), '’‘`“”«»', '''''''\"\"\"\"'), '—', ' - '), '–', ' - '), 'ª', 'a'), 'º', 'o')"
_TOKENS = "regexp_extract_all({t}, '<[A-Z0-9_]+>|[\\p{{L}}\\p{{N}}]+(?:[-''_][\\p{{L}}\\p{{N}}]+)*')"
_LOWER = "list_transform({t}, lambda x: CASE WHEN regexp_matches(x, '^<.*>$') THEN x ELSE lower(x) END)"
_BASE = _LOWER.format(t=_TOKENS.format(t=_CLEAN.format(t="texto")))
_KEPT = "list_filter({t}, lambda x: regexp_matches(x, '^<.*>$') OR length(x) BETWEEN 2 AND 50)"

_TOK = f"tok AS (SELECT doc_id, hash_url, {_KEPT.format(t=_BASE)} AS t FROM coleccion)"
_TF = f"{_TOK}, tf AS (SELECT termino, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS termino FROM tok) GROUP BY termino, doc_id)"
_IX = f"""{_TF}, n AS (SELECT count(*) AS n FROM coleccion),
te AS (SELECT termino, count(*) AS df, ln((SELECT n FROM n)::DOUBLE / count(*) + 1) AS idf FROM tf GROUP BY termino),
po AS (SELECT tf.termino, doc_id, tf, (1 + ln(tf::DOUBLE)) * idf AS peso FROM tf JOIN te USING (termino)),
dn AS (SELECT doc_id, sqrt(sum(peso * peso)) AS norma FROM po GROUP BY doc_id),
dc AS (SELECT tok.doc_id, hash_url, len(t)::INTEGER AS num_tokens, coalesce(norma, 0.0) AS norma FROM tok LEFT JOIN dn USING (doc_id)),
me AS (SELECT (SELECT n FROM n) AS total_docs, count(*) AS total_terminos, sum(df)::BIGINT AS total_postings, 64 + 44 * (SELECT n FROM n) AS od, 64 + 44 * (SELECT n FROM n) + 22 * count(*) + sum(strlen(termino))::BIGINT AS op FROM te)"""
_QX = f"""{_IX}, q0 AS (SELECT item_id AS consulta_id, unnest({_KEPT.format(t=_BASE)}) AS token, generate_subscripts({_KEPT.format(t=_BASE)}, 1) AS pos FROM evaluacion),
qt AS (SELECT consulta_id, token, count(*) AS tf, min(pos) AS pos FROM q0 GROUP BY consulta_id, token),
qr AS (SELECT consulta_id, token, tf, te.termino, df, idf, 1::INTEGER AS orden FROM qt JOIN te ON te.termino = qt.token),
qw AS (SELECT consulta_id, termino, (1 + ln(tf::DOUBLE)) * idf AS peso_q FROM qr),
qn AS (SELECT consulta_id, sqrt(sum(peso_q * peso_q)) AS norma_q FROM qw GROUP BY consulta_id),
sc AS (SELECT consulta_id, doc_id, hash_url, num_tokens, round(p / (norma_q * CASE WHEN norma = 0 THEN 1 ELSE norma END), 6) AS similitud
       FROM (SELECT consulta_id, doc_id, sum(peso * peso_q) AS p FROM po JOIN qw USING (termino) GROUP BY consulta_id, doc_id) JOIN qn USING (consulta_id) JOIN dc USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY consulta_id ORDER BY similitud DESC, doc_id)::INTEGER AS puesto FROM sc)"""


# FIXED VALUES: dates, years of film and numbers, as the policies tag them.
_DATES = r"[0-9]{1,2}[/-][0-9]{1,2}[/-](?:18|19|20)[0-9]{2}|(?:18|19|20)[0-9]{2}[/-][0-9]{1,2}[/-][0-9]{1,2}"
_YEARS = r"(188[89]|189[0-9]|19[0-9]{2}|20[0-9]{2})"
_NUMBERS = r"[0-9]+(?:[.,][0-9]+)?"


def _dated(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '\\b(?:{_DATES})\\b', ' <FECHA> ', 'g'), '\\b{_YEARS}\\b', ' <ANIO_\\1> ', 'g')"


def _votes(tokens: str, words: str) -> str:
    return f"len(list_filter(({tokens})[1:300], lambda x: list_contains({words}, lower(x))))::INTEGER"


def _language(tokens: str) -> str:
    return f"CASE WHEN {_votes(tokens, _list(lexicon.english_stopwords()))} > {_votes(tokens, _list(lexicon.spanish_stopwords()))} THEN 'en' ELSE 'es' END"


def _concepts(tokens: str) -> str:
    t = lexicon.thesaurus()
    keys = sorted(t)
    m = "map([" + ", ".join(f"'{k}'" for k in keys) + "], [" + ", ".join(f"'{t[k]}'" for k in keys) + "])"
    return f"list_transform({tokens}, lambda x: CASE WHEN regexp_matches(x, '^<.*>$') THEN x ELSE coalesce({m}[x], {m}[strip_accents(x)], x) END)"


def _thesaurus_sql() -> str:
    return f"SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string({_concepts('t')}, ' ')) AS tokens FROM (SELECT doc_id, {_KEPT.format(t=_BASE)} AS t FROM coleccion)"


def _stemmed(policy: Policy, questions: bool = True) -> str:
    """Common tables of a stemming policy up to ``x(clase, id, pos, termino)``: the tokens of the collection (``c``) and of the evaluation texts (``q``)."""
    text = _CLEAN.format(t="texto")
    text = _dated(text) if policy.normalizar_fechas else text
    text = f"regexp_replace({text}, '\\b{_NUMBERS}\\b', ' <NUM> ', 'g')" if policy.normalizar_numeros else text
    kept = f"list_filter({_KEPT.format(t='t')}, lambda x: NOT list_contains({_list(lexicon.stopwords())}, x))"
    kept = _concepts(kept) if policy.expandir_sinonimos else kept
    asked = " UNION ALL SELECT 'q', item_id, texto FROM evaluacion" if questions else ""
    return f"""src AS (SELECT 'c' AS clase, doc_id AS id, texto FROM coleccion{asked}),
bt AS MATERIALIZED (SELECT clase, id, {_LOWER.format(t=_TOKENS.format(t=text))} AS t FROM src),
kt AS MATERIALIZED (SELECT clase, id, {_language('t')} AS idioma_doc, {kept} AS t FROM bt),
w AS MATERIALIZED (SELECT clase, id, idioma_doc, unnest(t) AS termino, generate_subscripts(t, 1) - 1 AS pos FROM kt),
{stems.both('st', 'SELECT termino FROM w')}, x AS MATERIALIZED (SELECT clase, id, pos, raiz AS termino FROM w JOIN st USING (termino, idioma_doc))"""


def _stemmed_index(policy: Policy, questions: bool = True) -> str:
    """… up to ``te``, ``po`` and ``dc``, and ``me`` with the totals."""
    return f"""{_stemmed(policy, questions)}, n AS (SELECT count(*) AS n FROM coleccion),
tf AS MATERIALIZED (SELECT termino, id AS doc_id, count(*) AS tf FROM x WHERE clase = 'c' GROUP BY ALL),
te AS MATERIALIZED (SELECT termino, count(*) AS df, ln((SELECT n FROM n)::DOUBLE / count(*) + 1) AS idf FROM tf GROUP BY termino),
po AS MATERIALIZED (SELECT tf.termino, doc_id, tf, (1 + ln(tf::DOUBLE)) * idf AS peso FROM tf JOIN te USING (termino)),
dn AS (SELECT doc_id, sqrt(sum(peso * peso)) AS norma, sum(tf)::INTEGER AS num_tokens FROM po GROUP BY doc_id),
dc AS (SELECT c.doc_id, hash_url, coalesce(num_tokens, 0) AS num_tokens, coalesce(norma, 0.0) AS norma FROM coleccion c LEFT JOIN dn USING (doc_id)),
me AS (SELECT (SELECT n FROM n) AS total_docs, count(*) AS total_terminos, sum(df)::BIGINT AS total_postings, 64 + 44 * (SELECT n FROM n) + 22 * count(*) + sum(strlen(termino))::BIGINT AS op FROM te)"""


def _stemmed_search(policy: Policy) -> str:
    """… up to the resolved query terms ``qr``, their weights ``qw`` and the ranking ``rk``."""
    tokens = "SELECT token AS termino FROM qt"
    return f"""{_stemmed_index(policy)}, qt AS MATERIALIZED (SELECT id AS consulta_id, termino AS token, count(*) AS tf, min(pos) AS pos FROM x WHERE clase = 'q' GROUP BY ALL),
{stems.spanish('ve', tokens)}, {stems.english('vn', tokens)},
qv AS (SELECT DISTINCT consulta_id, token, tf, pos, unnest(CASE WHEN regexp_matches(token, '^<.*>$') THEN [token] ELSE [token, ve.raiz, vn.raiz] END) AS termino FROM qt JOIN ve ON ve.termino = token JOIN vn ON vn.termino = token),
qr AS MATERIALIZED (SELECT consulta_id, token, tf, pos, te.termino, df, idf, row_number() OVER (PARTITION BY consulta_id, token ORDER BY df DESC, encode(te.termino))::INTEGER AS orden FROM qv JOIN te USING (termino)),
qw AS MATERIALIZED (SELECT consulta_id, termino, arg_min((1 + ln(tf::DOUBLE)) * idf, pos * 10 + orden) AS peso_q FROM qr GROUP BY ALL),
qn AS (SELECT consulta_id, sqrt(sum(peso_q * peso_q)) AS norma_q FROM qw GROUP BY consulta_id),
sc AS (SELECT consulta_id, doc_id, hash_url, num_tokens, round(p / (norma_q * CASE WHEN norma = 0 THEN 1 ELSE norma END), 6) AS similitud
       FROM (SELECT consulta_id, doc_id, sum(peso * peso_q) AS p FROM po JOIN qw USING (termino) GROUP BY consulta_id, doc_id) JOIN qn USING (consulta_id) JOIN dc USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY consulta_id ORDER BY similitud DESC, doc_id)::INTEGER AS puesto FROM sc)"""


def _metrics_sql(name: str, tables: str) -> str:
    return f"WITH {tables} SELECT '{name}' AS politica, total_docs, total_terminos, total_postings, op + 12 * total_postings AS bytes, round(total_postings::DOUBLE / total_terminos, 6) AS postings_por_termino, round((op + 12 * total_postings)::DOUBLE / total_docs, 6) AS bytes_por_documento FROM me"


def oracle_sql() -> dict[str, str]:
    es, en = _list(lexicon.spanish_stopwords()), _list(lexicon.english_stopwords())
    vote = _votes
    raw = _TOKENS.format(t=_CLEAN.format(t="texto"))
    lead = _TOKENS.format(t="substr(lower(texto), 1, 2000)")
    date, year, number = r"[0-9]{1,2}/[0-9]{1,2}/(?:18|19|20)[0-9]{2}|(?:18|19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}", r"(188[89]|189[0-9]|19[0-9]{2}|20[0-9]{2})", r"[0-9]+(?:[.,][0-9]+)?"
    strings = "SELECT o_orderkey, concat_ws(' ', p_name, strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y'), p_size::VARCHAR, o_custkey::VARCHAR || '.5') AS texto FROM orders JOIN part ON o_orderkey % 197 = p_partkey"
    line_strings = strings.replace("SELECT o_orderkey,", "SELECT l_orderkey, l_linenumber,").replace("FROM orders JOIN part ON o_orderkey % 197 = p_partkey", "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
    tagged = f"regexp_replace(regexp_replace(texto, '\\b(?:{date})\\b', ' <FECHA> ', 'g'), '\\b{year}\\b', ' <ANIO_\\1> ', 'g')"
    idf = lambda e: f"round(CASE WHEN df <= 0 OR n <= 0 THEN 0.0 ELSE {e} END, 9)"
    flags = ", ".join(f"(mascara & {bit}) > 0 AS {name}" for name, bit in FLAGS.items())
    posting = "SELECT 'posting' AS clase, po.termino, doc_id, tf, round(peso, 6) AS peso, df FROM po JOIN te USING (termino) WHERE po.termino = 'guion' ORDER BY doc_id LIMIT 10"
    wrong = _KEPT.format(t=_LOWER.format(t=_TOKENS.format(t=_CLEAN.format(t="substr(lower(texto), 1, 5) || 'qzx'"))))
    queries = {
        "q8_suggestions": f"""WITH {_IX}, w AS (SELECT item_id AS consulta_id, unnest({wrong}) AS token, generate_subscripts({wrong}, 1) AS pos FROM evaluacion),
t AS (SELECT consulta_id, token, min(pos) AS pos FROM w GROUP BY ALL), l AS (SELECT * FROM t WHERE consulta_id NOT IN (SELECT consulta_id FROM t JOIN te ON termino = token)),
f AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY encode(termino)) AS k FROM (SELECT DISTINCT substr(token, 1, 4) AS x FROM l) JOIN te ON starts_with(termino, x) QUALIFY k <= 5),
o AS (SELECT consulta_id, termino, min((pos, k)) AS o FROM l JOIN f ON x = substr(token, 1, 4) GROUP BY ALL)
SELECT consulta_id, puesto::INTEGER AS puesto, termino FROM (SELECT *, row_number() OVER (PARTITION BY consulta_id ORDER BY o, encode(termino)) AS puesto FROM o) WHERE puesto <= 5""",
        "n1_clean": f"SELECT doc_id, md5({_CLEAN.format(t='texto')}) AS huella FROM coleccion",
        "n2_n4_tags": f"SELECT o_orderkey, md5({tagged}) AS fechas, md5(regexp_replace({tagged}, '\\b{number}\\b', ' <NUM> ', 'g')) AS numeros, md5(regexp_replace({tagged}, '\\b{number}\\b', ' ', 'g')) AS sin_numeros FROM ({strings})",
        "n2_n4_lineas": f"SELECT l_orderkey, l_linenumber, md5({tagged}) AS fechas, md5(regexp_replace({tagged}, '\\b{number}\\b', ' <NUM> ', 'g')) AS numeros, md5(regexp_replace({tagged}, '\\b{number}\\b', ' ', 'g')) AS sin_numeros FROM ({line_strings})",
        "n5_n6_tokens": f"SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, ' ')) AS tokens, md5(array_to_string({_LOWER.format(t='t')}, ' ')) AS minusculas FROM (SELECT doc_id, {raw} AS t FROM coleccion)",
        "n7_accents": "SELECT DISTINCT termino, strip_accents(termino) AS sin_acentos FROM terminos",
        "n8_language": f"SELECT doc_id, {vote('t', es)} AS votos_es, {vote('t', en)} AS votos_en, CASE WHEN {vote('t', en)} > {vote('t', es)} THEN 'en' ELSE 'es' END AS idioma FROM (SELECT doc_id, {_BASE} AS t FROM coleccion)",
        "n9_language_text": f"SELECT doc_id, CASE WHEN regexp_matches(lower(texto), '[áéíóúñ¿¡]') THEN 'es' WHEN {vote(lead, en)} > {vote(lead, es)} THEN 'en' ELSE 'es' END AS idioma FROM coleccion",
        "n10_n14_minimal": f"WITH {_TOK} SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, ' ')) AS tokens FROM tok",
        "n11_stopwords": f"WITH {_TOK} SELECT doc_id, len(u)::INTEGER AS n, md5(array_to_string(u, ' ')) AS tokens FROM (SELECT doc_id, list_filter(t, lambda x: NOT list_contains({_list(lexicon.stopwords())}, x)) AS u FROM tok)",
        "n12_thesaurus": _thesaurus_sql(),
        "n15_token_rows": f"WITH {_TOK} SELECT doc_id, (generate_subscripts(t, 1) - 1)::INTEGER AS pos, unnest(t) AS termino FROM tok",
        "m1_tf": "SELECT DISTINCT tf, " + ", ".join(f"round(CASE WHEN tf <= 0 THEN 0.0 ELSE {e} END, 9) AS {s}" for s, e in (("logaritmico", "1 + ln(tf::DOUBLE)"), ("sublineal", "1 + ln(tf::DOUBLE)"), ("binario", "1.0::DOUBLE"), ("natural", "tf::DOUBLE"))) + " FROM postings",
        "m2_m4_idf": "SELECT DISTINCT df, " + ", ".join((
            idf("ln(n::DOUBLE / df + 1)") + " AS estandar_suave", idf("ln(n::DOUBLE / df)") + " AS estandar_crudo", idf("greatest(0, ln(CASE WHEN (n - df)::DOUBLE / df + 1 > 0 THEN (n - df)::DOUBLE / df + 1 END))") + " AS probabilistico_suave",
            idf("coalesce(greatest(0, ln(CASE WHEN n > df THEN (n - df)::DOUBLE / df END)), 0)") + " AS probabilistico_crudo", "1.0::DOUBLE AS ninguno_suave", "1.0::DOUBLE AS ninguno_crudo")) + " FROM terminos, (SELECT count(*) AS n FROM coleccion)",
        "m5_similarity": "SELECT doc_id, round(CASE WHEN 2.0 * CASE WHEN m = 0 THEN 1 ELSE m END <= 0 THEN 0 ELSE p::DOUBLE / (2.0::DOUBLE * CASE WHEN m = 0 THEN 1 ELSE m END) END, 9) AS coseno, round(p::DOUBLE / 2, 9) AS norma_cero, p::DOUBLE AS producto_punto FROM (SELECT doc_id, sum(tf) AS p, max(tf) AS m FROM postings GROUP BY doc_id)",
        "i1_frequencies": f"WITH {_TF} SELECT * FROM tf",
        "i2_s6_dictionary": f"WITH {_IX} SELECT termino, df, round(idf, 9) AS idf FROM te",
        "i3_postings": f"WITH {_IX} SELECT termino, doc_id, tf, round(peso, 6) AS peso FROM po",
        "i7_i9_blocks": f"WITH {_IX} SELECT termino, doc_id, tf, round(peso, 6) AS peso FROM po",
        "i9_reconciled": """WITH p AS (SELECT termino, count(DISTINCT bloque)::INTEGER AS bloques, count(DISTINCT doc_id) AS df FROM postings WHERE termino IS NOT NULL AND doc_id IS NOT NULL GROUP BY termino),
s AS (SELECT termino, sum(df)::BIGINT AS g FROM (SELECT termino, bloque, max(df) AS df FROM terminos WHERE termino IS NOT NULL GROUP BY ALL) GROUP BY termino)
SELECT termino, bloques, df, round(ln((SELECT count(*) FROM coleccion)::DOUBLE / df + 1), 9) AS idf, coalesce(g, 0) AS df_guardada FROM p LEFT JOIN s USING (termino)""",
        "i4_i5_s5_documents": f"WITH {_IX} SELECT doc_id, hash_url, num_tokens, round(norma, 6) AS norma FROM dc",
        "i6_q9_totals": f"WITH {_IX} SELECT '{ix.SIGNATURE}' AS firma, 1 AS version, {_MINIMAL.flags()} AS flags, total_docs, total_terminos, total_postings, 64::BIGINT AS offset_docs, od AS offset_diccionario, op AS offset_postings, 'logaritmico' AS esquema_tf, 'estandar' AS esquema_idf, true AS coseno, true AS suavizado FROM me",
        "i11_probabilistic": f"WITH {_TF.replace('tf AS (', 'tf AS MATERIALIZED (')}, n AS (SELECT count(*) AS n FROM coleccion), te AS MATERIALIZED (SELECT termino, count(*) AS df FROM tf GROUP BY termino) SELECT tf.termino, doc_id, round(coalesce(greatest(0, ln(CASE WHEN n > df THEN (n - df)::DOUBLE / df END)), 0), 6) AS peso FROM tf JOIN te USING (termino) CROSS JOIN n",
        "i12_minimal": _metrics_sql("minimo", _IX),
        "i12_policies": " UNION ALL ".join(f"SELECT * FROM ({_metrics_sql(name, _IX if name == 'minimo' else _stemmed_index(PRESETS[name], False))})" for name in PRESETS),
        "i12_estandar": _metrics_sql("estandar", _stemmed_index(PRESETS["estandar"], False)),
        "i12_avanzado": _metrics_sql("avanzado", _stemmed_index(PRESETS["avanzado"], False)),
        "n13_stems": f"WITH {stems.both('st', 'SELECT termino FROM terminos')} SELECT termino, idioma_doc, raiz FROM st",
        "n14_advanced": f"WITH {_stemmed(PRESETS['avanzado'], False)} SELECT id AS doc_id, pos::INTEGER AS pos, termino FROM x",
        "n16_variants": f"WITH {stems.spanish('ve', 'SELECT termino FROM terminos')}, {stems.english('vn', 'SELECT termino FROM terminos')} SELECT termino, CASE WHEN regexp_matches(termino, '^<.*>$') THEN [termino] ELSE list_concat([termino], CASE WHEN ve.raiz <> termino THEN [ve.raiz] ELSE [] END, CASE WHEN vn.raiz NOT IN (termino, ve.raiz) THEN [vn.raiz] ELSE [] END) END AS variantes FROM ve JOIN vn USING (termino)",
        "q3_variants_estandar": f"WITH {_stemmed_search(PRESETS['estandar'])} SELECT consulta_id, token, termino, df, orden FROM qr",
        "q4_weights_estandar": f"WITH {_stemmed_search(PRESETS['estandar'])} SELECT consulta_id, termino, round(peso_q, 6) AS peso_q FROM qw",
        "q6_standard": f"WITH {_stemmed_search(PRESETS['estandar'])} SELECT consulta_id, puesto, doc_id, hash_url, num_tokens, similitud FROM rk WHERE puesto <= 10",
        "q6_advanced": f"WITH {_stemmed_search(PRESETS['avanzado'])} SELECT consulta_id, puesto, doc_id, hash_url, num_tokens, similitud FROM rk WHERE puesto <= 10",
        "s4_document": f"WITH {_IX} SELECT doc_id, hash_url, num_tokens FROM dc WHERE doc_id IN (0, 7, 77)",
        "s7_postings": f"WITH {_IX} SELECT doc_id, tf, round(peso, 6) AS peso FROM po WHERE termino = 'guion'",
        "s10_layout": f"WITH {_IX} SELECT termino, df, (op + 12 * coalesce(sum(df) OVER (ORDER BY encode(termino) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\", 12 * df AS bytes FROM te, me",
        "s11_verify": "SELECT unnest(['offset_docs', 'offset_diccionario', 'offsets_en_orden', 'terminos', 'terminos_repetidos', 'postings', 'postings_df', 'df_por_termino', 'documentos_ajenos']) AS comprobacion, 0::BIGINT AS problemas",
        "s12_inspect": f"WITH {_IX}, f AS (SELECT termino, df FROM te ORDER BY encode(termino) LIMIT 5) SELECT * FROM (SELECT termino, df, row_number() OVER (PARTITION BY termino ORDER BY doc_id)::INTEGER AS k, doc_id, tf FROM po JOIN f USING (termino)) WHERE k <= 4",
        "s13_term": f"WITH {_IX}, a AS ({posting}) SELECT * FROM a UNION ALL (SELECT 'parecido', termino, NULL, NULL, NULL, df FROM te WHERE starts_with(termino, 'guio') ORDER BY encode(termino) LIMIT 10)",
        "s19_flags": "SELECT politica, mascara, " + flags + " FROM (VALUES ('minimo', 3), ('estandar', 15), ('avanzado', 127)) v(politica, mascara)",
        "q1_lookup": f"WITH {_IX} SELECT termino, df, round(idf, 9) AS idf FROM te WHERE termino = 'guion'",
        "q2_prefix": f"WITH {_IX} SELECT termino, df FROM te WHERE starts_with(termino, 'gui') ORDER BY encode(termino) LIMIT 10",
        "q3_variants": f"WITH {_QX} SELECT consulta_id, token, termino, df, orden FROM qr",
        "q4_weights": f"WITH {_QX} SELECT consulta_id, termino, round(peso_q, 6) AS peso_q FROM qw",
        "q5_scores": f"WITH {_QX} SELECT consulta_id, doc_id, similitud FROM sc",
        "q6_ranking": f"WITH {_QX} SELECT consulta_id, puesto, doc_id, hash_url, num_tokens, similitud FROM rk WHERE puesto <= 10",
        "q7_missing": f"WITH {_QX} SELECT consulta_id, token FROM qt WHERE token NOT IN (SELECT termino FROM te)",
    }
    batch = "FROM (SELECT 'c' || doc_id AS item_id, texto FROM coleccion WHERE doc_id % 100 = 0 UNION ALL SELECT 'e' || item_id, texto FROM evaluacion))"
    for name in ("q3_variants", "q4_weights", "q5_scores", "q6_ranking", "q7_missing"):
        queries[f"{name}_lote"] = queries[name].replace("FROM evaluacion)", batch)
    return queries
