"""Text normalisation as native columns: clean, tag, tokenise, filter; stems through the vocabulary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon
from .policy import Policy
from .stem import STEMMERS

TOKEN = r"<[A-Z0-9_]+>|[\p{L}\p{N}]+(?:[-'_][\p{L}\p{N}]+)*"
_L, _R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_DATE = _L + r"(?:\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-](?:18|19|20)\p{Nd}{2}|(?:18|19|20)\p{Nd}{2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{1,2})" + _R
_YEAR = _L + r"(188[89]|189\p{Nd}|19\p{Nd}{2}|20\p{Nd}{2})" + _R
_NUMBER = _L + r"\p{Nd}+(?:[.,]\p{Nd}+)?" + _R
#: Tokens that vote for the language.
VOTERS = 300


def _icu(text: Column, method: str, compat: bool) -> Column:
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compat))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def nfc(text: Column) -> Column:
    return _icu(text, "compose", False)


def nfkc(text: Column) -> Column:
    return _icu(text, "compose", True)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return F.regexp_replace(_icu(text, "decompose", True), r"\p{Mn}", "")


def clean(text: Column) -> Column:
    """NFKC with plain quotes; long dashes become `` - ``. Null becomes empty."""
    t = F.translate(nfkc(F.coalesce(text, F.lit(""))), "’‘`“”«»", "'''\"\"\"\"")
    return F.regexp_replace(t, "[—–]", " - ")


def tag_dates(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _DATE, " <FECHA> "), _YEAR, " <ANIO_$1> ")


def tag_numbers(text: Column, mode: str) -> Column:
    if mode == "token":
        return F.regexp_replace(text, _NUMBER, " <NUM> ")
    return F.regexp_replace(text, _NUMBER, " ") if mode == "descartar" else text


def is_marker(token: Column) -> Column:
    return token.rlike("^<.*>$")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.when(is_marker(x), x).otherwise(F.lower(x)))


def votes(tokens: Column, words: frozenset[str]) -> Column:
    return F.size(F.filter(F.slice(tokens, 1, VOTERS), lambda x: F.lower(x).isin(*sorted(words))))


def detect_language(tokens: Column, fixed: str = "auto") -> Column:
    """``en`` if English stop words lead among the first tokens, else ``es``."""
    if fixed in ("es", "en"):
        return F.lit(fixed)
    return F.when(votes(tokens, lexicon.english_stopwords()) > votes(tokens, lexicon.spanish_stopwords()), "en").otherwise("es")


def detect_text_language(text: Column) -> Column:
    """The form for raw strings: Spanish letters decide, else the tokens of the first 2000 characters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("[áéíóúñ¿¡]"), "es").otherwise(detect_language(tokenize(F.substring(t, 1, 2000))))


def _stripped(tokens: Column) -> Column:
    """The tokens without accents: stripped as one text, as tokens hold no blanks."""
    return F.when(F.size(tokens) > 0, F.split(strip_accents(F.array_join(tokens, " ")), " ")).otherwise(tokens)


def base_tokens(text: Column, policy: Policy) -> Column:
    """Tokens before filtering."""
    t = clean(text)
    if policy.normalizar_fechas:
        t = tag_dates(t)
    if policy.normalizar_numeros:
        t = tag_numbers(t, policy.modo_numeros)
    tokens = tokenize(t)
    if policy.minusculas:
        tokens = lower_tokens(tokens)
    if policy.remover_acentos:
        tokens = F.zip_with(tokens, _stripped(tokens), lambda x, y: F.when(is_marker(x), x).otherwise(y))
    return tokens


def filter_length(tokens: Column, policy: Policy) -> Column:
    return F.filter(tokens, lambda x: is_marker(x) | F.char_length(x).between(policy.longitud_minima_token, policy.longitud_maxima_token))


def filter_stopwords(tokens: Column, policy: Policy) -> Column:
    words = lexicon.stopwords(policy.idiomas_stopwords) if policy.stopwords else frozenset()
    return F.filter(tokens, lambda x: is_marker(x) | ~x.isin(*sorted(words))) if words else tokens


def _concept(word: Column) -> Column:
    by: dict[str, list[str]] = {}
    for w, c in lexicon.thesaurus().items():
        by.setdefault(c, []).append(w)
    out = F.lit(None).cast("string")
    for concept, words in by.items():
        out = F.when(word.isin(*words), F.lit(concept)).otherwise(out)
    return out


def apply_thesaurus(tokens: Column) -> Column:
    """One hop: the token itself, else without accents."""
    return F.zip_with(tokens, _stripped(tokens), lambda x, y: F.when(is_marker(x), x).otherwise(F.coalesce(_concept(x), _concept(y), x)))


def tokens(df: DataFrame, policy: Policy, text_col: str = "texto") -> DataFrame:
    """``df`` with ``idioma_doc`` and ``tokens``, everything but stemming. Null texts have no tokens."""
    out = df.withColumn("tokens", base_tokens(F.col(text_col), policy)).withColumn("idioma_doc", detect_language(F.col("tokens"), policy.idioma))
    t = filter_stopwords(filter_length(F.col("tokens"), policy), policy)
    return out.withColumn("tokens", apply_thesaurus(t) if policy.expandir_sinonimos else t)


@F.pandas_udf(StringType())
def stem_udf(terms: pd.Series, languages: pd.Series) -> pd.Series:
    spanish, english = set(lexicon.SPANISH_CONCEPTS), set(lexicon.ENGLISH_CONCEPTS)

    def one(t: str | None, lang: str | None) -> str | None:
        if t is None or t[:1] == "<" and t[-1:] == ">":
            return t
        return STEMMERS["es" if t in spanish else "en" if t in english else lang or "es"](t)

    return pd.Series([one(t, g) for t, g in zip(terms, languages)])


def stem_vocabulary(df: DataFrame, term_col: str = "termino", lang_col: str = "idioma_doc") -> DataFrame:
    """``term_col, lang_col, raiz`` of the distinct pairs only: each word is stemmed once."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(term_col, lang_col).distinct().repartition(spread, term_col).withColumn("raiz", stem_udf(term_col, lang_col))


def search_variants(token: Column, policy: Policy) -> Column:
    """The token and its Spanish and English stems, distinct and in this order."""
    if not policy.stemming:
        return F.array(token)

    @F.pandas_udf("array<string>")
    def variants(terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [t] if t[:1] == "<" and t[-1:] == ">" else list(dict.fromkeys([t, *(s(t) for s in STEMMERS.values())])) for t in terms])

    return variants(token)
