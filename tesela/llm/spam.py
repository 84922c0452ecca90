"""Keyword-stuffed and link-list pages.

Every line is compressed in blocks, with the grammatical and search-phrase words
of its language as preset dictionary; the ratio is divided by what prose of the
same length and language reaches. Blocks far above it are extremely redundant,
and count as spam when they also have hardly any sentence ends. Sentences are
compressed in blocks over the lines too; from a higher ratio on, their ends are
no excuse. So are short and other lines, which count where they are most of the
page. A page is spam when most of its body characters stand in such blocks;
a page nearly there, in share or in ratio, is spam if its address is made of
search words as well.

Null and empty texts are no spam. Repeated rows give repeated results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines as L
from .arrow import map_rows
from .lexicon import search_sets

#: Share of spam characters from which the address decides.
DOUBTFUL = 0.35
#: Search words in an address that confirm a doubtful page.
URL_WORDS = 3

_SEARCH = frozenset().union(*search_sets().values()) - {"en", "in", "pas", "no", "up"}
_SLUG = re.compile(r"[^\W\d_]+")


def url_search_words(url: str | None) -> int:
    """Search words in the path of an address."""
    if not url:
        return 0
    path = url.split("://", 1)[-1].partition("/")[2]
    return sum(1 for w in _SLUG.findall(L.clean(path).lower()) if w in _SEARCH)


def _judge():
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id_": cols["id_"], "enlace_": cols["enlace_"], "proporcion_spam": [], "redundante_": [], "redundancia": []}
        for text in cols["texto_"]:
            top = 0.0
            lines = L.clean(text or "").split("\n")
            kinds = [L.line_kind(line) for line in lines]
            for line, kind in zip(lines, kinds):
                if kind == "spam":
                    top = max(top, L.line_redundancy(line))
            spam, redundant, highest = L.spam_shares(lines, kinds)
            out["proporcion_spam"].append(spam)
            out["redundante_"].append(redundant)
            out["redundancia"].append(max(top, highest))
        return out

    return run


def _judge_urls():
    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"enlace_": cols["enlace_"], "palabras_url": [url_search_words(u) for u in cols["url_"]]}

    return run


def spam_scores(pages: DataFrame, addresses: DataFrame, id_col: str = "doc_id", text_col: str = "texto", link_col: str = "db_id", address_id: str = "id", address_col: str = "url") -> DataFrame:
    """``id_col, proporcion_spam, redundancia, palabras_url, es_spam`` per row of ``pages``.

    ``addresses`` gives the stored address of ``link_col``; texts are not moved, only scores are joined.
    Of several addresses of one id the one with most search words counts; a missing one has none.
    """
    rows = pages.select(F.col(id_col).alias("id_"), F.col(link_col).cast("long").alias("enlace_"), F.col(text_col).alias("texto_"))
    kind = dict(rows.dtypes)["id_"]
    scores = map_rows(rows, _judge, f"id_ {kind}, enlace_ long, proporcion_spam double, redundante_ double, redundancia double")
    known = addresses.where(F.col(address_id).isNotNull()).select(F.col(address_id).cast("long").alias("enlace_"), F.col(address_col).alias("url_"))
    words = map_rows(known, _judge_urls, "enlace_ long, palabras_url int").groupBy("enlace_").agg(F.max("palabras_url").alias("palabras_url"))
    share, in_url = F.col("proporcion_spam"), F.coalesce("palabras_url", F.lit(0))
    return scores.join(words, "enlace_", "left").select(
        F.col("id_").alias(id_col), share, "redundancia", in_url.alias("palabras_url"), ((share >= L.MAJORITY) | (((share >= DOUBTFUL) | (F.col("redundante_") >= L.MAJORITY)) & (in_url >= URL_WORDS))).alias("es_spam")
    )


def p7_scores(coleccion: DataFrame, documentos: DataFrame) -> DataFrame:
    """Scores of all collection pages, judged by texto and the stored address."""
    return spam_scores(coleccion, documentos)


def p7_found(coleccion: DataFrame, documentos: DataFrame) -> DataFrame:
    """``doc_id`` of spam pages."""
    return p7_scores(coleccion, documentos).where("es_spam").select("doc_id")
