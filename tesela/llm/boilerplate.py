"""Main body of pages by removal of site templates.

The text of a page is taken as a tree: page, lines, and the segments of a line
(menu items, what stands before a colon or a dash). Every subtree is hashed,
with the site's own name and numbers masked, and once more with other proper
names masked. Spark counts on how many pages of its host each subtree recurs;
one that recurs on a large share of them is a template of the host and is
deleted. Hosts seen on few pages cannot show what recurs, so a subtree that is
the template of several hosts counts as one everywhere: sites of one make share
their templates, with their own names put in.

Shares decide, so results are alike at every size; a host's templates are
bounded by its subtrees per page over the share. Null and empty texts have no
lines; a null host is a host of its own; repeated rows count as pages.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import lines as L
from .arrow import flat, map_rows, nested
from ..operators.joins import bounded_join
from .repeated_lines import key64, source_name
from .spam import p7_found

#: Share of the pages of a host from which a subtree is its template; and fewest pages.
HOST_SHARE = 0.1
LEAST_HOST_PAGES = 3
#: Hosts whose template a subtree is before it counts as one at all hosts.
TRANSFER_HOSTS = 3

_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_SEPARATOR = re.compile(r"\s+[|·>»/→]\s+|\s{2,}|\t")
_TAG = re.compile(r"#\w[\w'’\-]*(?:\s+#\w[\w'’\-]*)*")
_RUN = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][\w'’\-]*(?: [A-ZÀ-ÖØ-Þ][\w'’\-]*)*")
_NAMES = re.compile("\x02(?: \x02)+")
#: Masks of the site's name, of proper names and of tags.
SITE, NAME, TAG = "\x01", "\x02", "\x03"


@lru_cache(maxsize=4096)
def _site_pattern(label: str) -> re.Pattern | None:
    """The site's name as a word: the host's first label, or what is left of it without an ending (up to half)."""
    names = [label[:n] for n in range(len(label), max(3, len(label) // 2), -1)]
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, names))})(?![-'’]?[^\W_])", re.I) if names else None


def _mask_site(line: str, label: str) -> str:
    if label[:4] not in line.lower():
        return line
    pattern = _site_pattern(label)
    return pattern.sub(SITE, line) if pattern else line


def site_mask(line: str, label: str) -> str:
    """The line with numbers and the site's name masked."""
    return _mask_site(_NUMBER.sub("0", line), label)


def plain(masked: str) -> str:
    """A masked line in lower case with single blanks."""
    return " ".join(masked.lower().split())


def _mask_run(m: re.Match) -> str:
    words = m.group().split(" ")
    if m.start() == 0 and len(words) != 2:  # a line's first word has a capital anyway
        return words[0] if len(words) == 1 else words[0] + " " + NAME
    return NAME


def named(masked: str) -> str:
    """A masked line with runs of capitalised words, the site's name among them, masked too."""
    s = (masked if masked.isupper() else _RUN.sub(_mask_run, masked)).lower().replace(SITE, NAME)
    return _NAMES.sub(NAME, " ".join(s.split()))


def real_words(masked: str) -> int:
    return len(_TOKEN.findall(masked))


def line_nodes(line: str, label: str, alien: bool = False) -> tuple[str, list[str], list[str]]:
    """Masked line, further subtrees that stand for the line, and its menu items.

    Names are masked and items split in lines that are no sentences, and in lines that
    join a headline and a sentence by a dash. Sentences stand for themselves, unless
    they hold the site's name. ``alien``: the page never names its site, as one stored
    under another address; then any name may be a site's.
    """
    s = line.strip()
    masked = site_mask(s, label)
    full = plain(masked)
    own = SITE in masked or alien
    if len(s) > 24 and L._END.search(s[-6:]) and " — " not in s:
        return full, ["n:" + _named(s, masked, label)] if own else [], []
    name = _named(s, masked, label)
    whole: list[str] = []
    if name == TAG or name != full and real_words(name) and real_words(name) + own >= 2:
        whole.append("n:" + name)
    head, dash, _ = name.partition(" — ")
    if dash and real_words(head) >= 2:
        whole.append("n:" + head)
    head, colon, rest = (head if dash else name).partition(":")
    if colon and rest.startswith(" ") and real_words(head):
        whole.append("p:" + head)
    items = [x for x in _SEPARATOR.split(s) if x]
    if len(items) < 2 or not all(_TOKEN.search(x) for x in items):
        return full, whole, []
    return full, whole, [plain(site_mask(x, label)) for x in items]


def _named(s: str, masked: str, label: str) -> str:
    return named(site_mask(_TAG.sub(TAG, s), label) if "#" in s else masked)


def _pages():
    def run(cols: dict[str, list]) -> dict[str, list]:
        nodes_n: list[int] = []
        node_h: list[int] = []
        lines_n: list[int] = []
        line: list[int] = []
        line_h: list[int] = []
        line_part: list[bool] = []
        line_parts: list[int] = []
        for text, site in zip(cols["texto_"], cols["sitio"]):
            label = site.partition(".")[0]
            cleaned = L.clean(text or "")
            alien = label[:4] not in cleaned.lower()
            before = len(line)
            for n, raw in enumerate(cleaned.split("\n"), 1):
                if not raw or raw.isspace():
                    continue
                full, whole, items = line_nodes(raw, label, alien)
                line_h += map(key64, (full, *whole, *items))
                k = 1 + len(whole) + len(items)
                line += [n] * k
                line_part += [False] * (k - len(items)) + [True] * len(items)
                line_parts += [len(items)] * k
            lines_n.append(len(line) - before)
            distinct = set(line_h[before:])
            nodes_n.append(len(distinct))
            node_h += distinct
        return {
            "tabla": cols["tabla"], "id": cols["id"], "sitio": cols["sitio"], "nodos": flat(nodes_n, node_h, pa.int64()),
            "lineas": nested(lines_n, linea=(line, pa.int32()), h=(line_h, pa.int64()), parte=(line_part, pa.bool_()), partes=(line_parts, pa.int32())),
        }

    return run


def host_of(url: Column) -> Column:
    """Host of an address, without case, port and leading ``www.``; null becomes ``""``."""
    return source_name(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def page_trees(pages: DataFrame) -> DataFrame:
    """Hashed subtrees of ``tabla, id, sitio, texto_`` rows."""
    kind = dict(pages.dtypes)["id"]
    return map_rows(pages, _pages, f"tabla string, id {kind}, sitio string, nodos array<long>, lineas array<struct<linea:int,h:long,parte:boolean,partes:int>>")


def host_templates(trees: DataFrame) -> DataFrame:
    """``sitio, h`` of the subtrees that recur on a host. Counts are combined before they are moved, so hot subtrees cost no more."""
    counts = trees.select("sitio", F.explode("nodos").alias("h")).groupBy("sitio", "h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_HOST_PAGES)
    totals = materialize(trees.groupBy("sitio").agg(F.count("*").alias("paginas")).where(F.col("paginas") >= LEAST_HOST_PAGES), "page-totals")
    return bounded_join(counts, totals, ["sitio"], "h").where(F.col("n") >= F.col("paginas") * HOST_SHARE).select("sitio", "h")


def template_lines(trees: DataFrame) -> DataFrame:
    """``tabla, id, linea, propia`` of the lines that are templates: whole, or in all but one of their items.

    ``propia``: by the templates of its own host, else by those that several hosts share.
    """
    own = materialize(host_templates(trees), "host-templates")
    shared = materialize(own.groupBy("h").agg(F.count("*").alias("sitios")).where(F.col("sitios") >= TRANSFER_HOSTS).select("h", F.lit(True).alias("comun")), "shared-templates")
    nodes = bounded_join(trees.select("tabla", "id", "sitio", F.inline("lineas")), own.withColumn("propio", F.lit(True)), ["sitio", "h"], "id", "left")
    hits = bounded_join(nodes, shared, ["h"], "id", "left").where(F.col("propio") | F.col("comun"))
    counted = lambda c: F.coalesce(F.sum((c & F.col("parte")).cast("int")), F.lit(0))
    own_hit = F.coalesce("propio", F.lit(False))
    per_line = hits.groupBy("tabla", "id", "linea").agg(F.max(~F.col("parte")).alias("entera"), counted(F.lit(True)).alias("k"), F.max(own_hit & ~F.col("parte")).alias("entera_propia"), counted(own_hit).alias("k_propias"), F.max("partes").alias("n"))
    is_template = lambda whole, k: F.col(whole) | ((F.col("n") >= 2) & (F.col(k) >= F.col("n") - 1))
    return per_line.where(is_template("entera", "k")).select("tabla", "id", "linea", is_template("entera_propia", "k_propias").alias("propia"))


def pages_of(coleccion: DataFrame, resultado: DataFrame) -> DataFrame:
    a = coleccion.select(F.lit("coleccion").alias("tabla"), F.col("doc_id").alias("id"), source_name(F.col("dominio")).alias("sitio"), F.col("texto").alias("texto_"))
    b = resultado.select(F.lit("resultado_html").alias("tabla"), F.col("pagina_id").alias("id"), host_of(F.col("url")).alias("sitio"), F.col("texto").alias("texto_"))
    return a.unionByName(b)


def page_lines(coleccion: DataFrame, resultado: DataFrame) -> DataFrame:
    """``tabla, id, linea, propia`` of every line outside the body, of all pages."""
    return template_lines(materialize(page_trees(pages_of(coleccion, resultado)), "page-trees"))


def p6_found(coleccion: DataFrame, resultado: DataFrame, documentos: DataFrame | None = None) -> DataFrame:
    """``tabla, id, linea`` of every line outside the body; collection pages that are spam are left out.

    Without ``documentos`` spam is judged by the texts alone.
    """
    if documentos is None:
        coleccion = coleccion.withColumn("db_id", F.lit(None).cast("long"))
        documentos = coleccion.select(F.col("db_id").alias("id"), F.lit(None).cast("string").alias("url")).limit(0)
    found = p7_found(coleccion, documentos).select(F.lit("coleccion").alias("tabla"), F.col("doc_id").alias("id")).distinct()
    spam = materialize(found, "spam-pages")
    return page_lines(coleccion, resultado).drop("propia").join(spam, ["tabla", "id"], "left_anti")


def p6_bodies(coleccion: DataFrame, resultado: DataFrame) -> DataFrame:
    """``tabla, id, cuerpo``: the texts of all pages without their template lines."""
    pages = pages_of(coleccion, resultado)
    drop = page_lines(coleccion, resultado).groupBy("tabla", "id").agg(F.collect_set("linea").alias("quitar"))
    kept = F.filter(F.split("texto_", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("quitar", (i + 1).cast("int")), F.lit(False)))
    return pages.join(drop, ["tabla", "id"], "left").select("tabla", "id", F.array_join(kept, "\n").alias("cuerpo"))
