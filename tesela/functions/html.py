"""HTML to text, title, links and robots directives; text quality as native columns."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

# FIXED VALUES: elements dropped with their content, and elements that break lines.
DROPPED = frozenset("script style noscript template svg canvas iframe nav header footer aside form button select textarea head".split())
BLOCKS = frozenset("p div br li ul ol dl dt dd tr table section article main blockquote pre hr h1 h2 h3 h4 h5 h6".split())
SKIPPED_LINKS = ("javascript:", "mailto:", "tel:", "data:", "#")

# FIXED VALUES: quality thresholds for texts and for lists (characters, words, alphanumeric density).
LIMITS = {False: (500, 100, 0.35), True: (300, 50, 0.15)}
_DISAMBIGUATION_NAMES = ("(desambiguación)", "(desambiguacion)", "(disambiguation)", "_desambiguación", "_desambiguacion", "_disambiguation")
_DISAMBIGUATION_PHRASES = (
    "puede referirse a:", "pueden referirse a:", "puede hacer referencia a:", "pueden hacer referencia a:", "may refer to:",
    "página de desambiguación", "pagina de desambiguacion", "disambiguation page",
)
_LIST_HINTS = "anime archive archives catalog category categories coleccion directorio episodes films index lista list lists main movies plots portal series shows"
_LIST_ENTRY = r"(?i)^(?:(?:\p{Nd}+|[a-zivx]+)[.)]|[•▪◦*\-])\s+|^.{2,160}?\s+[—–|]\s+.{2,}$"

#: Agent that robots files are read for.
AGENT = "TeselaBot"


class _Reader(HTMLParser):
    """Collects what a page holds; each start tag is handled once, closed or not."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.text: list[str] = []
        self.title: list[str] = []
        self.links: dict[str, None] = {}
        self.robots: dict[str, None] = {}
        self.depth = self.raw = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        values = {k.lower(): v or "" for k, v in attrs}
        reader = getattr(self, f"_see_{tag}", None)
        if reader:
            reader(values)
        self.depth += tag in DROPPED
        if tag in BLOCKS:
            self.text.append("\n")
        self.raw += tag == "pre"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self._leave(tag)

    def handle_endtag(self, tag):
        self._leave(tag)
        if tag == "title":
            self.in_title = False
        elif tag in BLOCKS:
            self.text.append("\n")
        elif tag in ("td", "th"):
            self.text.append(" ")
        if tag == "pre":
            self.raw = max(0, self.raw - 1)

    def _leave(self, tag):
        if tag in DROPPED:
            self.depth = max(0, self.depth - 1)

    def _see_base(self, a):
        self.base = urljoin(self.base, a.get("href", ""))

    def _see_title(self, a):
        self.in_title = True

    def _see_meta(self, a):
        if a.get("name", "").lower() == "robots":
            self.robots.update(dict.fromkeys(header_directives(a.get("content", ""))))

    def _see_a(self, a):
        target = a.get("href", "").strip()
        if target and not target.lower().startswith(SKIPPED_LINKS):
            full = urldefrag(urljoin(self.base, target))[0]
            if full.startswith(("http://", "https://")):
                self.links[full] = None

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.depth:
            self.text.append(data if self.raw else data.replace("\n", " "))


def header_directives(value: str) -> list[str]:
    return [x.strip().lower() for x in re.split("[,;]", value) if x.strip()]


def tidy(text: str) -> str:
    """Single blanks, trimmed lines, at most one empty line in a row, no leading ``Apariencia``."""
    lines = (re.sub(r"[ \t\f\v\r\xa0]+", " ", x).strip() for x in text.split("\n"))
    joined = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return re.sub(r"(?i)^(?:apariencia\s*\n+)+", "", joined).strip()


def read_html(html: str | None, url: str | None) -> dict:
    """``texto, titulo, enlaces, directivas_robots``; of broken HTML what was read until it broke."""
    reader = _Reader(url or "")
    try:
        reader.feed(html or "")
        reader.close()
    except Exception:  # noqa: BLE001 - the part read so far is the result
        pass
    return {"texto": tidy("".join(reader.text)), "titulo": " ".join("".join(reader.title).split()), "enlaces": list(reader.links), "directivas_robots": sorted(reader.robots)}


PAGE = StructType([StructField("texto", StringType()), StructField("titulo", StringType()), StructField("enlaces", ArrayType(StringType())), StructField("directivas_robots", ArrayType(StringType()))])


@F.pandas_udf(PAGE)
def parse_html(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_html(h, u) for h, u in zip(html, url)], columns=PAGE.names)


@F.pandas_udf(StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of a response by the charset of its header, else of its first 4 KiB, else UTF-8."""

    def one(raw: bytes | None, header: str | None) -> str | None:
        if raw is None:
            return None
        m = re.search(r"charset=([\w-]+)", header or "", re.I)
        n = None if m else re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", raw[:4096], re.I)
        name = m[1] if m else n[1].decode("ascii", "ignore") if n else "utf-8"
        try:
            return raw.decode(name, errors="replace")
        except LookupError:
            return raw.decode("utf-8", errors="replace")

    return pd.Series([one(b, c) for b, c in zip(body, content_type)])


@F.pandas_udf(BooleanType())
def robots_allow(robots: pd.Series, code: pd.Series, url: pd.Series) -> pd.Series:
    """Whether a robots file lets an address be read: 401 and 403 forbid all, other errors and no file allow all."""
    known: dict[str, RobotFileParser] = {}

    def one(text: str | None, status: float | None, target: str | None) -> bool:
        if status in (401, 403):
            return False
        if text is None or status is None or status >= 400:
            return True
        parser = known.get(text)
        if parser is None:
            parser = known[text] = RobotFileParser()
            parser.parse(text.splitlines())
        return parser.can_fetch(AGENT, target or "")

    return pd.Series([one(t, None if c is None or c != c else c, u) for t, c, u in zip(robots, code, url)])


#: Longest delay a robots file may ask for, in seconds, and the one without any. FIXED VALUES.
MAX_CRAWL_DELAY, CRAWL_DELAY = 10.0, 0.75


@F.pandas_udf(DoubleType())
def robots_delay(robots: pd.Series, code: pd.Series) -> pd.Series:
    """Seconds between two fetches of a host by its robots file, within CRAWL_DELAY and MAX_CRAWL_DELAY."""

    def one(text: str | None, status: float | None) -> float:
        if text is None or status is None or status != status or status >= 400:
            return CRAWL_DELAY
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        return min(MAX_CRAWL_DELAY, max(CRAWL_DELAY, float(parser.crawl_delay(AGENT) or 0)))

    return pd.Series([one(t, c) for t, c in zip(robots, code)])


def content_kind(header: Column) -> Column:
    return F.lower(F.trim(F.split(F.coalesce(header, F.lit("")), ";")[0]))


def is_html(header: Column) -> Column:
    """No content type counts as HTML."""
    return content_kind(header).isin("text/html", "application/xhtml+xml", "")


def native_tidy(text: Column) -> Column:
    """``tidy`` as a native column. Blank sets as the text cleaning of pages uses them."""
    one = F.regexp_replace(text, "[ \\t\\f\\x0B\\r\\u00a0]+", " ")
    lines = F.regexp_replace(one, " *\\n *", "\n")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(lines, "\\n{3,}", "\n\n"), F.lit(" \n")), "(?i)^(?:apariencia\\s*\\n+)+", ""), F.lit(" \n"))


def native_directives(header: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), "[,;]"), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def is_disambiguation(text: Column, title: Column, url: Column) -> Column:
    """By address, title or a phrase among the first ten lines. ``url`` is taken as already decoded."""
    named = F.lit(False)
    for c in (url, title):
        for word in _DISAMBIGUATION_NAMES:
            named |= F.lower(F.coalesce(c, F.lit(""))).contains(word)
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\n|\\r"), 1, 10), lambda x: F.lower(F.trim(x)))
    start = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    for phrase in _DISAMBIGUATION_PHRASES:
        named |= start.contains(phrase)
    return named


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñ]+"), F.lit(0))


def is_list(text: Column, title: Column, url: Column) -> Column:
    """Whether a page is mostly a list: by hints in address or title, and the shape of its lines."""
    name = F.translate(F.element_at(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*?://[^/?#]*([^?#]*)", 1), "/"), -1), "_", " ")
    hints = F.array(*[F.lit(x) for x in _LIST_HINTS.split()])
    hinted = F.arrays_overlap(_words(name), hints) | F.arrays_overlap(_words(F.coalesce(title, F.lit(""))), hints)
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\n|\\r"), lambda x: F.trim(x)), lambda x: x != "")
    content = F.filter(lines, lambda x: (F.char_length(x) <= 300) & (F.char_length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 3))
    n, k, e = F.size(lines), F.size(content), F.size(F.filter(content, lambda x: x.rlike(_LIST_ENTRY)))
    return (n >= 3) & ((hinted & (e >= 2)) | (hinted & (k >= 0.60 * n)) | ((e >= 3) & (e >= 0.45 * n)))


def rejection(text: Column, listed: Column, title: Column, url: Column) -> Column:
    """Why a text is not kept (null: it is kept); the first reason counts."""
    t = F.coalesce(text, F.lit(""))
    limit = lambda i: F.when(listed, LIMITS[True][i]).otherwise(LIMITS[False][i])
    words = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]{2,}"))
    solid = F.regexp_replace(t, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]", "")
    density = F.when(F.char_length(solid) > 0, F.char_length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")) / F.char_length(solid)).otherwise(0.0)
    return (
        F.when(is_disambiguation(text, title, url), "desambiguacion")
        .when(F.char_length(t) < limit(0), F.concat(F.lit("longitud "), F.char_length(t).cast("string"), F.lit(" < "), limit(0).cast("string")))
        .when(words < limit(1), F.concat(F.lit("palabras "), words.cast("string"), F.lit(" < "), limit(1).cast("string")))
        .when(density < limit(2), F.lit("densidad"))
    )
