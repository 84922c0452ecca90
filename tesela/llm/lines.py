"""Line analysis shared by the text operators (pure Python, runs inside Arrow UDFs).

A line is the piece between ``\\n``; every line gets one kind:

==========  =============================================================
``vacia``   only white space
``prosa``   ends like a sentence
``lista``   entry of a list (bullet, enumerator, ``title — year``, ``name: label``)
``tabla``   row of delimited cells
``basura``  damaged text, encoded data or code
``spam``    block of search phrases, offers, tags or links: extremely
            compressible given its language, with few sentence ends
``otra``    anything else (headings, notices, names)
==========  =============================================================
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

from .lexicon import FUNCTION_WORDS, LANGUAGES, SEARCH_WORDS, function_sets, search_sets

KINDS = ("vacia", "prosa", "lista", "tabla", "basura", "spam", "otra")
_FUNCTION = function_sets()
_SEARCH = search_sets()
_GRAMMAR = frozenset().union(*_FUNCTION.values())
_KNOWN = {w: tuple(k for k in LANGUAGES if w in _FUNCTION[k] or w in _SEARCH[k]) for w in _GRAMMAR.union(*_SEARCH.values())}
_SOUGHT = frozenset().union(*_SEARCH.values()) - _GRAMMAR

INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_PIECE = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])")
_END = re.compile(r"[.!?…。]['\"»”’)\]]*$")
_BULLET = re.compile(r"^(?:[•◦▪‣*\-–]\s+\S|(?:\d{1,4}|[a-zA-Z])[.)]\s+\S)")
_YEAR_TAIL = re.compile(r"\s[—–-]\s(?:1[89]|20)\d\d$")
_LABEL = re.compile(r"^[^\W\d_][\w'’-]*(?:\s[^\W\d_][\w'’-]*){0,4}:\s\S")
_CELLS = re.compile(r"\t| \| |;(?=\S)|\s{3,}")
_DATA_CELL = re.compile(r"^(?:[-–—]|[\d.,:/%€$ ]+)$")
_CODE = re.compile(r"[{}<>;=]|\(\)|\|\|")
_STATEMENT = re.compile(r"[{;]\S*[:=]\S*[;}]|<\w+ \w+=|\]\s*;$")
_VOWEL = re.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüãõåæœø]", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?…]+(?=['\"»”’)\]]*(?:\s|$))")
_BETWEEN = re.compile(r"(?<=[.!?…])\s+")

#: Blocks of at most this many characters are compressed on their own.
BLOCK_CHARS = 1024
#: A block is extremely redundant from this multiple of the ratio expected of prose.
REDUNDANCY = 1.2
#: Bytes of words below which a ratio says nothing.
LEAST_BYTES = 18
#: Sentence ends per word up to which redundancy counts as confirmed.
SENTENCE_DENSITY = 0.03
#: Multiples of the expected ratio that sentence ends do not excuse, and do not excuse under an address of search words.
EXTREME = 1.4
MODERATE = 1.3
#: Share of search words from which a sentence is a search phrase, and how often any other may be repeated as a refrain or a copy.
SEARCH_SHARE = 1 / 3
MOST_COPIES = 8
#: Share of grammatical words below which unpunctuated text is no running text.
LEAST_GRAMMAR = 0.15


def clean(text: str) -> str:
    """NFC, without invisible characters; line structure is kept."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = INVISIBLE.sub("", text).replace("\xa0", " ")
    return text


_ZDICT = {k: ((FUNCTION_WORDS[k] + " ") + (SEARCH_WORDS[k] + " ") * 2).encode() for k in LANGUAGES}
#: Expected ratio of prose as intercept + slope * ln(bytes), by language: least squares over blocks of
#: 60 to 1000 bytes of the prose pages, with the same compressor. Shorter blocks are held against EXPECTED_LEAST.
EXPECTED = {"es": (-0.35, 0.37), "en": (-0.39, 0.39), "pt": (-0.50, 0.41), "fr": (-0.62, 0.44), "it": (-0.60, 0.43), "de": (-0.54, 0.42)}
EXPECTED_LEAST = 1.25


def pieces(block: str) -> list[str]:
    """Lower-case words; CamelCase tags and URL slugs fall apart into their words."""
    found = _PIECE.findall(block)
    return " ".join(found).lower().split(" ") if found else found


def block_language(words: list[str]) -> str:
    """Language of most grammatical and search words (first of equals)."""
    votes = dict.fromkeys(LANGUAGES, 0)
    for langs, n in Counter(map(_KNOWN.get, words)).items():
        for lang in langs or ():
            votes[lang] += n
    return max(LANGUAGES, key=votes.__getitem__)


def redundancy(words: list[str]) -> float:
    """Compression ratio of a block's words (see ``pieces``) over the ratio expected of prose of their length and language."""
    raw = " ".join(words).encode()
    if len(raw) < LEAST_BYTES:
        return 0.0
    lang = block_language(words)
    c = zlib.compressobj(6, zlib.DEFLATED, -12, 3, zlib.Z_DEFAULT_STRATEGY, _ZDICT[lang])
    size = len(c.compress(raw)) + len(c.flush())
    a, b = EXPECTED[lang]
    return len(raw) / size / max(EXPECTED_LEAST, a + b * math.log(len(raw) + 1))


def is_plain(s: str) -> bool:
    """Several grammatical words and hardly a sign of a wrong encoding: certainly undamaged."""
    if len(_GRAMMAR.intersection(s.lower().split())) < 2:
        return False
    return s.isascii() or (s.count("\ufffd") + s.count("Ã") + s.count("Â")) * 25 <= len(s)


def is_damaged(s: str) -> bool:
    n = len(s)
    if n < 8:
        return False
    words = _WORD.findall(s)
    letters = sum(map(len, words))
    solid = n - s.count(" ")
    if letters < 0.45 * solid and not re.match(r"https?://", s):
        digits = sum(ch.isdigit() for ch in s)
        if solid - letters - digits > 0.3 * solid or letters < 0.2 * solid and solid >= 40:
            return True
    if s.count("�") + s.count("Ã") + s.count("Â") > 0.04 * n:
        return True
    longest = max(map(len, s.split()), default=0)
    if longest >= 36 and longest > 0.6 * n and "://" not in s and not s.startswith("#"):
        return True
    code = _CODE.findall(s)
    if code and (len(code) >= 4 and len(code) > 0.06 * n and any(x not in "|;" for x in code) or _STATEMENT.search(s)):
        return True
    long_words = [w for w in words if len(w) >= 3]
    if len(long_words) < 3:
        return False
    mute = [w for w in long_words if not _VOWEL.search(w)]
    return sum(1 for w in mute if not _VOWEL.search(unicodedata.normalize("NFD", w))) > 0.6 * len(long_words)


def is_row(s: str) -> bool:
    cells = [c.strip() for c in _CELLS.split(s)]
    return len(cells) >= 3 and sum(1 for c in cells if _DATA_CELL.match(c)) * 3 >= len(cells) and max(map(len, cells)) < 80


def is_spam(s: str) -> bool:
    """Redundant and unpunctuated in most of its blocks."""
    spam = total = 0
    for i in range(0, len(s), BLOCK_CHARS):
        block = s[i : i + BLOCK_CHARS]
        total += len(block)
        if len(_SENTENCE_END.findall(block)) <= SENTENCE_DENSITY * len(block.split()) and redundancy(pieces(block)) >= REDUNDANCY:
            spam += len(block)
    return 2 * spam > total


def line_redundancy(s: str) -> float:
    """Highest ratio of a line's blocks."""
    return max((redundancy(pieces(s[i : i + BLOCK_CHARS])) for i in range(0, len(s), BLOCK_CHARS)), default=0.0)


def is_search_phrase(s: str) -> bool:
    words = pieces(s)
    return sum(1 for w in words if w in _SOUGHT) >= SEARCH_SHARE * max(1, len(words))


def is_bare(s: str, words: list[str]) -> bool:
    """Hardly any sentence ends and grammatical words: names, tags or key words in a row."""
    return len(_SENTENCE_END.findall(s)) <= SENTENCE_DENSITY * len(words) and sum(1 for w in words if w in _GRAMMAR) < LEAST_GRAMMAR * len(words)


def _block_chars(units: list[str]) -> tuple[int, int, float]:
    """Characters of the units in spam blocks and in redundant blocks; the highest ratio of the spam blocks."""
    copies = Counter(units)
    once = {u: n for u, n in copies.items() if 1 < n <= MOST_COPIES and is_plain(u) and not is_search_phrase(u)}
    spam = redundant = size = counted = 0
    top = 0.0
    block: list[str] = []
    seen: set[str] = set()

    def close() -> None:
        nonlocal spam, redundant, top
        text = " ".join(block)
        words = pieces(text)
        ratio = redundancy(words)
        bare = ratio >= REDUNDANCY and is_bare(text, words)
        if ratio >= EXTREME or bare:
            spam, top = spam + counted, max(top, ratio)
        if ratio >= MODERATE or bare:
            redundant += counted

    for u in units:
        if u in seen:
            continue
        if u in once:
            seen.add(u)
        for i in range(0, len(u), BLOCK_CHARS):
            piece = u[i : i + BLOCK_CHARS]
            if block and size + len(piece) > BLOCK_CHARS:
                close()
                block, size, counted = [], 0, 0
            block.append(piece)
            size += len(piece) + 1
            counted += len(piece) * once.get(u, 1)
    if block:
        close()
    return spam, redundant, top


def spam_shares(lines: list[str], kinds: list[str]) -> tuple[float, float, float]:
    """Shares of a page's characters in spam, and in spam or moderately redundant text, and the highest ratio of the
    spam blocks over the lines, from its cleaned lines and their kinds.

    Besides the spam lines, sentences are joined to blocks over the lines, and so are the other lines
    (headings, names, tags; list entries only if they are search phrases or repeated like no list's).
    A block is spam from ``EXTREME`` on, however it is punctuated, and from ``REDUNDANCY`` on if it is bare.
    Copies of a sentence that is no search phrase are measured once, up to ``MOST_COPIES``, and share the
    verdict of the first. ``otra`` lines outside spam count only where they are most of the page.
    """
    chars: Counter[str] = Counter()
    sentences: list[str] = []
    others: list[str] = []
    entries: list[str] = []
    for x, kind in zip(lines, kinds):
        s = x.strip()
        chars[kind] += len(s)
        if kind == "prosa":
            sentences += _BETWEEN.split(s)
        elif kind == "otra":
            others.append(s)
        elif kind == "lista":
            entries.append(s)
    listed = Counter(entries)
    stuffed = [x for x in entries if listed[x] > MOST_COPIES or is_search_phrase(x)]
    found = [_block_chars(units) for units in (sentences, stuffed, others)]
    spam, redundant = (chars["spam"] + sum(f[i] for f in found) for i in (0, 1))
    top = max(f[2] for f in found)
    total = sum(chars.values())
    if not total:
        return 0.0, 0.0, 0.0
    if 2 * chars["otra"] > total:
        return spam / total, redundant / total, top
    rest = total - chars["otra"]
    return spam / max(1, rest + found[2][0]), redundant / max(1, rest + found[2][1]), top


def line_kind(line: str) -> str:
    """Kind of one line of cleaned text."""
    s = line.strip()
    if not s:
        return "vacia"
    ends = _END.search(s[-8:]) is not None
    if ends and len(s) > 24 and s.count(" ") >= 3 and (is_plain(s) or not is_damaged(s)):
        return "prosa"
    if len(s) >= 20 and is_spam(s):
        return "spam"
    if is_row(line.strip("\r\n ")):
        return "tabla"
    if is_damaged(s):
        return "basura"
    if len(s) <= 160 and not ends and (_BULLET.match(s) or _YEAR_TAIL.search(s) or _LABEL.match(s)):
        return "lista"
    return "otra"


#: A page is of a class when this share of its counted characters (spam), lines (others) or characters (tables and damaged text) is.
MAJORITY = 0.6
#: Fewest lines that make a list, a table or damaged text by their number.
LEAST_LINES = 5


def classify(lines: dict[str, int], chars: dict[str, int]) -> str | None:
    """``spam``, ``lista``, ``tabla``, ``basura``, ``prosa`` or None (no text) from the counts per kind.

    Headings and notices (``otra``) count for nobody, except that few long lines make a table or
    damaged text only if they are that share of all characters.
    """
    counted = [k for k in KINDS if k not in ("vacia", "otra")]
    total = sum(chars.get(k, 0) for k in counted)
    if not total:
        return "prosa" if lines.get("otra", 0) else None
    if chars.get("spam", 0) >= MAJORITY * total:
        return "spam"
    for k in ("basura", "tabla"):
        if chars.get(k, 0) >= MAJORITY * (total + chars.get("otra", 0)):
            return k
    total_lines = sum(lines.get(k, 0) for k in counted)
    best = max(("lista", "tabla", "basura"), key=lambda k: lines.get(k, 0))
    if lines.get(best, 0) >= max(LEAST_LINES, MAJORITY * total_lines):
        return best
    return "prosa"


def text_class(text: str) -> str | None:
    """Class of a whole text."""
    return lines_class(clean(text).split("\n"))


def is_sentence(s: str) -> bool:
    """Certainly a sentence (of a stripped line)."""
    return len(s) > 24 and _END.search(s[-8:]) is not None and s.count(" ") >= 3 and is_plain(s)


def lines_class(lines: list[str]) -> str | None:
    """Class of cleaned lines."""
    n: dict[str, int] = {}
    c: dict[str, int] = {}
    kinds = ["prosa" if is_sentence(x.strip()) else line_kind(x) for x in lines]
    for x, k in zip(lines, kinds):
        n[k] = n.get(k, 0) + 1
        c[k] = c.get(k, 0) + len(x.strip())
    if spam_shares(lines, kinds)[0] >= MAJORITY:
        return "spam"
    return classify(n, c)
