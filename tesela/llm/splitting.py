"""Splitting oversized texts by lexical cohesion.

Left and right of every sentence gap, blocks of sentences are compared by the
cosine of their words; a valley of this similarity marks a change of topic, and
its depth is how far it lies below the peaks on both sides. Within the window of
sizes a piece may end in, the cut goes to the deepest valley; a scene or
paragraph end counts as a little deeper than a sentence end of the same depth.
Windows without a gap are cut at words, else at signs, else anywhere. Every
piece but the first repeats the last tokens of the one before. Time grows in
proportion to the text.

Texts within the limit give no row, or one piece with ``keep_small`` (an empty
text an empty one, a null text never any). Repeated rows are split each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .tokens import VOCABULARY, encoding

LIMIT = 4096
OVERLAP = 128
#: Sentences of a block beside a gap.
BLOCK = 8
#: A piece is filled at least to this share before it may end.
LEAST_FILL = 0.5
#: What a scene, a paragraph and a sentence end add to the depth of their valley.
NATURAL = (0.2, 0.1, 0.0)

_SCENE = re.compile(r"\n(?=[ \t]*(?:INT|EXT|INT\./EXT|I/E)[./ ])")
_PARAGRAPH = re.compile(r"\n+")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+")
_WORD = re.compile(r"\s+")
_JOINT = re.compile(r"[^\w\s]+")
_TERM = re.compile(r"[^\W\d_]{4,}")
#: Words without white space between them end at their signs.
LEVELS = ("escena", "parrafo", "oracion", "palabra", "palabra", "caracter")


def boundaries(text: str) -> list[list[int]]:
    """Character positions after which a text may be cut, by level (scene, paragraph, sentence, word, sign)."""
    scenes = {m.end() for m in _SCENE.finditer(text)}
    paragraphs = {m.end() for m in _PARAGRAPH.finditer(text)}
    sentences = {m.end() for m in _SENTENCE.finditer(text)}
    words = {m.end() for m in _WORD.finditer(text)}
    joints = {m.end() for m in _JOINT.finditer(text)}
    return [sorted(scenes), sorted(paragraphs - scenes), sorted(sentences - paragraphs - scenes), sorted(words - sentences - paragraphs - scenes), sorted(joints)]


class _Encode:
    """Callable tokenizer that also knows the bytes and the characters begun by every token."""

    def __init__(self, vocabulary: str):
        e = encoding(vocabulary)
        self.encode = e.encode_ordinary
        raw = {t: b for b, t in e._mergeable_ranks.items()}
        self.n_bytes, self.n_chars = np.zeros(e.n_vocab, np.int64), np.zeros(e.n_vocab, np.int64)
        for t, b in raw.items():
            self.n_bytes[t], self.n_chars[t] = len(b), sum(1 for x in b if x & 0xC0 != 0x80)

    def __call__(self, text: str) -> list[int]:
        return self.encode(text)


def valley_depths(text: str, gaps: list[int]) -> np.ndarray:
    """Depth of the similarity valley at every gap (0 where there is none).

    Dot product and norms are running sums, changed only by the words of the sentence that
    moves from the right block to the left one and of those that enter and leave.
    """
    bounds = [0, *gaps, len(text)]
    bags = [Counter(_TERM.findall(text[a:b].lower())) for a, b in zip(bounds, bounds[1:])]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = squares_left = squares_right = 0

    def change(block: dict[str, int], other: dict[str, int], bag: Counter, sign: int) -> tuple[int, int]:
        """Add or take out a sentence: what that adds to the block's squares and to the dot product."""
        squares = product = 0
        for w, n in bag.items():
            n *= sign
            old = block.get(w, 0)
            squares += (2 * old + n) * n
            product += n * other.get(w, 0)
            if old + n:
                block[w] = old + n
            else:
                del block[w]
        return squares, product

    for bag in bags[1 : 1 + BLOCK]:
        squares_right += change(right, left, bag, 1)[0]
    sims = np.zeros(len(gaps))
    for i in range(len(gaps)):
        if i:
            s, p = change(right, left, bags[i], -1)
            squares_right, dot = squares_right + s, dot + p
            if i + BLOCK < len(bags):
                s, p = change(right, left, bags[i + BLOCK], 1)
                squares_right, dot = squares_right + s, dot + p
        s, p = change(left, right, bags[i], 1)
        squares_left, dot = squares_left + s, dot + p
        if i >= BLOCK:
            s, p = change(left, right, bags[i - BLOCK], -1)
            squares_left, dot = squares_left + s, dot + p
        if dot:
            sims[i] = dot / math.sqrt(squares_left * squares_right)
    before, after = sims.tolist(), sims.tolist()
    for i in range(1, len(before)):
        if sims[i] <= sims[i - 1]:
            before[i] = max(before[i], before[i - 1])
    for i in range(len(after) - 2, -1, -1):
        if sims[i] <= sims[i + 1]:
            after[i] = max(after[i], after[i + 1])
    return np.array(before) + np.array(after) - 2 * sims


class _Places:
    """Where a text may be cut: by token positions, with the worth of every place."""

    def __init__(self, text: str, encode: _Encode, tokens: np.ndarray):
        raw = np.frombuffer(text.encode("utf-8") + b" ", np.uint8)
        #: Characters before the end of every token; whether a token ends with a whole character.
        self.ends = np.cumsum(encode.n_chars[tokens])
        self.full = (raw[np.cumsum(encode.n_bytes[tokens])] & 0xC0) != 0x80
        levels = boundaries(text)
        level_of = {p: n for n, places in enumerate(levels[:3]) for p in places}
        gaps = sorted(level_of)
        grade = np.array([level_of[p] for p in gaps], np.int64)
        worth = valley_depths(text, gaps) + np.array(NATURAL)[grade] if gaps else np.zeros(0)
        self.rows = [self._at(gaps, worth, grade)]
        self.rows += [self._at(places, None, np.full(len(places), n)) for n, places in enumerate(levels[3:], 3)]

    def _at(self, places: list[int], worth: np.ndarray | None, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Tokens wholly before each place, where that is a cut between characters; worth and level."""
        at = np.searchsorted(self.ends, np.array(places, np.int64), side="right")
        fine = (at > 0) & self.full[np.maximum(at, 1) - 1]
        return at[fine], worth[fine] if worth is not None else None, grade[fine]

    def choose(self, cut: int, last: int) -> tuple[int, str]:
        """Token position and level of the cut in (cut, last]: the place of most worth (of equals the last)."""
        low = cut + max(1, int((last - cut) * LEAST_FILL))
        for at, worth, grade in self.rows:
            i, j = np.searchsorted(at, low, side="left"), np.searchsorted(at, last, side="right")
            if i < j:
                k = j - 1 if worth is None else j - 1 - int(np.argmax(worth[i:j][::-1]))
                return int(at[k]), LEVELS[int(grade[k])]
        t = last
        while t > cut + 1 and not self.full[t - 1]:
            t -= 1
        return t, LEVELS[5]


def split_text(text: str, encode: _Encode, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """Pieces ``inicio, corte, n_tokens, nivel``: characters inicio up to the end; the new part starts at ``corte``."""
    tokens = np.array(encode(text), np.int64)
    n = len(tokens)
    if n <= limit:
        return [{"inicio": 0, "corte": 0, "fin": len(text), "n_tokens": n, "nivel": "fin"}]
    places = _Places(text, encode, tokens)
    ends, full = places.ends, places.full
    out: list[dict] = []
    start = cut = 0  # token positions: of the piece, of its new part
    while True:
        room = limit
        while True:
            last = min(n, start + room)
            end, level = (last, "fin") if last == n else places.choose(cut, last)
            a, b = int(ends[start - 1]) if start else 0, int(ends[end - 1])
            size = len(encode(text[a:b]))
            if size <= limit or room <= overlap + 8:
                break
            room -= max(1, size - limit)
        out.append({"inicio": a, "corte": int(ends[cut - 1]) if cut else 0, "fin": b, "n_tokens": size, "nivel": level})
        if end == n:
            return out
        start = max(0, end - overlap)
        while start and not full[start - 1]:
            start -= 1
        cut = end


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, keep_small: bool = False) -> DataFrame:
    """``id_col, pieza, piezas, n_tokens, nivel, inicio, corte, fin, trozo`` of the texts over the limit.

    With ``keep_small`` the other texts are given too, as one piece each. Without it texts of up to
    ``limit`` bytes are not tokenised: a byte-level token holds at least one byte, so they cannot be over it.
    """
    big = df.where(F.col(text_col).isNotNull() if keep_small else F.octet_length(text_col) > limit).select(F.col(id_col).alias("id_"), F.col(text_col).alias("texto_"))
    kind = dict(df.dtypes)[id_col]

    def make():
        encode = _Encode(vocabulary)

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("id_", "pieza", "piezas", "n_tokens", "nivel", "inicio", "corte", "fin", "trozo")}
            for doc, text in zip(cols["id_"], cols["texto_"]):
                parts = split_text(text, encode, limit, overlap)
                if len(parts) < 2 and not keep_small:
                    continue
                for n, p in enumerate(parts, 1):
                    for k, v in (("id_", doc), ("pieza", n), ("piezas", len(parts)), ("trozo", text[p["inicio"] : p["fin"]]), *p.items()):
                        out[k].append(v)
            return out

        return run

    return map_rows(big, make, f"id_ {kind}, pieza int, piezas int, n_tokens int, nivel string, inicio int, corte int, fin int, trozo string").withColumnRenamed("id_", id_col)


def p10_found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that had to be split."""
    return pieces(documents).where(F.col("pieza") == 1).select("doc_id")


def p10_reunited(documents: DataFrame) -> DataFrame:
    """``doc_id, huella, en_limite, solapan`` of every text: digest of its pieces without overlap, and whether all keep the limit and join."""
    parts = pieces(documents, keep_small=True)
    new = F.substring("trozo", F.col("corte") - F.col("inicio") + 1, F.length("trozo"))
    whole = F.array_sort(F.collect_list(F.struct("pieza", "inicio", "corte", "fin", new.alias("nuevo"))))
    joins = F.forall(F.arrays_zip(F.slice("p", 2, F.size("p")).alias("b"), F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - 1)).alias("a")), lambda x: (x["b"]["corte"] == x["a"]["fin"]) & (x["b"]["inicio"] < x["a"]["fin"]) & (x["b"]["inicio"] > x["a"]["inicio"]))
    rows = parts.groupBy("doc_id").agg(whole.alias("p"), (F.max("n_tokens") <= LIMIT).alias("en_limite"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["nuevo"]), "")).alias("huella"), "en_limite", joins.alias("solapan"))
