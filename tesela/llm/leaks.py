"""Held-out evaluation items inside training texts, found by pigeonhole edit matching.

A window of WINDOW words of an item may differ from the text by up to ERRORS word
edits. Cut into ERRORS + 1 pieces, at least one piece must then stand in the text
unchanged. All pieces of all windows are searched at once (Aho-Corasick over
normalised words); around every hit Myers' bit-parallel algorithm measures the
edit distance of the windows that contain the piece. An item shorter than a window
is one window of its own length, with its share of the edits (none below six words).

Up to AUTOMATON_ITEMS items are searched by one automaton; of larger sets the pieces
are joined to the texts' word runs, and an automaton is built for the items that have
a piece in a text. The rows are the same.

Words are the longest runs of letters and digits without case and diacritics.
Null and empty texts and items, and items without words, match nothing; repeated
rows of items count once, those of documents give repeated pairs.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_join
from ..session import materialize
from .arrow import flat, map_rows
from .repeated_lines import key64

WINDOW = 12
ERRORS = 2
#: Items up to which one automaton is built of all.
AUTOMATON_ITEMS = 20_000
#: Groups that the candidate items of one document are dealt to.
DEALT = 64

_MARKS = re.compile(r"[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str | None) -> list[str]:
    """Words of a text, without case and diacritics."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text.casefold())


def myers(pattern: Sequence, text: Sequence, limit: int) -> int:
    """Least edit distance between the pattern and any part of the text, or ``limit`` + 1 if above the limit."""
    m = len(pattern)
    peq: dict = {}
    for i, x in enumerate(pattern):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for y in text:
        eq = peq.get(y, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                return 0
    return best if best <= limit else limit + 1


def shape(words: int) -> tuple[int, int, int]:
    """Words of a window, its edits and the words of a piece, of an item of so many words."""
    window = min(WINDOW, words)
    errors = window * ERRORS // WINDOW
    return window, errors, window // (errors + 1)


def piece_starts(words: int) -> range:
    """Where the pieces of an item may begin."""
    return range(words - shape(words)[2] + 1)


class Matcher:
    """Automaton over the pieces of a set of items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        places: dict[str, list[tuple[int, int]]] = {}
        ids: dict[tuple[str, ...], int] = {}
        #: Window, edits and piece of every item; number of its windows (equal windows share one), the windows and their distinct words.
        self.shapes = [shape(len(w)) for _, w in self.items]
        self.numbers: list[list[int]] = []
        for n, (_, words) in enumerate(self.items):
            window, _, piece = self.shapes[n]
            self.numbers.append([ids.setdefault(tuple(words[o : o + window]), len(ids)) for o in range(len(words) - window + 1)])
            for q in piece_starts(len(words)):
                places.setdefault(" " + " ".join(words[q : q + piece]) + " ", []).append((n, q))
        self.windows = list(ids)
        self.distinct = [frozenset(w) for w in ids]
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (piece, where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def match(self, text: str | None) -> list[dict]:
        """One entry per item with a window within ERRORS edits of the text."""
        words = normal_words(text)
        if self.empty or not words:
            return []
        joined = " " + " ".join(words) + " "
        hits = list(self.automaton.iter(joined))
        if not hits:
            return []
        starts: dict[int, int] = {}
        at = 0
        for d, w in enumerate(words):
            starts[at] = d
            at += len(w) + 1
        found: dict[int, dict] = {}
        runs: dict[tuple[int, int], tuple[int, int]] = {}
        longest: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()
        known: dict[tuple[int, int], int] = {}
        for end, (piece, where) in hits:
            d = starts[end - len(piece) + 1]
            for n, q in where:
                numbers = self.numbers[n]
                window, errors, size = self.shapes[n]
                last, length = runs.get((n, d - q), (-2, 0))
                length = length + 1 if last == d - 1 else size
                runs[n, d - q] = (d, length)
                for o in range(q, max(-1, q - size * (errors + 1) + size - 1), -size):
                    if o >= len(numbers) or (n, o, d - q) in tried:
                        continue
                    tried.add((n, o, d - q))
                    a = d - q + o
                    w = numbers[o]
                    dist = known.get((w, a))
                    if dist is None:
                        region = words[max(0, a - errors) : max(0, a + window + errors)]
                        # more missing words than errors: certainly above the budget
                        hopeless = len(self.distinct[w].difference(region)) > errors
                        dist = known[w, a] = errors + 1 if hopeless else myers(self.windows[w], region, errors)
                    if dist <= errors:
                        f = found.setdefault(n, {"distancia": dist, "ventanas": set(), "posicion": max(0, a)})
                        f["distancia"] = min(f["distancia"], dist)
                        f["ventanas"].add(o)
                        f["posicion"] = min(f["posicion"], max(0, a))
                longest[n] = max(longest.get(n, 0), length)
        out = []
        for n, f in found.items():
            key = self.items[n][0]
            out.append({"item_id": key, "distancia": f["distancia"], "proporcion": len(f["ventanas"]) / len(self.numbers[n]), "corrida": longest[n], "posicion": f["posicion"]})
        return out


_BUILT: dict[str, Matcher] = {}


def _matcher(name: str, rows: list) -> Matcher:
    """The automaton of a set of items, kept by a worker for its further tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher([(i, normal_words(t)) for i, t in rows])
    return _BUILT[name]


_RESULT = ("item_id", "distancia", "proporcion", "corrida", "posicion")


def _rows(found: Iterable[tuple[object, list[dict]]]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", *_RESULT)}
    for doc, matches in found:
        for m in matches:
            out["doc_id"].append(doc)
            for k in _RESULT:
                out[k].append(m[k])
    return out


def _by_automaton(docs: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sorted(map(tuple, items.collect()), key=repr))
    name = uuid.uuid4().hex

    def make():
        matcher = _matcher(name, shared.value)
        return lambda cols: _rows((doc, matcher.match(text)) for doc, text in zip(cols["doc_id"], cols["texto_"]))

    return map_rows(docs, make, schema)


def _word_runs(sizes: list[int]):
    """Hashes of a document's distinct runs of so many words."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        count: list[int] = []
        keys: list[int] = []
        for text in cols["texto_"]:
            w = normal_words(text)
            own = {key64(" ".join(w[i : i + n])) for n in sizes for i in range(len(w) - n + 1)}
            keys += own
            count.append(len(own))
        return {"fila": cols["fila"], "h": flat(count, keys, pa.int64())}

    return run


def _item_pieces():
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "n": [], "h": []}
        for item, text in zip(cols["item_id"], cols["texto_"]):
            w = normal_words(text)
            n = shape(len(w))[2] if w else 0
            own = {key64(" ".join(w[q : q + n])) for q in piece_starts(len(w))} if w else ()
            for h in own:
                for k, v in zip(out, (item, n, h)):
                    out[k].append(v)
        return out

    return run


def _by_join(docs: DataFrame, items: DataFrame, schema: str, kind: str) -> DataFrame:
    """Items of any number: pieces joined to word runs, then an automaton for the items met by a document."""
    items = materialize(items, "items")
    pieces = materialize(map_rows(items, _item_pieces, f"item_id {kind}, n int, h long"), "pieces")
    sizes = [r.n for r in pieces.select("n").distinct().collect()]  # at most WINDOW of them
    numbered = materialize(docs.withColumn("fila", F.monotonically_increasing_id()), "numbered")
    runs = map_rows(numbered.select("fila", "texto_"), lambda: _word_runs(sizes), "fila long, h array<long>").select("fila", F.explode("h").alias("h"))
    known = materialize(pieces.select("h").distinct(), "piece-keys")
    met = materialize(bounded_join(runs, known, ["h"], "fila", "left_semi"), "met")
    pairs = bounded_join(met, pieces.select("h", "item_id"), ["h"], "fila").select("fila", "item_id").distinct()
    dealt = bounded_join(pairs, items, ["item_id"], "fila").groupBy("fila", F.pmod(F.xxhash64("item_id"), F.lit(DEALT)).alias("mano")).agg(F.collect_list(F.struct("item_id", "texto_")).alias("candidatos"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        return _rows((doc, Matcher([(c["item_id"], normal_words(c["texto_"])) for c in held]).match(text)) for doc, text, held in zip(cols["doc_id"], cols["texto_"], cols["candidatos"]))

    return map_rows(dealt.join(numbered, "fila").select("doc_id", "texto_", "candidatos"), lambda: run, schema)


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "texto", limit: int = AUTOMATON_ITEMS) -> DataFrame:
    """``item_id, doc_id, distancia, proporcion, corrida, posicion`` of every leaked item and document.

    ``proporcion`` is the share of the item's windows found within the error budget,
    ``corrida`` the longest run of unchanged words, ``posicion`` the first word in the text.
    Up to ``limit`` items are sent to all workers; more are joined.
    """
    held = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("texto_")).where(F.col("item_id").isNotNull() & F.col("texto_").isNotNull()).distinct()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("texto_"))
    kind = dict(held.dtypes)["item_id"]
    schema = f"item_id {kind}, doc_id {dict(docs.dtypes)['doc_id']}, distancia int, proporcion double, corrida int, posicion int"
    if held.limit(limit + 1).count() <= limit:
        return _by_automaton(docs, held, schema)
    return _by_join(docs, held, schema, kind)


def p8_found(documents: DataFrame, evaluacion: DataFrame) -> DataFrame:
    """``item_id, doc_id``: leaks whose unchanged run has at least WINDOW words."""
    return leaks(documents, evaluacion).where(F.col("corrida") >= WINDOW).select("item_id", "doc_id").distinct()


def p8_edited(documents: DataFrame, evaluacion: DataFrame) -> DataFrame:
    """``item_id, doc_id, distancia``: leaks that only the edit distance finds, as no whole window stands in the text unchanged."""
    return leaks(documents, evaluacion).where(F.col("distancia") > 0).select("item_id", "doc_id", "distancia")
