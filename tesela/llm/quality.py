"""Per-document text statistics and class, and the check of stored sizes.

Huge texts are cut into chunks; every chunk gives counts of its complete lines
plus its two open line ends (the boundary state). Chunks merge associatively:
counts add up, the open end of one chunk and the head of the next make a line
that is counted then. Merging goes through a tree of two levels, and the ratios
and rules are derived from the merged counts.

Characters are counted without line ends. Results for odd input: a null text gives null statistics and a null class; an
empty text zero counts and null ratios; repeated rows give repeated results; a
null id is carried through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines as L
from .arrow import map_rows
from .lexicon import function_sets

#: Characters of a chunk.
CHUNK_CHARS = 65536
#: Chunks merged by one task of the first level.
FAN_IN = 64

_BASE = ("n_chars", "n_words", "word_chars", "n_symbols", "n_solid", "n_lines", "n_punct_lines", "n_common")
COUNTS = _BASE + tuple(f"{w}_{k}" for k in L.KINDS if k != "vacia" for w in ("l", "c"))
_INDEX = {name: i for i, name in enumerate(COUNTS)}
_COMMON = frozenset().union(*function_sets().values())
_WORD = re.compile(r"\w+(?:['’\-]\w+)*")
_SPACE_OR_WORD = re.compile(r"[\w\s.,;:!?¡¿'\"()«»“”‘’…\-]+")


def add_line(counts: list[int], raw: str) -> None:
    """Add one complete line to the counts."""
    line = L.clean(raw)
    counts[0] += len(raw)
    kind = L.line_kind(line)
    if kind == "vacia":
        return
    words = _WORD.findall(line)
    counts[1] += len(words)
    counts[2] += sum(map(len, words))
    solid = "".join(line.split())
    counts[3] += len(_SPACE_OR_WORD.sub("", solid))
    counts[4] += len(solid)
    counts[5] += 1
    counts[6] += L._END.search(line.strip()) is not None
    counts[7] += sum(1 for w in words if w.lower() in _COMMON)
    at = _INDEX[f"l_{kind}"]
    counts[at] += 1
    counts[at + 1] += len(line.strip())


def chunk_state(text: str, whole: bool) -> tuple[list[int], bool, str | None, str | None]:
    """Counts of the complete lines, whether there is a line end, and the open head and tail."""
    counts = [0] * len(COUNTS)
    parts = text.split("\n")
    if whole:
        for p in parts:
            add_line(counts, p)
        return counts, True, None, None
    if len(parts) == 1:
        return counts, False, text, None
    for p in parts[1:-1]:
        add_line(counts, p)
    return counts, True, parts[0], parts[-1]


def fold_ends(ends: list[dict]) -> tuple[list[int], bool, str, str | None]:
    """Merge neighbouring boundary states (already in order) into one."""
    counts = [0] * len(COUNTS)
    head: list[str] = []
    tail: list[str] = []
    seen = False
    for e in ends:
        (tail if seen else head).append(e["head"] or "")
        if e["has_nl"]:
            if seen:
                add_line(counts, "".join(tail))
            seen, tail = True, [e["tail"] or ""]
    return counts, seen, "".join(head), "".join(tail) if seen else None


def _zero(counts: list | None) -> bool:
    return counts is None or counts[0] is None


def _partials(carried: list[str]):
    def make():
        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: cols[c] for c in ("row", "chunk", *carried)} | {"many": [n > 1 for n in cols["n_chunks"]], "has_nl": [], "head": [], "tail": [], "counts": []}
            for text, n in zip(cols["piece"], cols["n_chunks"]):
                state = ([None] * len(COUNTS), True, None, None) if text is None else chunk_state(text, n == 1)
                for name, v in zip(("counts", "has_nl", "head", "tail"), state):
                    out[name].append(v)
            return out

        return run

    return make


def _folds(carried: list[str]):
    def make():
        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: cols[c] for c in ("row", "chunk", "many", *carried)} | {"has_nl": [], "head": [], "tail": [], "counts": []}
            for ends, counts in zip(cols["ends"], cols["counts"]):
                nl, head, tail = True, None, None
                if ends:
                    extra, nl, head, tail = fold_ends(sorted(ends, key=lambda e: e["chunk"]))
                    counts = [a + b for a, b in zip(counts, extra)]
                for name, v in (("has_nl", nl), ("head", head), ("tail", tail), ("counts", counts)):
                    out[name].append(v)
            return out

        return run

    return make


def _finish(carried: list[str]):
    def make():
        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: cols[c] for c in carried} | {"clase": [], "stats": []}
            for ends, counts in zip(cols["ends"], cols["counts"]):
                if ends:
                    extra, nl, head, tail = fold_ends(sorted(ends, key=lambda e: e["chunk"]))
                    counts = [a + b for a, b in zip(counts, extra)]
                    for rest in (head, tail) if nl else (head,):
                        add_line(counts, rest or "")
                by = {} if _zero(counts) else dict(zip(COUNTS, counts))
                out["clase"].append(L.classify({k: by.get(f"l_{k}", 0) for k in L.KINDS}, {k: by.get(f"c_{k}", 0) for k in L.KINDS}))
                out["stats"].append(counts)
            return out

        return run

    return make


def _sum_counts() -> Column:
    return F.array(*[F.sum(F.col("counts")[i]) for i in range(len(COUNTS))]).alias("counts")


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "texto", keep: tuple[str, ...] = (), chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per input row: ``id_col``, ``keep``, counts, ratios and ``clase``.

    ``clase`` is prosa, lista, tabla, basura, spam or null (no text). Rows get a number of
    their own, so that null and repeated ids stay apart; what else is kept travels with it.
    """
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id_"), *[F.col(c).alias(f"k_{c}") for c in keep], F.col(text_col).alias("texto_"))
    kinds = dict(base.dtypes)
    carried = ["id_", *[f"k_{c}" for c in keep]]
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.char_length("texto_"), F.lit(0)) / F.lit(chunk_chars))).cast("int")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("chunk"), F.col("texto_").alias("piece")))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - F.lit(1).cast("long")), lambda i: F.struct(i.alias("chunk"), F.substring(F.col("texto_"), (i * chunk_chars + 1).cast("int"), F.lit(chunk_chars)).alias("piece")))
    pieces = base.withColumn("n_chunks", size).select("row", *carried, "n_chunks", F.explode(F.when(F.col("n_chunks") == 1, whole).otherwise(cut)).alias("p"))
    along = "".join(f", {c} {kinds[c]}" for c in carried)
    state = f"row long, chunk long{along}, many boolean, has_nl boolean, head string, tail string, counts array<long>"
    partial = map_rows(pieces.select("row", *carried, "n_chunks", "p.chunk", "p.piece"), _partials(carried), state)
    ends = F.collect_list(F.when(F.col("many"), F.struct("chunk", "has_nl", "head", "tail"))).alias("ends")
    firsts = [F.first(c).alias(c) for c in carried]
    first = partial.groupBy("row", F.floor(F.col("chunk") / FAN_IN).alias("chunk")).agg(F.max("many").alias("many"), *firsts, ends, _sum_counts())
    second = map_rows(first, _folds(carried), state).groupBy("row").agg(*firsts, ends, _sum_counts())
    done = map_rows(second.drop("row"), _finish(carried), f"{along[2:]}, clase string, stats array<long>")
    c = lambda name: F.col("stats")[_INDEX[name]]
    ratio = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    return done.select(
        F.col("id_").alias(id_col),
        *[F.col(f"k_{k}").alias(k) for k in keep],
        c("n_chars").alias("n_caracteres"),
        c("n_words").alias("n_palabras"),
        ratio("word_chars", "n_words").alias("largo_medio"),
        ratio("n_symbols", "n_solid").alias("proporcion_simbolos"),
        ratio("n_punct_lines", "n_lines").alias("lineas_con_punto"),
        ratio("n_common", "n_words").alias("palabras_comunes"),
        c("n_lines").alias("n_lineas"),
        "clase",
    )


def current_sizes(documentos: DataFrame) -> DataFrame:
    """Stored size per document id: that of the latest download; of equal ones the largest."""
    return documentos.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("fecha_descarga", "tamano_texto_bytes")).alias("m")).select(F.col("id").alias("db_id_"), F.col("m.tamano_texto_bytes").alias("guardado"))


def size_mismatches(coleccion: DataFrame, documentos: DataFrame) -> DataFrame:
    """``doc_id, guardado, medido``: stored sizes that differ from the UTF-8 length of the text.

    Texts or sizes that are null, and documents without a row, are no mismatch.
    """
    measured = coleccion.select("doc_id", "db_id", F.octet_length("texto").cast("long").alias("medido"))
    return measured.join(current_sizes(documentos), F.col("db_id") == F.col("db_id_")).where(F.col("guardado") != F.col("medido")).select("doc_id", "guardado", "medido")


def p2_found(coleccion: DataFrame, documentos: DataFrame) -> DataFrame:
    """``doc_id, clase``: lists, tables and damaged text, and stored sizes that are off."""
    stats = text_statistics(coleccion.select("doc_id", "texto"))
    classed = stats.where(F.col("clase").isin("lista", "tabla", "basura")).select("doc_id", "clase")
    return classed.unionByName(size_mismatches(coleccion, documentos).select("doc_id", F.lit("tamano").alias("clase")))
