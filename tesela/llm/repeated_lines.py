"""Lines repeated across the documents of one source.

Per-source line counts are kept as a versioned table (``state.Counts``) and change by
signed deltas: documents that come, change or go are reduced to counts per (source,
line) and merged into the partitions they touch, threshold crossings are detected by
comparing two versions, and only documents that hold a line which crossed are rebuilt.

Definitions for odd input: null texts have no lines; a null source is a source
of its own (``""``); rows repeated with the same id count once; a line repeated
within a document counts once, but all its places are reported. A document that
comes again must be in the delta as gone, too (``changes`` finds those).
"""

from __future__ import annotations

import re
import uuid
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import bounded_join
from ..session import materialize, scratch_path
from . import lines as L
from .arrow import map_rows, nested
from .state import Counts

#: Documents a repeated line stands in at least, and their share of the source's documents.
LEAST_DOCS = 4
LEAST_SHARE = 0.1
#: Characters a line has at least after normalisation.
LEAST_CHARS = 15

_NUMBER = re.compile(r"\d+")
_KEY = xxhash.xxh3_64_intdigest


def normal_line(line: str) -> str:
    """Line without case, composition, white-space and number differences (input cleaned by ``lines.clean``)."""
    return " ".join(_NUMBER.sub("0", line.lower()).split())


def key64(text: str) -> int:
    """Signed 64-bit key of a string."""
    n = _KEY(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def source_name(dominio: Column) -> Column:
    """Host without case, outer blanks and leading ``www.``; null becomes ``""``."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(dominio)), r"^www\.", ""), F.lit(""))


def _lines():
    def run(cols: dict[str, list]) -> dict[str, list]:
        sizes: list[int] = []
        line: list[int] = []
        keys: list[int] = []
        for text in cols["texto_"]:
            before = len(line)
            for n, raw in enumerate(L.clean(text).split("\n") if text else (), 1):
                s = normal_line(raw)
                if len(s) >= LEAST_CHARS:
                    line.append(n)
                    keys.append(key64(s))
            sizes.append(len(line) - before)
        return {"doc_id": cols["doc_id"], "fuente": cols["fuente"], "lineas": nested(sizes, linea=(line, pa.int32()), h=(keys, pa.int64()))}

    return run


def document_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "texto", source_col: str = "dominio") -> DataFrame:
    """``doc_id, fuente, lineas<linea, h>``: the long enough lines of every document."""
    rows = df.select(F.col(id_col).alias("doc_id"), source_name(F.col(source_col)).alias("fuente"), F.col(text_col).alias("texto_"))
    return map_rows(rows, _lines, f"doc_id {dict(rows.dtypes)['doc_id']}, fuente string, lineas array<struct<linea:int,h:long>>")


def line_counts(spark: SparkSession, path: str | None = None, version: int | None = None) -> Counts:
    """Persistent ``fuente, h, n`` under a shared path; the row of a source with a null ``h`` counts its documents."""
    return Counts.load(spark, path, "fuente string, h long, n long", ("fuente", "h"), version)


def repeated(state: Counts) -> DataFrame:
    """``fuente, h`` of the lines over both thresholds; at most 10 times the mean lines of a document per source."""
    counts = state.read()
    totals = materialize(counts.where(F.col("h").isNull() & (F.col("n") >= LEAST_DOCS)).select("fuente", F.col("n").alias("documentos")), "line-totals")
    least = F.greatest(F.lit(LEAST_DOCS), F.ceil(F.col("documentos") * F.lit(LEAST_SHARE) - F.lit(1e-9)))
    over = bounded_join(counts.where(F.col("h").isNotNull() & (F.col("n") >= LEAST_DOCS)), totals, ["fuente"], "h")
    return over.where(F.col("n") >= least).select("fuente", "h")


def line_delta(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``fuente, h, n`` as changes, of ``document_lines`` that come and go."""
    keys = F.concat(F.array_distinct(F.transform("lineas", lambda x: x["h"])), F.array(F.lit(None).cast("long")))
    parts = []
    for lines, sign in ((added, 1), (removed, -1)):
        if lines is not None:
            each = lines.select("fuente", F.explode(keys).alias("h"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d")).groupBy("fuente", "h").agg(F.count_distinct("d").alias("n"))
            parts.append(each.withColumn("n", F.col("n") * sign))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) ``doc_id, dominio, texto`` between two states of a collection; documents that stay as they are stand in neither."""
    cols = ["doc_id", "dominio", "texto"]
    a, b = (df.select(*cols, F.xxhash64(F.coalesce(source_name(F.col("dominio")), F.lit("")), F.coalesce("texto", F.lit("\x00"))).alias("huella_")) for df in (old, new))
    same = lambda x, y: x.join(y.select(F.col("doc_id").alias("id_"), F.col("huella_").alias("otra_")), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("huella_") == F.col("otra_")), "left_anti").select(*cols)
    return same(b, a), same(a, b)


def crossings(before: Counts, after: Counts) -> DataFrame:
    """``fuente, h, repetida``: lines that became repeated (true) or ceased to be (false)."""
    now = repeated(after)
    if not before.parts:
        return now.withColumn("repetida", F.lit(True))
    now, old = materialize(now, "repeated-now"), materialize(repeated(before), "repeated-before")
    return now.join(old, ["fuente", "h"], "left_anti").withColumn("repetida", F.lit(True)).unionByName(old.join(now, ["fuente", "h"], "left_anti").withColumn("repetida", F.lit(False)))


def places(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id, linea`` of every place of a repeated line. ``repeated`` is written first, then joined by its size."""
    each = lines.select("doc_id", "fuente", F.inline("lineas"))
    return bounded_join(each, materialize(repeated, "repeated"), ["fuente", "h"], "doc_id").select("doc_id", "linea").distinct()


def rebuild(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "texto") -> DataFrame:
    """``id_col, texto_limpio`` of the documents that hold one of the found places; the others need no change."""
    drop = found.groupBy(F.col("doc_id").alias("id_")).agg(F.collect_set("linea").alias("quitar"))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("quitar", (i + 1).cast("int")))
    return df.select(id_col, text_col).join(drop, F.col(id_col) == F.col("id_")).select(id_col, F.array_join(kept, "\n").alias("texto_limpio"))


def p4_state(coleccion: DataFrame, path: str | None = None, batch: str | None = None) -> tuple[DataFrame, Counts, Counts]:
    """Lines of the documents, and the state before and after they came."""
    lines = materialize(document_lines(coleccion), "lines")
    before = line_counts(coleccion.sparkSession, path)
    return lines, before, before.merge(line_delta(lines), "n", batch)


def p4_found(coleccion: DataFrame) -> DataFrame:
    """``doc_id, linea`` of the repeated lines of all sources."""
    lines, before, after = p4_state(coleccion)
    return places(lines, crossings(before, after).where("repetida").select("fuente", "h"))


def p4_clean(coleccion: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, texto_limpio`` of every document, without its repeated lines."""
    lines, _, after = p4_state(coleccion, path)
    changed = rebuild(coleccion, places(lines, repeated(after)))
    return coleccion.select("doc_id", "texto").join(changed, "doc_id", "left").select("doc_id", F.coalesce("texto_limpio", "texto").alias("texto_limpio"))


def p4_update(held: DataFrame, added: DataFrame, removed: DataFrame | None = None, path: str | None = None, batch: str | None = None) -> DataFrame:
    """``doc_id, texto_limpio`` of the documents to rebuild when ``added`` come and ``removed`` go.

    ``held`` are the documents that stay. One of them is rebuilt only if one of its lines crossed a
    threshold; added ones are built if they hold a repeated line. The state is the one under ``path``, which
    must know the held and the removed documents; without a path it is made of them.
    """
    held, added = (df.select("doc_id", "dominio", "texto") for df in (held, added))
    old_lines = materialize(document_lines(held), "lines")
    new_lines = materialize(document_lines(added), "lines")
    gone = None if removed is None else materialize(document_lines(removed), "lines")
    before = line_counts(held.sparkSession, path)
    if path is None:
        before = before.merge(line_delta(old_lines if gone is None else old_lines.unionByName(gone)), "n")
    after = before.merge(line_delta(new_lines, gone), "n", batch)
    crossed = materialize(crossings(before, after).select("fuente", "h"), "crossed")
    each = old_lines.select("doc_id", "fuente", F.inline("lineas"))
    touched = bounded_join(each, crossed, ["fuente", "h"], "doc_id", "left_semi").select("doc_id").distinct()
    lines = old_lines.join(touched, "doc_id", "left_semi").unionByName(new_lines)
    found = places(lines, repeated(after))
    docs = held.join(touched, "doc_id", "left_semi").unionByName(added)
    changed = rebuild(docs, found)
    return docs.join(found.select("doc_id").distinct().unionByName(touched).distinct(), "doc_id", "left_semi").select("doc_id", "texto").join(changed, "doc_id", "left").select("doc_id", F.coalesce("texto_limpio", "texto").alias("texto_limpio"))


def p4_incremental(base: DataFrame, added: DataFrame) -> DataFrame:
    """``doc_id, texto_limpio`` of every document after ``added`` joined ``base``: what was cleaned before, replaced where it had to be rebuilt."""
    path = scratch_path(base.sparkSession, f"line-counts-{uuid.uuid4().hex[:12]}")
    before = p4_clean(base, path)
    rebuilt = materialize(p4_update(base, added, path=path), "rebuilt")
    kept = before.unionByName(added.select("doc_id", F.col("texto").alias("texto_limpio")))
    return kept.join(rebuilt.select("doc_id"), "doc_id", "left_anti").unionByName(rebuilt)
