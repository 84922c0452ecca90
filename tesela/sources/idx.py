"""The single-file index form: record codecs, export, and a Spark reader.

Layout (little-endian): a header of 64 bytes, documents of 44 bytes, dictionary
entries of 22 bytes and the term, postings of 12 bytes. The native form of an
index are the Parquet tables of ``operators.index``; this file is for exchange,
and is written serially because every offset depends on what lies before it. The 8 bytes
of the signature are a parameter, so that files of other programs with this layout
can be read and written too.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..functions.policy import Model, Policy
from ..operators.index import SIGNATURE, Index, layout

# FIXED VALUES: the record formats.
VERSION = 1
HEADER = struct.Struct("<8sHHIIQQQQ12s")
DOCUMENT = struct.Struct("<I32sIf")
ENTRY = struct.Struct("<IfQI")
POSTING = struct.Struct("<IIf")
FIELDS = ("firma", "version", "flags", "total_docs", "total_terminos", "total_postings", "offset_docs", "offset_diccionario", "offset_postings", "reservado")


def hash_bytes(value: str | bytes) -> bytes:
    """Exactly 32 bytes: hexadecimal of 64 digits decoded, 32 bytes as they are, all else cut or padded."""
    if isinstance(value, str):
        value = value.strip().encode("utf-8", "ignore")
    elif len(value) == 32:
        return bytes(value)
    if len(value) == 64:
        try:
            return bytes.fromhex(bytes(value).decode("ascii"))
        except ValueError:
            pass
    return bytes(value[:32]).ljust(32, b"\0")


def _unpack(record: struct.Struct, raw: bytes) -> tuple:
    if len(raw) < record.size:
        raise ValueError(f"record of {record.size} bytes expected, {len(raw)} given")
    return record.unpack_from(raw)


def pack_term(term: str, df: int, idf: float, offset: int, size: int) -> bytes:
    raw = term.encode("utf-8")
    if len(raw) > 0xFFFF:
        raise ValueError("term longer than 65535 bytes")
    return struct.pack("<H", len(raw)) + raw + ENTRY.pack(df, idf, offset, size)


def unpack_term(raw: bytes, at: int = 0) -> tuple[str, int, float, int, int, int]:
    """term, df, idf, offset, bytes, and the position after the entry."""
    if len(raw) < at + 2:
        raise ValueError("dictionary entry cut off")
    n = struct.unpack_from("<H", raw, at)[0]
    end = at + 2 + n
    return (raw[at + 2 : end].decode("utf-8"), *_unpack(ENTRY, raw[end : end + ENTRY.size]), end + ENTRY.size)


def read_header(path: str | Path, signature: str = SIGNATURE) -> dict:
    with open(path, "rb") as f:
        head = dict(zip(FIELDS, _unpack(HEADER, f.read(HEADER.size))))
    if head["firma"] != signature.encode("ascii"):
        raise ValueError(f"not an index file signed {signature}")
    if head["version"] != VERSION:
        raise ValueError(f"version {head['version']} is not supported")
    return head


def write_idx(index: Index, path: str | Path, signature: str = SIGNATURE) -> dict:
    """Write the file through a temporary one beside it; rows stream in order, none is kept. Returns the header."""
    path = Path(path)
    meta = index.meta.first()
    temporary = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    with open(temporary, "wb", buffering=1 << 20) as f:
        f.write(bytes(HEADER.size))
        for d in index.documentos.orderBy("doc_id").toLocalIterator(prefetchPartitions=True):
            f.write(DOCUMENT.pack(d.doc_id, hash_bytes(d.hash_url), d.num_tokens, d.norma))
        dictionary = f.tell()
        terms = layout(index).join(index.terminos.select("termino", "idf"), "termino").orderBy("termino")
        last, total = None, 0
        for t in terms.toLocalIterator(prefetchPartitions=True):
            if t.termino == last:
                raise ValueError(f"term {t.termino!r} twice")
            last, total = t.termino, total + 1
            f.write(pack_term(t.termino, t.df, t.idf, t.offset, t.bytes))
        postings, count = f.tell(), 0
        for p in index.postings.orderBy("termino", "doc_id").toLocalIterator(prefetchPartitions=True):
            f.write(POSTING.pack(p.doc_id, p.tf, p.peso))
            count += 1
        values = (signature.encode("ascii"), VERSION, index.policy.flags(), meta.total_docs, total, count, HEADER.size, dictionary, postings, index.model.reserved_bytes())
        f.seek(0)
        f.write(HEADER.pack(*values))
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    return dict(zip(FIELDS, values))


def verify_file(path: str | Path, signature: str = SIGNATURE) -> list[str]:
    """Problems of a file's structure: offsets, term order, posting blocks, totals."""
    head, size = read_header(path, signature), Path(path).stat().st_size
    out = []
    if head["offset_docs"] != HEADER.size:
        out.append("offset_docs")
    if head["offset_diccionario"] != head["offset_docs"] + DOCUMENT.size * head["total_docs"]:
        out.append("offset_diccionario")
    if not head["offset_diccionario"] <= head["offset_postings"] <= size:
        return [*out, "offsets outside the file"]
    expected, last, n = head["offset_postings"], None, 0
    for term, _, _, offset, length in _terms(path, head):
        n += 1
        if last is not None and term <= last:
            out.append(f"order at {term!r}")
        if offset != expected:
            out.append(f"gap at {term!r}")
        if length % POSTING.size:
            out.append(f"block of {term!r}")
        last, expected = term, expected + length
    if n != head["total_terminos"]:
        out.append("total_terminos")
    if expected != size:
        out.append("postings end elsewhere")
    if (size - head["offset_postings"]) // POSTING.size != head["total_postings"]:
        out.append("total_postings")
    return out


def _terms(path: str | Path, head: dict, at: int | None = None, count: int | None = None) -> Iterator[tuple[str, int, float, int, int]]:
    """Dictionary entries from a byte position on, read as they come."""
    for entry in _placed(path, head, at, count):
        yield entry[:-1]


def _placed(path: str | Path, head: dict, at: int | None = None, count: int | None = None) -> Iterator[tuple[str, int, float, int, int, int]]:
    """… each with the byte position it stands at."""
    with open(path, "rb", buffering=1 << 20) as f:
        at = head["offset_diccionario"] if at is None else at
        f.seek(at)
        for _ in range(head["total_terminos"] if count is None else count):
            size = f.read(2)
            raw = size + f.read(int.from_bytes(size, "little") + ENTRY.size)
            *entry, n = unpack_term(raw)
            yield (*entry, at)
            at += n


class _Range(InputPartition):
    """Entries from a position on: a document number, or a byte of the dictionary."""

    def __init__(self, start: int, count: int):
        super().__init__((start, count))
        self.start, self.count = start, count


class _Reader(DataSourceReader):
    """Documents, terms and postings in ranges. The dictionary is walked once, for its ranges; a task reads its own."""

    BLOCK = 1 << 20
    TERMS = 1 << 18

    def __init__(self, path: str, section: str, signature: str):
        self.path, self.section, self.signature = path, section, signature
        self.term: str | None = None

    def partitions(self) -> list[InputPartition]:
        head = read_header(self.path, self.signature)
        if self.section == "documentos":
            step = self.BLOCK
            return [_Range(i, min(step, head["total_docs"] - i)) for i in range(0, head["total_docs"], step)] or [_Range(0, 0)]
        parts, start, entries, rows = [], head["offset_diccionario"], 0, 0
        for term, df, _, _, _, at in _placed(self.path, head):
            if self.term is not None:
                if term >= self.term:  # terms are sorted
                    return [_Range(at, int(term == self.term))]
                continue
            if entries >= self.TERMS or self.section == "postings" and rows >= self.BLOCK:
                parts.append(_Range(start, entries))
                start, entries, rows = at, 0, 0
            entries, rows = entries + 1, rows + df
        return [*parts, _Range(start, entries)]

    def read(self, partition: _Range) -> Iterator:
        head = read_header(self.path, self.signature)
        with open(self.path, "rb") as f:
            if self.section == "documentos":
                f.seek(head["offset_docs"] + DOCUMENT.size * partition.start)
                for _ in range(partition.count):
                    doc, digest, n, norm = _unpack(DOCUMENT, f.read(DOCUMENT.size))
                    yield doc, digest.hex(), n, norm
                return
            for term, df, idf, offset, length in _terms(self.path, head, partition.start, partition.count):
                if self.section == "terminos":
                    yield term, df, idf
                    continue
                f.seek(offset)
                for doc, tf, weight in POSTING.iter_unpack(f.read(length)):
                    yield term, doc, tf, weight


class _TermReader(_Reader):
    """Reads the entry of one term only where a filter names it."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("termino",):
                self.term = f.value
            yield f  # Spark looks at the rows again


class IdxSource(DataSource):
    """``spark.read.format("idx").option("section", "postings").option("signature", …).load(path)``.

    With the option ``pushdown`` filters on a term reach the file; Spark wants
    ``spark.sql.python.filterPushdown.enabled`` for that, which ``read_idx`` sets.
    """

    _SCHEMAS = {"documentos": "doc_id long, hash_url string, num_tokens int, norma double", "terminos": "termino string, df long, idf double", "postings": "termino string, doc_id long, tf long, peso double"}

    @classmethod
    def name(cls) -> str:
        return "idx"

    def _section(self) -> str:
        return self.options.get("section", "postings")

    def schema(self) -> str:
        return self._SCHEMAS[self._section()]

    def reader(self, schema) -> DataSourceReader:
        kind = _TermReader if self.options.get("pushdown", "false") == "true" and self._section() != "documentos" else _Reader
        return kind(self.options["path"], self._section(), self.options.get("signature", SIGNATURE))


def read_idx(spark: SparkSession, path: str | Path, signature: str = SIGNATURE) -> Index:
    """Index over a file: normalisation and model come from its header."""
    spark.dataSource.register(IdxSource)
    head = read_header(path, signature)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda s: spark.read.format("idx").option("section", s).option("signature", signature).option("pushdown", "true").load(str(path))
    model = Model.from_reserved(head["reservado"])
    row = {k: head[k] for k in FIELDS[1:9]} | {"esquema_tf": model.esquema_tf, "esquema_idf": model.esquema_idf, "coseno": model.normalizacion_coseno, "suavizado": model.suavizado_idf}
    meta = spark.createDataFrame(pa.Table.from_pylist([{"firma": signature} | row]).to_pandas())
    return Index(load("documentos"), load("terminos"), load("postings"), meta, Policy.from_flags(head["flags"]), model)


def term_postings(index: Index, term: str) -> DataFrame:
    """Postings of a term; an absent term has none."""
    return index.postings.where(F.col("termino") == term)
