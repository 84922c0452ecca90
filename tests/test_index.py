import math

import pytest
from pyspark.sql import functions as F

from tesela.functions.policy import PRESETS, Model, Policy
from tesela.operators import index as ix
from tesela.operators import search as se
from tesela.sources import idx

MINIMAL = PRESETS["minimo"]
DOCS = [(0, "a" * 64, "cine pelicula accion cine"), (1, "b" * 64, "pelicula drama actor"), (2, "c" * 64, "cine drama accion cine guion"), (3, "d" * 64, "")]


@pytest.fixture(scope="module")
def index(spark):
    return ix.build_index(spark.createDataFrame(DOCS, "doc_id long, hash_url string, texto string"), MINIMAL, keep=True)


def test_build(index):
    meta = index.meta.first()
    assert (meta.total_docs, meta.total_terminos, meta.total_postings) == (4, 6, 10)
    assert [tuple(r) for r in index.postings.where("termino = 'cine'").orderBy("doc_id").select("doc_id", "tf").collect()] == [(0, 2), (2, 2)]
    docs = {r.doc_id: r for r in index.documentos.collect()}
    assert docs[0].num_tokens == 4 and docs[0].norma > 0 and docs[3].num_tokens == 0 and docs[3].norma == 0
    idf = index.terminos.where("termino = 'cine'").first().idf
    assert idf == pytest.approx(math.log(4 / 2 + 1))
    assert index.postings.where("termino = 'cine' and doc_id = 0").first().peso == pytest.approx((1 + math.log(2)) * idf)


def test_sound_and_placed(index):
    assert ix.verify(index).where("problemas > 0").count() == 0
    offsets = [r.offset for r in ix.layout(index).orderBy("termino").collect()]
    start = index.meta.first().offset_postings
    assert offsets[0] == start and offsets == sorted(offsets) and start == 64 + 44 * 4 + 22 * 6 + len("accionactorcinedramaguionpelicula")


def test_verify_reports(spark, index):
    broken = ix.Index(index.documentos, index.terminos, index.postings.where("doc_id <> 2"), index.meta, index.policy, index.model)
    bad = {r.comprobacion for r in ix.verify(broken).where("problemas > 0").collect()}
    assert bad == {"postings", "df_por_termino"}


def test_empty(spark):
    e = ix.build_index(spark.createDataFrame([], "doc_id long, hash_url string, texto string"), MINIMAL)
    m = e.meta.first()
    assert (m.total_docs, m.total_terminos, m.total_postings, m.offset_postings) == (0, 0, 0, 64)
    assert ix.verify(e).where("problemas > 0").count() == 0 and ix.layout(e).count() == 0


def _ready(spark):
    """Index with given weights."""
    docs = spark.createDataFrame([(i, str(i) * 64, n, w) for i, n, w in ((0, 5, 10.0), (1, 4, 8.0), (2, 3, 6.0))], "doc_id long, hash_url string, num_tokens int, norma double")
    terms = spark.createDataFrame([("cine", 2, 1.0), ("guion", 2, 1.0), ("drama", 1, 2.0)], "termino string, df long, idf double")
    postings = spark.createDataFrame([("cine", 0, 2, 3.0), ("cine", 2, 1, 1.5), ("guion", 1, 3, 4.0), ("guion", 2, 1, 1.0), ("drama", 0, 1, 2.0)], "termino string, doc_id long, tf long, peso double")
    return ix.Index(docs, terms, postings, spark.createDataFrame([(3,)], "total_docs long"), Policy.from_flags(3), Model())


def _ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "consulta_id long, consulta string")


def test_ranking(spark):
    got = se.search(_ask(spark, "cine guion", "drama"), _ready(spark)).orderBy("consulta_id", "puesto").collect()
    assert [(r.consulta_id, r.doc_id, r.similitud) for r in got] == [(0, 1, 0.353553), (0, 2, 0.294628), (0, 0, 0.212132), (1, 0, 0.2)]
    assert got[-1].hash_url == "0" * 64
    assert se.search(_ask(spark, "cine guion"), _ready(spark), top=1).count() == 1
    assert se.search(_ask(spark, "cine guion"), _ready(spark), top=0).count() == 3


def test_missing_and_suggestions(spark):
    index = _ready(spark)
    tokens = se.query_tokens(_ask(spark, "cine inexistente", "guionistas", "!!! ???"), index)
    assert {(r.consulta_id, r.token) for r in se.missing_terms(tokens, index).collect()} == {(0, "inexistente"), (1, "guionistas")}
    assert [(r.consulta_id, r.termino) for r in se.suggestions(tokens, index).collect()] == [(1, "guion")]
    assert [r.termino for r in se.prefix_lookup(index, "g").collect()] == ["guion"] and se.prefix_lookup(index, "").count() == 0


def test_stemmed_search_finds_other_language(spark):
    docs = spark.createDataFrame([(0, "a" * 64, "the actors and the movies of the festival"), (1, "b" * 64, "las películas de los actores del festival")], "doc_id long, hash_url string, texto string")
    index = ix.build_index(docs, PRESETS["estandar"], keep=True)
    assert {r.doc_id for r in se.search(_ask(spark, "actors"), index).collect()} == {0, 1}  # both stems are "actor"
    assert [r.doc_id for r in se.search(_ask(spark, "película"), index).collect()] == [1]


def test_convergence_of_languages(spark):
    docs = spark.createDataFrame([(0, "a" * 64, "el director de la película"), (1, "b" * 64, "the director of the film")], "doc_id long, hash_url string, texto string")
    terms = ix.occurrences(docs, PRESETS["avanzado"])
    for d in (0, 1):
        assert {"film", "realiz"} <= {r.termino for r in terms.where(F.col("doc_id") == d).collect()}


def test_parquet_round_trip(spark, index, tmp_path):
    ix.write_index(index, str(tmp_path / "i"))
    again = ix.read_index(spark, str(tmp_path / "i"))
    assert again.policy.flags() == 3 and again.model == index.model
    assert sorted(again.postings.collect()) == sorted(index.postings.collect())


def test_file_round_trip(spark, index, tmp_path):
    path = tmp_path / "i.idx"
    head = idx.write_idx(index, path)
    assert idx.verify_file(path) == [] and idx.read_header(path) == head
    again = idx.read_idx(spark, path)
    assert sorted((r.termino, r.doc_id, r.tf) for r in again.postings.collect()) == sorted((r.termino, r.doc_id, r.tf) for r in index.postings.collect())
    assert {r.hash_url for r in again.documentos.collect()} == {d[1] for d in DOCS}
    assert again.terminos.where("termino = 'cine'").first().idf == pytest.approx(math.log(3), rel=1e-6)
    assert [r.doc_id for r in se.search(_ask(spark, "cine guion"), again).collect()] == [r.doc_id for r in se.search(_ask(spark, "cine guion"), index).collect()]
    other = tmp_path / "other.idx"
    idx.write_idx(index, other, "FIRMADOS")
    assert idx.verify_file(other, "FIRMADOS") == [] and idx.read_idx(spark, other, "FIRMADOS").postings.count() == 10
    with pytest.raises(ValueError, match="signed"):
        idx.read_header(other)
    raw = bytearray(path.read_bytes())
    raw[-1:] = b""
    path.write_bytes(raw)
    assert idx.verify_file(path)
    path.write_bytes(b"no" * 40)
    with pytest.raises(ValueError):
        idx.read_header(path)


def test_codecs():
    assert (idx.HEADER.size, idx.DOCUMENT.size, idx.POSTING.size, len(idx.pack_term("palabra", 1, 1.0, 0, 12))) == (64, 44, 12, 29)
    assert idx.unpack_term(idx.pack_term("año", 3, 0.5, 99, 36))[:5] == ("año", 3, 0.5, 99, 36)
    assert idx.hash_bytes("ab" * 32) == b"\xab" * 32 and idx.hash_bytes("x").ljust(32) == b"x" + bytes(31) and idx.hash_bytes(b"y" * 40) == b"y" * 32
    for bad in (lambda: idx.pack_term("a" * 70000, 1, 1.0, 0, 0), lambda: idx.unpack_term(b"\x05"), lambda: idx._unpack(idx.POSTING, b"12")):
        with pytest.raises(ValueError):
            bad()


def test_command_line(spark, tmp_path, capsys):
    from tesela.__main__ import main

    spark.createDataFrame(DOCS, "doc_id long, hash_url string, texto string").write.parquet(str(tmp_path / "c"))
    assert main(["indexar", str(tmp_path / "c"), str(tmp_path / "i"), "-c", "minimo"]) == 0
    assert main(["inspeccionar", str(tmp_path / "i")]) == 0 and main(["inspeccionar", str(tmp_path / "i"), "--termino", "cine"]) == 0
    assert main(["buscar", str(tmp_path / "i"), "cine guion"]) == 0
    assert "\t2\t" in capsys.readouterr().out
    assert main(["indexar", str(tmp_path / "c"), str(tmp_path / "j"), "-c", str(tmp_path / "none.conf")]) == 1


def test_document_numbers_are_checked(index):
    assert ix.document(index, 0).doc_id == 0
    for wrong in (-1, 10**6):
        with pytest.raises(IndexError):
            ix.document(index, wrong)


def test_blocks_give_the_index_of_one_build(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"h{i}", f"cine guion {'escena ' * (i % 3)} palabra{i}") for i in range(20)] + [(20, "h", "x" * 70_000)], "doc_id long, hash_url string, texto string")
    policy = Policy(stopwords=False, stemming=False, longitud_maxima_token=100_000)
    path = f"file://{tmp_path}/bloques"
    ix.write_blocks(docs, policy, path, 6)
    ix.write_blocks(docs.where("doc_id < 6"), policy, path, 6)  # a block written again replaces its run
    one, merged = ix.build_index(docs, policy), ix.merge_blocks(spark, path, docs, policy)
    for name in ("documentos", "terminos", "postings"):
        assert sorted(map(repr, getattr(one, name).collect())) == sorted(map(repr, getattr(merged, name).collect()))
    assert one.terminos.where("length(termino) > 65535").count() == 0 and one.documentos.where("doc_id = 20").first().num_tokens == 0


def test_file_ranges_and_term_filter(spark, index, tmp_path, monkeypatch):
    """Small ranges give the same rows; a filter on a term reads its entry only."""
    path = tmp_path / "a.idx"
    idx.write_idx(index, path)
    whole = {s: sorted(map(repr, getattr(idx.read_idx(spark, path), s).collect())) for s in ("terminos", "postings")}
    for section, rows in whole.items():
        reader = idx._Reader(str(path), section, idx.SIGNATURE)
        reader.BLOCK = reader.TERMS = 2
        parts = reader.partitions()
        assert len(parts) > 1 and len([r for p in parts for r in reader.read(p)]) == len(rows)
    term = index.terminos.orderBy("termino").collect()[1].termino
    reader = idx._TermReader(str(path), "postings", idx.SIGNATURE)
    assert len(list(reader.pushFilters([idx.EqualTo(("termino",), term)]))) == 1 and [p.count for p in reader.partitions()] == [1]
    assert {r[0] for r in reader.read(reader.partitions()[0])} == {term}
    reader.term = "zzzz"
    assert sum(p.count for p in reader.partitions()) == 0
    got = idx.read_idx(spark, path).postings.where(F.col("termino") == term).count()
    assert got == index.postings.where(F.col("termino") == term).count() > 0
