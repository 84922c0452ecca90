"""Languages, statistics, repeated lines, boilerplate and spam on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.llm import boilerplate, language, quality, repeated_lines, spam
from tesela.llm import lines as L

ES = "La historia de la película que vimos en el cine es la de un hombre que no sabe lo que quiere de su vida. "
EN = "The story of the film that we saw at the cinema is that of a man who does not know what he wants from life. "
FR = "Le film que nous avons vu au cinéma est une histoire qui se passe dans la ville et qui ne finit pas. "
DE = "Der Film, den wir im Kino gesehen haben, ist eine Geschichte von einem Mann, der nicht weiß, was er will. "
IT = "Il film che abbiamo visto al cinema è la storia di un uomo che non sa che cosa vuole dalla sua vita. "
PT = "O filme que vimos no cinema é a história de um homem que não sabe o que quer da sua vida e não vai embora. "
ALL = dict(zip(language.LANGUAGES, (ES, EN, PT, FR, IT, DE)))
BASE = "La sala {i} abre a las ocho y la función {n} comienza cuando el público está sentado. "


# -- 1 ---------------------------------------------------------------------------------------
def tiny_model():
    rows = [(t * 4, code) for code, t in ALL.items() for _ in range(3)]
    bound = language.TrainingBound(iterations=25)
    return language.Crf.fit(language.training_sequences(rows, bound), bound)


def test_blocks_hand_over_exactly(monkeypatch):
    """Marginals of long texts do not depend on where the blocks end; one word a block, blocks within lines, and one block."""
    model = tiny_model()
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(list(ALL.values())) * rng.randrange(1, 3) for _ in range(n)) for n in (1, 6, 9)] + ["", "x", (EN + ES) * 20]
    sums = {}
    for size in (1, 7, 40, 256, 100_000):
        monkeypatch.setattr(language, "BLOCK_WORDS", size)
        sums[size] = language.Labeller(model).line_sums(texts)
    for size, got in sums.items():
        for a, b in zip(got, sums[100_000]):
            assert np.allclose(a, b, atol=2e-3), size


def test_saved_model(spark, tmp_path):
    model = tiny_model()
    language.save_model(spark, model, f"file://{tmp_path}/crf")
    again = language.load_model(spark, f"file://{tmp_path}/crf")
    words = ["película", "the", "qzxw", "und"]
    assert np.allclose(model.scores(words), again.scores(words)) and np.allclose(model.across, again.across) and len(again.features) == len(model.features)


def test_forward_backward_is_exact():
    """Marginals against the sum over all label paths."""
    rng = np.random.default_rng(0)
    k = language.K
    e = rng.normal(size=(3, 1, k))
    within, across = rng.normal(size=(k, k)), rng.normal(size=(k, k))
    breaks = np.array([[False], [True], [False]])
    post, exp_in, exp_out = language.Crf._run(e.copy(), breaks, np.array([3]), within, across, True)
    want, win, wout, z = np.zeros((3, k)), np.zeros((k, k)), np.zeros((k, k)), 0.0
    for a in range(k):
        for b in range(k):
            for c in range(k):
                p = np.exp(e[0, 0, a] + across[a, b] + e[1, 0, b] + within[b, c] + e[2, 0, c])
                z += p
                want[0, a] += p
                want[1, b] += p
                want[2, c] += p
                wout[a, b] += p
                win[b, c] += p
    np.testing.assert_allclose(post[:, 0], want / z, rtol=1e-9)
    np.testing.assert_allclose(exp_in, win / z, rtol=1e-9)
    np.testing.assert_allclose(exp_out, wout / z, rtol=1e-9)


def test_sequences_of_unequal_size_do_not_touch_each_other():
    model = tiny_model()
    both = language.Labeller(model).line_sums([ES * 3, EN])
    np.testing.assert_allclose(both[1], language.Labeller(model).line_sums([EN])[0], rtol=1e-4)
    long = language.Labeller(model).line_sums([(ES * 40).strip()])[0]  # longer than a block
    assert long.sum() == pytest.approx(len(language._WORD.findall(ES)) * 40, rel=1e-4)


def test_labels(spark):
    mixed = "\n".join([ES.strip(), ES.strip(), "", EN.strip(), "ACTO II", "https://a.example/una/ruta/muy/larga/que/no/dice/nada/de/nadie"])
    rows = [(i, t) for i, t in enumerate([*(t * 2 for t in ALL.values()), mixed, None, "", "12 34 --", "x" * 70000])]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, texto string, idioma int")
    got = {r.doc_id: r for r in language.label_texts(df.select("doc_id", "texto"), tiny_model()).collect()}
    assert [got[i].idioma for i in range(6)] == list(language.LANGUAGES) and all(got[i].confianza > 0.6 and not got[i].mixto for i in range(6))
    assert got[6].mixto and got[6].idioma == "es" and [(s.linea, s.idioma) for s in got[6].segmentos] == [(1, "es"), (2, "es"), (4, "en")]
    assert all(got[i].idioma is None and got[i].segmentos == [] for i in (7, 8, 9)) and got[10].doc_id == 10


def test_p1_found(spark):
    docs = [(i, (t * 3).strip(), code if i % 2 else code.upper()) for i, (code, t) in enumerate(list(ALL.items()) * 6)]
    docs += [(100, (EN * 3).strip(), None), (101, (EN * 3).strip(), "es-ES"), (102, (EN * 3).strip(), "English"), (103, None, "es"), (104, "", None), (105, ES.strip() + "\n" + ES.strip() + "\n" + EN.strip(), "spa")]
    documents = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, lang string, declarado string")
    empty = documents.limit(0)
    labels = spark.createDataFrame([], "etiqueta_id long, doc_id long, idioma string, registrado_en timestamp")
    pages = empty.select("doc_id", F.col("text").alias("texto"))
    bound = language.TrainingBound(iterations=25)
    got = sorted((r.tabla, r.doc_id, r.linea, r.idioma) for r in language.p1_found(pages, labels, documents, bound).collect())
    assert got == [("documents", 100, 0, "en"), ("documents", 101, 0, "en"), ("documents", 105, 1, "es"), ("documents", 105, 2, "es"), ("documents", 105, 3, "en")]
    assert language.p1_found(pages, labels, empty, bound).count() == 0


def test_declared(spark):
    df = spark.createDataFrame([("es_MX",), ("Deutsch",), (" EN",), ("xx",), ("",), (None,), ("português",)], "l string")
    assert [r[0] for r in df.select(language.declared_language(F.col("l"))).collect()] == ["es", "de", "en", None, None, None, "pt"]


# -- 2 ---------------------------------------------------------------------------------------
TABLE = "\n".join(f"Título{i} | {1950 + i} | {i} | Casa" for i in range(8))
LIST = "\n".join(f"• Nombre Apellido{i}, La escena notable" for i in range(9))
JUNK = "\n".join("".join(random.Random(i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=76)) for i in range(9))
CODE = "\n".join(f"function f{i}(e){{var a=e||{{}};return {i}.q==2?1:0;}}" for i in range(8))
MOJIBAKE = "\n".join("LÃa pÃªlÃculÃa Ãs mÃy lÃrga y nÃo tÃrmina, dÃcen lÃos dÃmÃs Ãhora." for _ in range(8))
PROSE = (ES + "\n") * 6


@pytest.mark.parametrize(("text", "want"), [(TABLE, "tabla"), (LIST, "lista"), (JUNK, "basura"), (CODE, "basura"), (MOJIBAKE, "basura"), (PROSE, "prosa"), (PROSE + LIST[:120], "prosa"), ("", None), ("Título", "prosa")])
def test_classes(text, want):
    assert L.text_class(text) == want


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_chunks_change_nothing(spark, size):
    texts = [TABLE, LIST, PROSE, "una línea sin fin", "", "\n\n", "a\r\nb\r\n", None, "á" * 300 + "\n" + ES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, texto string")
    whole = sorted(map(tuple, quality.text_statistics(df).collect()))
    assert sorted(map(tuple, quality.text_statistics(df, chunk_chars=size).collect())) == whole


def test_statistics(spark):
    df = spark.createDataFrame([(1, "Hola mundo.\n\nde la ## x"), (1, "Hola mundo.\n\nde la ## x"), (None, "a"), (3, None), (4, "")], "doc_id long, texto string")
    got = sorted(map(tuple, quality.text_statistics(df).collect()), key=repr)
    first = (1, 21, 5, 14 / 5, 2 / 18, 0.5, 0.4, 2)
    assert sum(t[0] == 1 for t in got) == 2
    for t in got:
        if t[0] == 1:
            assert t[1:3] == first[1:3] and t[3] == pytest.approx(first[3]) and t[5] == first[5] and t[7] == 2
        if t[0] == 3:
            assert t[1:] == (None,) * 8
        if t[0] == 4:
            assert t[2] == 0 and t[3] is None and t[8] is None
    assert quality.text_statistics(df.limit(0)).count() == 0


def test_p2_found(spark):
    pages = spark.createDataFrame([(0, 10, TABLE, "z"), (1, 11, LIST, "z"), (2, 12, PROSE, "z"), (3, None, None, "z"), (4, 99, "ñ", "z")], "doc_id long, db_id long, texto string, clase string")
    docs = spark.createDataFrame([(10, len(TABLE.encode()), "2024-01-02"), (11, 5, "2024-01-02"), (11, len(LIST.encode()), "2024-01-01"), (12, None, "2024-01-01"), (None, 1, None)], "id long, tamano_texto_bytes long, fecha_descarga string")
    assert sorted(tuple(r) for r in quality.p2_found(pages, docs).collect()) == [(0, "tabla"), (1, "lista"), (1, "tamano")]


# -- 4 ---------------------------------------------------------------------------------------
def site(n, texts, name="sitio.test"):
    return [(n + i, name, t) for i, t in enumerate(texts)]


def test_p4_found(spark):
    unique = [f"Texto propio de la página con su historia {chr(97 + i) * 5}" for i in range(12)]
    notice = ["© 2020 Todos los derechos reservados", "© 1999 todos  los DERECHOS reserva​dos", "© 7 Todos los derechos reservados\r"]
    texts = [f"{u}\n\n{notice[i % 3]}" if i < 4 else u for i, u in enumerate(unique)]
    rows = [(i, ("WWW.Sitio.test ", "sitio.test")[i % 2], t, "c") for i, t in enumerate(texts)]
    rows += [(50 + i, "otro.test", "© 2020 Todos los derechos reservados", "c") for i in range(3)] + [(90, None, None, "c"), (91, "sitio.test", "", "c"), (92, "sitio.test", "corta\ncorta", "c")]
    df = spark.createDataFrame(rows, "doc_id long, dominio string, texto string, quitar string")
    assert sorted(tuple(r) for r in repeated_lines.p4_found(df).collect()) == [(i, 3) for i in range(4)]
    clean = {r.doc_id: r.texto_limpio for r in repeated_lines.p4_clean(df).collect()}
    assert clean[0] == unique[0] + "\n" and clean[7] == unique[7] and clean[90] is None and clean[91] == "" and len(clean) == len(rows)
    assert repeated_lines.p4_found(df.limit(0)).count() == 0


def test_share_counts(spark):
    """Four documents suffice only while they are a tenth of the source."""
    texts = [f"línea propia de la página {chr(97 + i % 26)}{chr(97 + i // 26)} sin más" for i in range(41)]
    make = lambda n: spark.createDataFrame(site(0, [t + ("\nesto se repite en cuatro" if i < 4 else "") for i, t in enumerate(texts[:n])]), "doc_id long, dominio string, texto string")
    assert repeated_lines.p4_found(make(40)).count() == 4 and repeated_lines.p4_found(make(41)).count() == 0


def repeats():
    return [f"línea propia {chr(97 + i) * 6} de la página\n" + ("aviso legal de todas las páginas\n" if i % 2 else "menú que pocas páginas tienen\n" if i in (2, 4, 6, 12) else "") for i in range(14)]


def cleaned(df):
    return {r.doc_id: r.texto_limpio for r in df.collect()}


def test_increments_equal_one_run(spark):
    df = spark.createDataFrame(site(0, repeats()), "doc_id long, dominio string, texto string")
    base, added = df.where("doc_id < 7"), df.where("doc_id >= 7")
    whole = cleaned(repeated_lines.p4_clean(df))
    assert cleaned(repeated_lines.p4_incremental(base, added)) == whole
    rebuilt = cleaned(repeated_lines.p4_update(base, added))
    assert rebuilt.keys() < whole.keys() and {1, 3, 5} <= rebuilt.keys() and all(whole[k] == v for k, v in rebuilt.items())


def test_changed_and_deleted_documents(spark, tmp_path):
    """Deltas with documents that change, go and come again, against counting afresh; only the touched partitions are written."""
    texts = repeats()
    schema = "doc_id long, dominio string, texto string"
    old = spark.createDataFrame(site(0, texts), schema)
    rows = {i: t for i, t in enumerate(texts) if i not in (1, 3)} | {5: "línea cambiada de la página\nmenú que pocas páginas tienen", 20: "menú que pocas páginas tienen"}
    new = spark.createDataFrame([(i, "sitio.test", t) for i, t in rows.items()], schema)
    added, removed = repeated_lines.changes(old, new)
    assert {r.doc_id for r in added.collect()} == {5, 20} and {r.doc_id for r in removed.collect()} == {1, 3, 5}
    path = f"file://{tmp_path}/lineas"
    before = cleaned(repeated_lines.p4_clean(old, path))
    held = old.join(removed.select("doc_id"), "doc_id", "left_anti")
    rebuilt = cleaned(repeated_lines.p4_update(held, added, removed, path, batch="uno"))
    now = {k: rebuilt.get(k, before.get(k, rows[k])) for k in rows}
    assert now == cleaned(repeated_lines.p4_clean(new))
    state, afresh = repeated_lines.line_counts(spark, path), repeated_lines.p4_state(new)[2]
    assert sorted(map(repr, state.read().collect())) == sorted(map(repr, afresh.read().collect()))
    again = state.merge(repeated_lines.line_delta(repeated_lines.document_lines(added)), "n", "uno")
    assert again.version == state.version  # a delta that is in counts once


# -- 6 ---------------------------------------------------------------------------------------
def page(i, host):
    name = host.split(".")[0].capitalize()
    own = chr(97 + i % 26) + chr(97 + i // 26)
    body = [ES.replace("hombre", f"hombre{own}"), BASE.format(i=i, n=own * 3)]
    return "\n".join(["Inicio", "Foro > Series", f"Por Ana Ruiz{chr(97 + i % 26)}, redacción de {name}", *body, "Director: Juan" if i % 50 == 0 else "Fin propio " + "z" * (i + 1), "", f"Así fue el rodaje de Casa Roja{chr(97 + i % 26)} en Lugo", f"© {1990 + i} {name}. Todos los derechos reservados."])


def sites(n, often=40):
    """Hosts of n pages: the first ``often`` stand on ten hosts, the others on one each."""
    return [f"sitio{chr(97 + (i % 10 if i < often else i) % 26)}{chr(97 + (i // 26 if i >= often else 0))}.example" for i in range(n)]


def test_p6_found(spark):
    """Hosts of four pages show their templates; hosts of one page share them."""
    hosts = sites(60)
    pages = [(i, f"https://www.{h}/p/{i}", page(i, h), "zz") for i, h in enumerate(hosts)] + [(98, "https://x.example/", None, "zz"), (99, None, "", "zz")]
    html = spark.createDataFrame(pages, "pagina_id long, url string, texto string, linea string")
    none = spark.createDataFrame([], "doc_id long, dominio string, texto string")
    got = {(r.id, r.linea) for r in boilerplate.p6_found(none, html).collect()}
    assert got == {(i, n) for i in range(60) for n in (1, 2, 3, 8, 9)}
    own = {(r.id, r.linea): r.propia for r in boilerplate.page_lines(none, html).collect()}
    assert {i for (i, _), v in own.items() if v} == set(range(40)) and all(own[i, n] for i in range(40) for n in (1, 2, 3, 9))
    few = html.where("pagina_id < 4 OR pagina_id >= 40")
    assert boilerplate.p6_found(none, few).count() == 0  # no host shows what recurs
    bodies = {r.id: r.cuerpo for r in boilerplate.p6_bodies(none, html).collect()}
    assert len(bodies[3].split("\n")) == 4 and bodies[98] is None and bodies[99] == ""
    assert boilerplate.p6_found(none, html.limit(0)).count() == 0


def test_masks():
    assert boilerplate.plain(boilerplate.site_mask("© 2020  Filmeria. Todos", "filmeria")) == "© 0 \x01. todos"
    assert boilerplate.named(boilerplate.site_mask("Ten reasons to watch Vapalgo Babanote before 1949", "x")) == "ten reasons to watch \x02 before 0"
    assert boilerplate.named("Lafliruza Dudronali on Rapodidro Mepena: x") == "\x02 on \x02: x"
    assert boilerplate.line_nodes("INT. CASA - NOCHE 3", "x")[1:] == ([], [])
    assert boilerplate.line_nodes("Anime | 12 | -", "x")[2] == []


# -- 7 ---------------------------------------------------------------------------------------
PILE = "descargar películas gratis ver series online comprar estrenos baratas " * 12
LINKS = "\n".join(f"Descargar series {w} gratis - https://a.test/ver-estrenos-online-{i}" for i, w in enumerate(["Uno", "Dos", "Tres", "Seis", "Siete", "Ocho"]))


@pytest.mark.parametrize(("text", "want"), [(PILE, True), (LINKS, True), (PROSE, False), (LIST, False), (TABLE, False), (JUNK, False), ("", False), (PROSE + PILE[:60], False)])
def test_spam(text, want):
    assert (L.text_class(text) == "spam") is want


def test_p7_found(spark):
    pages = spark.createDataFrame([(0, 1, PILE, "u"), (1, 2, PROSE, "u"), (2, None, None, "u"), (3, 3, PILE, "u"), (3, 3, PILE, "u"), (4, 4, "", "u")], "doc_id long, db_id long, texto string, url string")
    docs = spark.createDataFrame([(1, None), (2, "https://a.test/ver-series-online-gratis"), (2, "https://a.test/b"), (None, "x")], "id long, url string")
    assert sorted(r.doc_id for r in spam.p7_found(pages, docs).collect()) == [0, 3, 3]
    got = {r.doc_id: r for r in spam.p7_scores(pages, docs).collect()}
    assert got[1].palabras_url == 4 and not got[1].es_spam and got[2].proporcion_spam == 0 and got[0].redundancia > 2
    assert spam.p7_found(pages.limit(0), docs.limit(0)).count() == 0


PHRASES = ["Buy anime Zulfalanren best price", "Download series best price", "Get box sets Pitita cheap"]
DRESSED = "\n".join(f"{PHRASES[i % 3]} {verb} {PHRASES[(i + i // 3) % 3].lower()}, with patience. {PHRASES[(i + 1) % 3]} {PHRASES[i * i % 3].lower()}!" for i, verb in enumerate("sustains reinforces complicates questions pursues celebrates follows abandons hides explains".split()))


def test_sentence_ends_do_not_hide_search_phrases(spark):
    assert L.text_class(DRESSED) == "spam" and L.text_class(EN * 6) == L.text_class(("\n" + ES) * 6) == "prosa"
    schema = "doc_id long, db_id long, texto string"
    pages = spark.createDataFrame([(0, 1, DRESSED), (1, 2, PROSE)], schema)
    docs = spark.createDataFrame([(1, None)], "id long, url string")
    assert [r.doc_id for r in spam.p7_found(pages, docs).collect()] == [0]
    # about half dressed: the address decides
    half = spark.createDataFrame([(0, 1, DRESSED + "\n" + OTHER), (1, 2, DRESSED + "\n" + OTHER)], schema)
    docs = spark.createDataFrame([(1, "https://a.test/buy-series-online-cheap"), (2, "https://a.test/notes")], "id long, url string")
    assert [r.doc_id for r in spam.p7_found(half, docs).collect()] == [0]


OTHER = """The director spent eleven winters on the northern coast before anyone would lend the crew a boat.
Critics who had expected a quiet portrait left the screening arguing about its violent last reel.
Her grandmother kept every letter in a biscuit tin under the stairs, and nobody ever asked why.
Sound was recorded separately in an abandoned chapel whose roof had collapsed during the storm.
Financing came from three small banks, a shipping clerk, and the composer's impatient brother.
Years later the negative turned up in a museum basement, mislabelled and badly scratched.
Restoration took eighteen months because half the colour information had already faded away.
What survives today is shorter than the version shown at its premiere but far easier to follow.
Actors remember long silences, cold coffee, and a dog that wandered through each rehearsal.
Only one photograph of the original set exists, and it hangs in the mayor's private office."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\n".join(f"{a} {b}" for a in ("Ver", "Bajar", "Comprar", "Mirar") for b in ("series", "anime", "cine", "estrenos") for _ in range(4)), "spam"),
        ("\n".join(["zapatos cuero madrid rebajas outlet oferta envio talla bolso"] * 200), "spam"),
        ("\n".join(f"#{w}" for w in ["cine", "bolso", "madrid", "reloj"] * 40), "spam"),
        ("\n".join(["Yo no sé por qué la noche se me va de las manos", "Y en la calle vuelve a llover sobre mojado"] * 6), "prosa"),
        (PILE[:130] + "\n" + OTHER.replace(".\n", "\n"), "prosa"),
        (LIST, "lista"),
    ],
)
def test_redundancy_between_lines(text, want):
    assert L.text_class(text) == want


DATA = "".join(random.Random(5).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=3000))


@pytest.mark.parametrize(("text", "want"), [(DATA, "basura"), (MOJIBAKE[:220], "basura"), (ES + "\n" + DATA + "\n" + EN, "basura"), (TABLE[:100] + "\n", "tabla"), (ES * 40 + "\n" + DATA, "prosa"), ("Un título sin punto alguno\n" * 3 + JUNK[:76], "prosa")])
def test_few_long_lines(spark, text, want):
    assert L.text_class(text) == want
    pages = spark.createDataFrame([(1, text)], "doc_id long, texto string")
    assert [r.clase for r in quality.text_statistics(pages).collect()] == [want]


def test_p6_lines_of_spam_pages(spark):
    """Only collection pages of p7 are left out of the lines, and none of the bodies."""
    hosts = sites(60)
    dress = lambda i, h: page(i, h).replace("Fin propio", PILE * 4 + "Fin propio") if i % 10 == 1 else page(i, h)
    html = spark.createDataFrame([(i, f"https://{h}/p/{i}", dress(i, h)) for i, h in enumerate(hosts)], "pagina_id long, url string, texto string")
    own = spark.createDataFrame([(i, i, h, dress(i, h)) for i, h in enumerate(hosts)], "doc_id long, db_id long, dominio string, texto string")
    docs = spark.createDataFrame([(0, None)], "id long, url string")
    assert sorted(r.doc_id for r in spam.p7_found(own, docs).collect()) == [1, 11, 21, 31, 41, 51]
    got = {(r.tabla, r.id) for r in boilerplate.p6_found(own, html, docs).collect()}
    assert got == {("resultado_html", i) for i in range(60)} | {("coleccion", i) for i in range(60) if i % 10 != 1}
    bodies = boilerplate.p6_bodies(own, html).collect()
    assert len(bodies) == 120 and not any("Todos los derechos" in r.cuerpo for r in bodies)


def test_p1_lines_have_a_confidence(spark):
    from tesela.llm import queries

    mixed = ES.strip() + "\n" + ES.strip() + "\n" + EN.strip()
    docs = [(i, (t * 3).strip(), code) for i, (code, t) in enumerate(list(ALL.items()) * 4)] + [(105, mixed, "es"), (106, None, None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "etiqueta_id long, doc_id long, idioma string, registrado_en timestamp")
    pages = spark.createDataFrame([(7, mixed)], "doc_id long, texto string")
    rows = queries.queries()["p1_lineas"] and queries.p1_lineas(pages, labels, documents, language.TrainingBound(iterations=25)).collect()
    assert sorted((r.tabla, r.doc_id, r.linea, r.idioma) for r in rows) == [(t, d, n, k) for t, d in (("coleccion", 7), ("documents", 105)) for n, k in ((1, "es"), (2, "es"), (3, "en"))]
    assert all(0.5 < r.confianza <= 1 for r in rows)
