import math

import pytest
from pyspark.sql import functions as F

from tesela.functions import lexicon, normalize, policy, stem, weighting


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], names).select(column.alias("v")).first().v


def tokens(spark, text, p):
    df = spark.createDataFrame([(text,)], "texto string")
    return normalize.tokens(df, p).first().tokens


BARE = policy.Policy(stopwords=False, stemming=False)


def test_stopwords_and_thesaurus():
    assert len(lexicon.spanish_stopwords()) == 226
    assert len(lexicon.english_stopwords()) == 185
    assert len(lexicon.spanish_stopwords() & lexicon.english_stopwords()) == 4
    assert lexicon.thesaurus()["pelicula"] == lexicon.thesaurus()["película"] == "film"
    assert len(set(lexicon.thesaurus().values())) == 15


@pytest.mark.parametrize(("word", "root"), [("película", "pelicul"), ("películas", "pelicul"), ("realizador", "realiz"), ("rápidamente", "rapid"), ("corriendo", "corr"), ("a", "a"), ("", "")])
def test_spanish_stems(word, root):
    assert stem.spanish(word) == root


@pytest.mark.parametrize(("word", "root"), [("movie", "movi"), ("movies", "movi"), ("national", "nation"), ("running", "run"), ("generously", "generous"), ("dying", "die"), ("it", "it"), ("", "")])
def test_english_stems(word, root):
    assert stem.english(word) == root


def test_cleaning(spark):
    text = "“Hola” — ‘él’ ﬁn"
    assert one(spark, normalize.clean(F.col("t")), t=text) == "\"Hola\"  -  'él' fin"
    assert one(spark, normalize.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, normalize.strip_accents(F.col("t")), t="película, acción, lingüística ñ") == "pelicula, accion, linguistica n"


def test_tokens_keep_inner_signs(spark):
    assert {"spider-man", "sci-fi", "post-apocalíptica"} <= set(tokens(spark, "Spider-Man en una película sci-fi post-apocalíptica", BARE))
    assert {"it's", "o'brien's", "isn't"} <= set(tokens(spark, "It's Conan O'Brien's show, isn't it?", BARE))
    assert tokens(spark, "", BARE) == [] and tokens(spark, None, BARE) == []


def test_dates_and_numbers(spark):
    dated = policy.Policy(stopwords=False, stemming=False, normalizar_fechas=True)
    got = tokens(spark, "25/12/1977 o 1977-10-15, estreno en 1994 y 2024.", dated)
    assert got.count("<FECHA>") == 2 and "<ANIO_1994>" in got and "<ANIO_2024>" in got
    numbers = policy.Policy(stopwords=False, stemming=False, normalizar_numeros=True, modo_numeros="token")
    got = tokens(spark, "150 salas y 120.5 euros", numbers)
    assert got.count("<NUM>") == 2 and "150" not in got
    got = tokens(spark, "Sala 4 con 300 espectadores", policy.Policy(stopwords=False, stemming=False, normalizar_numeros=True, modo_numeros="descartar"))
    assert "sala" in got and "espectadores" in got and "300" not in got


def test_language(spark):
    df = spark.createDataFrame([("the history of the cinema and its directors",), ("la historia de los directores en el cine",), ("",)], "t string")
    words = normalize.lower_tokens(normalize.tokenize(F.col("t")))
    assert [r[0] for r in df.select(normalize.detect_language(words)).collect()] == ["en", "es", "es"]
    assert one(spark, normalize.detect_text_language(F.col("t")), t="the ñandú") == "es"
    assert one(spark, normalize.detect_text_language(F.col("t")), t="the cat is on the table") == "en"


def test_synonyms(spark):
    p = policy.Policy(stopwords=False, stemming=False, expandir_sinonimos=True)
    assert set(tokens(spark, "película filme movie motion_picture cinema", p)) == {"film"}
    assert set(tokens(spark, "director realizador cineasta filmmaker", p)) == {"realizador"}
    assert set(tokens(spark, "guion libreto screenplay script", p)) == {"screenplay"}


def test_variants(spark):
    got = one(spark, normalize.search_variants(F.col("t"), policy.Policy()), t="actors")
    assert got == ["actors", "actor"]
    assert one(spark, normalize.search_variants(F.col("t"), BARE), t="actors") == ["actors"]
    assert one(spark, normalize.search_variants(F.col("t"), policy.Policy()), t="<NUM>") == ["<NUM>"]


def number(spark, column):
    return spark.range(1).select(column).first()[0]


def test_weights(spark):
    tf = lambda n, s: number(spark, weighting.tf_weight(F.lit(n), s))
    assert tf(1, "logaritmico") == 1.0 and tf(10, "logaritmico") == pytest.approx(1 + math.log(10))
    assert tf(4, "sublineal") == pytest.approx(1 + math.log(4)) and tf(7, "binario") == 1 and tf(7, "natural") == 7
    assert tf(0, "natural") == tf(-3, "logaritmico") == 0
    idf = lambda *a: number(spark, weighting.idf_weight(F.lit(a[0]), F.lit(a[1]), *a[2:]))
    assert idf(500, 1) == pytest.approx(math.log(501)) and idf(500, 500) == pytest.approx(math.log(2))
    assert idf(500, 5, "estandar", False) == pytest.approx(math.log(100))
    assert idf(10, 12, "probabilistico") == 0 and idf(10, 5, "probabilistico") > 0 and idf(10, 5, "ninguno") == 1
    sim = lambda *a: number(spark, weighting.similarity(*[F.lit(float(x)) for x in a[:3]], *a[3:]))
    assert sim(10, 2, 5) == 1 and sim(10, 2, 10) == 0.5 and sim(5, 2, 0) == 2.5 and sim(5, 2, 3, False) == 5 and sim(5, 0, 3) == 0
    with pytest.raises(ValueError):
        weighting.tf_weight(F.lit(1), "raro")


def test_configuration():
    for name, mask in (("minimo", 3), ("estandar", 15), ("avanzado", 127)):
        s = policy.preset(name)
        assert s.normalizacion.flags() == mask
        assert policy.Policy.from_flags(mask).flags() == mask
        assert policy.settings_from(policy.parse_conf(policy.dump_conf(s))) == s
    assert policy.parse_scalar("es, en, fr") == ["es", "en", "fr"] and policy.parse_scalar("10, 20") == [10, 20]
    assert policy.parse_scalar("'a, b'") == "a, b" and policy.parse_scalar("sí") is True and policy.parse_scalar("1.5") == 1.5
    assert policy.parse_bool("verdadero") and not policy.parse_bool("off")
    conf = policy.parse_conf("x = 1 # no\n[A]\nk: 'v;#' ; yes\n")
    assert conf == {"global": {"x": 1}, "a": {"k": "v;#"}}
    for bad in ("nada", "= 3"):
        with pytest.raises(ValueError, match="line 1"):
            policy.parse_conf(bad)
    with pytest.raises(ValueError):
        policy.preset("otro")
    with pytest.raises(ValueError):
        policy.parse_bool("quizá")
    m = policy.Model("binario", "ninguno", False, False)
    assert policy.Model.from_reserved(m.reserved_bytes()) == m and policy.Model.from_reserved(b"") == policy.Model()


def test_every_ordered_part_is_tagged(spark, sf_dir):
    from tesela.plans import retrieval
    from tesela.session import table

    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    tagged = retrieval.queries()["n2_n4_lineas"](spark, sf_dir)
    assert tagged.count() == lines.count()
    keys = tagged.join(lines, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("p_partkey")).distinct()
    assert keys.join(parts, "p_partkey").count() == lines.select("l_partkey").distinct().count()


def test_searches_run_the_growing_batch(spark, sf_dir):
    from tesela.plans import retrieval
    from tesela.session import table

    want = {f"c{r.doc_id}" for r in table(spark, sf_dir, "coleccion").where("doc_id % 100 = 0").collect()} | {f"e{r.item_id}" for r in table(spark, sf_dir, "evaluacion").collect()}
    got = {r.consulta_id for r in retrieval.queries()["q6_ranking_lote"](spark, sf_dir).select("consulta_id").distinct().collect()}
    assert got <= want and {x for x in got if x[0] == "c"} == {x for x in want if x[0] == "c"}


# Published sample vocabularies of the two stemmers, word and stem.
EN_SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consolation consol consolations consol consolatory consolatori console consol consolidate consolid consolidated consolid consolingly consol
consols consol consonant conson consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspired conspir constable constabl constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knavish knavish
kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneels kneel knees knee knell knell knelt knelt knick knick knife knife knightly knight knits knit
knitted knit knitting knit knives knive knobs knob knocker knocker knockers knocker knocking knock knots knot"""
ES_SAMPLE = """cheque chequ checar chec checo chec checoslovaquia checoslovaqui chefs chefs chelo chel chemicalweek chemicalweek chequeo cheque cheques chequ chesca chesc
chetumaleños chetumaleñ chía chi chiapaneca chiapanec chiapas chiap chiba chib chic chic chica chic chicago chicag chicana chican chicano chican chicas chic
chicharrones chicharron chichimecas chichimec chicles chicl chico chic torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor
torearlo tor toreó tore torero torer toreros torer torio tori tormenta torment tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne
torneos torne tornillo tornill tornillos tornill torniquete torniquet torno torn toro tor toronto toront toros tor torpedearon torped torpeza torpez torrado torr
torralba torralb torre torr torrencial torrencial torrenciales torrencial torrente torrent torreon torreon torreón torreon torres torr torrescano torrescan"""


def test_published_stems():
    from tesela.functions.stem import STEMMERS

    for lang, sample in (("en", EN_SAMPLE), ("es", ES_SAMPLE)):
        words = sample.split()
        assert [(w, STEMMERS[lang](w)) for w in words[::2]] == list(zip(words[::2], words[1::2]))


def test_stems_against_sql():
    """The stemmers against the same steps written in SQL, over endings put to roots of many shapes."""
    import itertools

    import duckdb

    from tesela.functions.stem import STEMMERS
    from tesela.plans import stems

    roots = "a ae guion film cant comun gener arsen ley hoy inning oeuf x bañ seg acción uyendo hop luxuri".split()
    ends = sorted({w for k, v in vars(stems).items() if k.startswith("_") and isinstance(v, str) for w in v.replace(":", " ").split()})
    words = sorted({r + e for r, e in itertools.product(roots, ends)} | {r + a + b for r in roots[2:5] for a in ends[::5] for b in ends[::3]})
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS termino", [words])
    for lang, chain in (("es", stems.spanish), ("en", stems.english)):
        rows = con.execute(f"WITH {chain('z', 'SELECT termino FROM t')} SELECT * FROM z").fetchall()
        assert len(rows) == len(words) and [(w, s, STEMMERS[lang](w)) for w, s in rows if STEMMERS[lang](w) != s] == []
