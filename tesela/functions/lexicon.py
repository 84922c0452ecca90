"""Stop words and the audiovisual thesaurus.

FIXED VALUES: words and concepts that must equal the ones indexes are built with.
"""

from __future__ import annotations

from functools import lru_cache

# FIXED VALUES: Spanish stop words, with and without their accents.
_SPANISH = """
el la los las un una unos unas lo al del
a ante bajo cabe con contra de desde durante en entre hacia hasta mediante para por segun según sin so sobre tras versus via vía
y e ni o u pero mas sino aunque porque pues que si siquiera ya como cuando donde mientras
yo tu tú él ella ellos ellas nosotros nosotras vosotros vosotras usted ustedes me te se nos os le les mi mí mis tus su sus
nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras suyo suya suyos suyas mio mío mia mía mios míos mias mías
este esta estos estas esto ese esa esos esas eso aquel aquella aquellos aquellas aquello
es son era eran fue fueron ser sido siendo sea sean está estan están estaba estaban estuvo estuvieron estar estado estando esté esten estén
ha han hay habia había habian habían hubo haber habido habiendo haya hayan
tiene tienen tenia tenía tenian tenían tuvo tuvieron tener tenido teniendo tenga tengan
no sí muy más menos tan tanto tanta tantos tantas mucho mucha muchos muchas poco poca pocos pocas todo toda todos todas
otro otra otros otras mismo misma mismos mismas algo nada alguien nadie cual cuál cuales cuáles quien quién quienes quiénes
cuyo cuya cuyos cuyas tambien también tampoco solo sólo solamente ahora despues después antes bien asi así cada
"""

# FIXED VALUES: English stop words.
_ENGLISH = """
a an the
about above across after against along among around at before behind below beneath beside between beyond by down during
except for from in inside into near of off on onto out outside over past through throughout to toward towards under
underneath until up upon with within without
and but or nor yet so although because since unless while where whereas whether if that than
i me my myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this these those
am is are was were be been being have has had having do does did doing done
would should could ought may might must can shall will
re ve ll d m t s don didn doesn hadn hasn haven isn wasn weren won wouldn couldn shouldn
not no yes very too quite more most less least only own same then there here when why how all any both each few other some
such again further once now just also even
"""

# FIXED VALUES: word and concept.
_CONCEPTS = """
película:film pelicula:film películas:film peliculas:film movie:film movies:film cinema:film cinematógrafo:film cinematografo:film cinematografía:film
cinematografia:film cinematográfico:film cinematografico:film motion_picture:film motion-picture:film cine:film filme:film filmes:film feature:film
director:realizador directores:realizador directora:realizador directoras:realizador directing:realizador filmmaker:realizador filmmakers:realizador
cineasta:realizador cineastas:realizador
guión:screenplay guion:screenplay guiónes:screenplay guiones:screenplay script:screenplay scripts:screenplay screenwriting:screenplay
libreto:screenplay libretos:screenplay
guionista:screenwriter guionistas:screenwriter scriptwriter:screenwriter screenwriter:screenwriter screenwriters:screenwriter libretista:screenwriter
actor:interprete actores:interprete actriz:interprete actrices:interprete actuación:interprete actuacion:interprete intérprete:interprete
interprete:interprete intérpretes:interprete interpretes:interprete protagonista:interprete protagonistas:interprete star:interprete stars:interprete
starring:interprete
reparto:cast elenco:cast cast:cast casting:cast
productor:producer productores:producer productora:producer productoras:producer producción:producer produccion:producer producer:producer
producers:producer producing:producer
largometraje:largometraje largometrajes:largometraje
cortometraje:cortometraje cortometrajes:cortometraje short:cortometraje shorts:cortometraje
documental:documental documentales:documental documentary:documental documentaries:documental
animación:animacion animacion:animacion animation:animacion animated:animacion
thriller:suspenso suspense:suspenso suspenso:suspenso
soundtrack:banda_sonora soundtracks:banda_sonora ost:banda_sonora score:banda_sonora música:banda_sonora musica:banda_sonora compositor:banda_sonora
composer:banda_sonora
fotografía:fotografia fotografia:fotografia cinematography:fotografia cameraman:fotografia
montaje:edicion edición:edicion edicion:edicion editing:edicion editor:edicion
"""

#: Concepts always stemmed as Spanish, and as English.
SPANISH_CONCEPTS = ("realizador", "interpret", "interprete", "pelicula", "largometraje", "cortometraje", "documental", "animacion", "suspenso", "banda_sonora", "fotografia", "edicion")
ENGLISH_CONCEPTS = ("film", "screenplay", "screenwriter", "cast", "producer")


@lru_cache(maxsize=1)
def spanish_stopwords() -> frozenset[str]:
    return frozenset(_SPANISH.split())


@lru_cache(maxsize=1)
def english_stopwords() -> frozenset[str]:
    return frozenset(_ENGLISH.split())


_ALIASES = {"es": "es espanol español spanish", "en": "en ingles inglés english"}


def stopwords(languages: tuple[str, ...] = ("es", "en")) -> frozenset[str]:
    """Union of the stop words of the named languages; unknown names add nothing."""
    out: frozenset[str] = frozenset()
    for name in languages:
        name = name.lower().strip()
        if name in _ALIASES["es"].split():
            out |= spanish_stopwords()
        elif name in _ALIASES["en"].split():
            out |= english_stopwords()
    return out


@lru_cache(maxsize=1)
def thesaurus() -> dict[str, str]:
    """Word to concept."""
    return dict(entry.split(":") for entry in _CONCEPTS.split())
