"""Small closed word lists per language, used as CRF lexicon features and as compressor priors.

FIXED VALUES: the lists below are plain vocabulary of the six languages.
``FUNCTION_WORDS`` holds frequent grammatical words; ``SEARCH_WORDS`` holds the
words search-engine spam of the audiovisual domain is made of (verbs of
obtaining, kinds of title, conditions of sale).
"""

from __future__ import annotations

LANGUAGES = ("es", "en", "pt", "fr", "it", "de")

FUNCTION_WORDS = {
    "es": "el la los las de del que y en un una por con para no se lo es su al más como pero sin sobre ni cuando hay",
    "en": "the of and to in is that it for on was with as by at from this be are not or an which when but their his her has",
    "pt": "o a os as de do da que e em um uma por com para não se é no na ao mais como mas sem quando nem há seu sua dos das",
    "fr": "le la les de des du que et en un une pour avec dans ne pas se est sur au plus par qui ce il elle vous nous quand ni",
    "it": "il lo la gli le di del della che e in un una per con non si è su al più come ma quando né sono alla dei nel ci ha",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er wer weder noch wenn",
}

SEARCH_WORDS = {
    "es": "ver descargar bajar mirar comprar alquilar películas series estrenos anime temporadas tráilers capítulos cine "
    "gratis online baratas completas latino subtituladas en español en hd sin cortes sin registro",
    "en": "watch download buy rent get stream movies series new releases anime full seasons box sets trailers episodes "
    "free online cheap fast today uncut best price full hd with subtitles no sign up",
    "pt": "ver baixar assistir comprar alugar filmes séries lançamentos animes temporadas trailers episódios "
    "grátis online barato completo dublado legendado em hd em português",
    "fr": "voir regarder télécharger acheter louer films séries nouveautés animés saisons épisodes "
    "gratuit complet pas cher en ligne en hd en français",
    "it": "vedere guardare scaricare comprare noleggiare film serie novità anime stagioni episodi "
    "gratis completo economico in streaming in italiano in hd",
    "de": "schauen ansehen herunterladen kaufen leihen filme serien neuheiten anime staffeln folgen "
    "kostenlos billig komplett online auf deutsch in hd",
}


def function_sets() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}


def search_sets() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in SEARCH_WORDS.items()}
