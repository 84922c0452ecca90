"""Spanish and English stemmers after the published Snowball descriptions.

Spark has none; the Arrow UDF runs over a distinct vocabulary only (see
``normalize.stem_vocabulary``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ES_VOWELS = "aeiouáéíóúü"
_EN_VOWELS = "aeiouy"
_UNACCENT = str.maketrans("áéíóú", "aeiou")


def _regions(word: str, vowels: str, start: int = 0) -> tuple[int, int]:
    """Starts of R1 and R2: after the first non-vowel that follows a vowel, twice."""

    def after(at: int) -> int:
        for i in range(at + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    r1 = start or after(0)
    return r1, after(r1)


class _Endings(frozenset):
    """A set of endings that knows its longest one."""

    def __new__(cls, words):
        own = super().__new__(cls, words)
        own.reach = max(map(len, own), default=0)
        return own


def _longest(word: str, endings: _Endings, least: int = 0) -> str:
    """Longest of the endings the word has at or after position ``least``."""
    for n in range(min(endings.reach, len(word) - least), 0, -1):
        if word[-n:] in endings:
            return word[-n:]
    return ""


_ES_PRONOUNS = _Endings("me se sela selo selas selos la le lo las les los nos".split())
_ES_GERUND = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_ES_PLAIN = "ando iendo ar er ir".split()
_ES_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_ATION = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
_ES_REPLACE = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "ucion": "u", "encia": "ente", "encias": "ente"}
_ES_AFTER = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"), "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}
_ES_STEP1 = _Endings([*_ES_DELETE, *_ES_ATION, *_ES_REPLACE, "amente", *_ES_AFTER])
_ES_BEFORE = {end: _Endings(("ic",) if end in _ES_ATION else _ES_AFTER.get(end, ())) for end in _ES_STEP1}
_ES_VERB_BASE = _Endings([*_ES_GERUND, *_ES_PLAIN, "yendo"])
_ES_REST = _Endings(("os", "a", "o", "á", "í", "ó", "e", "é"))
_ES_Y = _Endings("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
_ES_GU = "en es éis emos".split()
_ES_VERB = [f"{v}{e}" for v in ("ar", "er", "ir") for e in "ían ías án ás íais ía éis íamos emos á é".split()] + (
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas "
    "idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ES_GU_VERB = _Endings(_ES_GU + _ES_VERB)


def _spanish_rv(w: str) -> int:
    """Start of RV."""
    if len(w) < 3:
        return len(w)
    v = _ES_VOWELS
    if w[1] not in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    if w[0] in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    return 3


def spanish(word: str) -> str:
    w = word
    rv = _spanish_rv(w)
    r1, r2 = _regions(w, _ES_VOWELS)
    pronoun = _longest(w, _ES_PRONOUNS, rv)
    if pronoun:
        base = w[: -len(pronoun)]
        verb = _longest(base, _ES_VERB_BASE, rv)
        if verb in _ES_GERUND:
            w = base[: -len(verb)] + _ES_GERUND[verb]
        elif verb in _ES_PLAIN or verb == "yendo" and base.endswith("uyendo"):
            w = base
    changed = _spanish_standard(w, r1, r2)
    if changed is None:
        changed = _spanish_y(w, rv)
    if changed is None:
        changed = _spanish_verb(w, rv)
    w = changed if changed is not None else w
    rest = _longest(w, _ES_REST, rv)
    if rest:
        w = w[: -len(rest)]
        if rest in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_UNACCENT)


def _spanish_standard(w: str, r1: int, r2: int) -> str | None:
    end = _longest(w, _ES_STEP1)
    if not end:
        return None
    at = len(w) - len(end)
    if end == "amente":
        if at < r1:
            return None
        w = w[:at]
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = w[:-2]
            return w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
        return w[:-2] if w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2 else w
    if at < r2:
        return None
    if end in _ES_REPLACE:
        return w[:at] + _ES_REPLACE[end]
    w = w[:at]
    before = _longest(w, _ES_BEFORE[end], r2)
    return w[: -len(before)] if before else w


def _spanish_y(w: str, rv: int) -> str | None:
    end = _longest(w, _ES_Y, rv)
    return w[: -len(end)] if end and w[: -len(end)].endswith("u") else None


def _spanish_verb(w: str, rv: int) -> str | None:
    end = _longest(w, _ES_GU_VERB, rv)
    if not end:
        return None
    w = w[: -len(end)]
    return w[:-1] if end in _ES_GU and w.endswith("gu") else w


# FIXED VALUES: exceptional forms of the English algorithm.
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEEP = "inning outing canning herring earring proceed exceed succeed".split()
_EN_DOUBLE = "bb dd ff gg mm nn pp rr tt".split()
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = _Endings("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
_EN_PAST = _Endings(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_EN_ENDS2, _EN_ENDS3 = _Endings([*_EN_STEP2, "ogi", "li"]), _Endings(_EN_STEP3)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _EN_VOWELS and w[1] not in _EN_VOWELS
    return len(w) > 2 and w[-1] not in _EN_VOWELS + "wxY" and w[-2] in _EN_VOWELS and w[-3] not in _EN_VOWELS


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    prefix = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), 0)
    r1, r2 = _regions(w, _EN_VOWELS, prefix)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _EN_KEEP:
        return w.lower()
    # past and gerund
    end = _longest(w, _EN_PAST)
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in _EN_DOUBLE:
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, _EN_ENDS2)
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        if end == "ogi":
            w = w[:-1] if base.endswith("l") else w
        elif end == "li":
            w = base if base and base[-1] in "cdeghkmnrt" else w
        else:
            w = base + _EN_STEP2[end]
    end = _longest(w, _EN_ENDS3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _EN_STEP3[end]
    end = _longest(w, _EN_STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"es": spanish, "en": english}
