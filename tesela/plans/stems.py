"""The published Snowball steps for Spanish and English as DuckDB SQL, to hold the stemmers of the package against.

Every step is a column of a chain of tables over a vocabulary; regions are character
counts, and the longest ending is the leftmost match of an alternation at the end.
"""

from __future__ import annotations

from ..functions import lexicon

_V = "aeiouáéíóúü"
# FIXED VALUES: endings of the Spanish steps.
_PRONOUN = "me se sela selo selas selos la le lo las les los nos"
_ACUTE = "iéndo ándo ár ér ír"
_BASE = "ando iendo ar er ir yendo"
_DELETED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_ATION = "adora ador ación adoras adores aciones ante antes ancia ancias acion"
_OTHERS = "logía logías ución uciones ucion encia encias amente mente idad idades iva ivo ivas ivos"
_Y_VERB = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_GU_VERB = "en es éis emos"
_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron "
    "ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos "
    "imos áramos iéramos iésemos ásemos"
)
# FIXED VALUES: endings and exceptions of the English steps.
_STEP2 = (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous "
    "iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less"
)
_STEP3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
_SPECIAL = (
    "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas "
    "cosmos:cosmos bias:bias andes:andes"
)


def _any(words: str) -> str:
    return "(" + "|".join(words.split()) + ")$"


def _in(column: str, words: str) -> str:
    return f"{column} IN (" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _map(column: str, pairs: str) -> str:
    return "CASE " + column + " " + " ".join("WHEN '{}' THEN '{}'".format(*p.split(":")) for p in pairs.split()) + " END"


def _after(text: str, pattern: str) -> str:
    """Characters up to the end of the first match; all where there is none."""
    return f"coalesce(nullif(length(regexp_extract({text}, '{pattern}')), 0), length({text}))"


def _cut(text: str, n: str) -> str:
    return f"substr({text}, 1, length({text}) - {n})"


def _drop(base: str, region: str, words: str) -> str:
    """The base without one of the endings, where that lies in the region."""
    return f"CASE WHEN regexp_matches(substr({base}, {region} + 1), '{_any(words)}') THEN regexp_replace({base}, '{_any(words)}', '') ELSE {base} END"


def _chain(name: str, source: str, steps: list[dict[str, str]]) -> str:
    """Tables name0, name1, …: each adds columns to the one before (a column named again takes the new value)."""
    out = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT termino, termino AS w FROM ({source}) WHERE termino IS NOT NULL)"]
    known = ["termino", "w"]
    for i, step in enumerate(steps, 1):
        kept = [c for c in known if c not in step]
        out.append(f"{name}{i} AS (SELECT {', '.join(kept)}, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM {name}{i - 1})")
        known = [*kept, *step]
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT termino, w AS raiz FROM {name}{len(steps)})"])


def spanish(name: str, source: str) -> str:
    """Common tables up to ``name(termino, raiz)`` of the terms of ``source``."""
    first = f"^.*?[{_V}][^{_V}]"
    base, verb, ending = _cut("w", "length(p)"), "substr({}, rv + 1)", _cut("w", "length(e)")
    return _chain(name, source, [
        {"rv": f"CASE WHEN length(w) < 3 THEN length(w) WHEN NOT regexp_matches(w, '^.[{_V}]') THEN {_after('w', f'^..[^{_V}]*[{_V}]')} WHEN regexp_matches(w, '^[{_V}]') THEN {_after('w', f'^..[{_V}]*[^{_V}]')} ELSE 3 END", "r1": _after("w", first)},
        {"r2": f"r1 + {_after('substr(w, r1 + 1)', first)}", "p": f"regexp_extract(w, '{_any(_PRONOUN)}')"},
        {"b": base},
        {"v": f"regexp_extract({verb.format('b')}, '{_any(_ACUTE + ' ' + _BASE)}')"},
        {"w": f"CASE WHEN p = '' OR v = '' THEN w WHEN {_in('v', _ACUTE)} THEN {_cut('b', 'length(v)')} || translate(v, 'áéí', 'aei') WHEN v <> 'yendo' OR ends_with(b, 'uyendo') THEN b ELSE w END"},
        {"e": f"regexp_extract(w, '{_any(' '.join((_DELETED, _ATION, _OTHERS)))}')"},
        {"b": ending},
        {"s": f"CASE WHEN e = '' THEN NULL WHEN e = 'amente' THEN CASE WHEN length(b) < r1 THEN NULL WHEN regexp_matches(substr(b, r2 + 1), 'iv$') THEN {_drop('b', 'r2', 'ativ iv')} ELSE {_drop('b', 'r2', 'os ic ad')} END "
              f"WHEN length(b) < r2 THEN NULL WHEN {_in('e', 'logía logías')} THEN b || 'log' WHEN {_in('e', 'ución uciones ucion')} THEN b || 'u' WHEN {_in('e', 'encia encias')} THEN b || 'ente' "
              f"WHEN {_in('e', _ATION)} THEN {_drop('b', 'r2', 'ic')} WHEN e = 'mente' THEN {_drop('b', 'r2', 'ante able ible')} WHEN {_in('e', 'idad idades')} THEN {_drop('b', 'r2', 'abil ic iv')} "
              f"WHEN {_in('e', 'iva ivo ivas ivos')} THEN {_drop('b', 'r2', 'at')} ELSE b END", "y": f"regexp_extract({verb.format('w')}, '{_any(_Y_VERB)}')", "v": f"regexp_extract({verb.format('w')}, '{_any(_GU_VERB + ' ' + _VERB)}')"},
        {"w": f"CASE WHEN s IS NOT NULL THEN s WHEN y <> '' AND ends_with({_cut('w', 'length(y)')}, 'u') THEN {_cut('w', 'length(y)')} WHEN v = '' THEN w WHEN {_in('v', _GU_VERB)} AND ends_with({_cut('w', 'length(v)')}, 'gu') THEN {_cut('w', '(length(v) + 1)')} ELSE {_cut('w', 'length(v)')} END"},
        {"e": f"regexp_extract({verb.format('w')}, '{_any('os a o á í ó e é')}')"},
        {"b": ending},
        {"w": f"translate(CASE WHEN e = '' THEN w WHEN {_in('e', 'e é')} AND ends_with(b, 'gu') AND length(b) - 1 >= rv THEN {_cut('b', '1')} ELSE b END, 'áéíóú', 'aeiou')"},
    ])


def english(name: str, source: str) -> str:
    """Common tables up to ``name(termino, raiz)`` of the terms of ``source``."""
    v = "aeiouy"
    first = f"^.*?[{v}][^{v}]"
    short = lambda t: f"regexp_matches({t}, '(?:^[{v}][^{v}]|[^{v}][{v}][^{v}wxY])$')"
    end = lambda words: {"e": f"regexp_extract(w, '{_any(words)}')"}
    base = {"b": _cut("w", "length(e)")}
    names = lambda pairs: " ".join(p.split(":")[0] for p in pairs.split())
    return _chain(name, source, [
        {"w": f"regexp_replace(regexp_replace(w, '^''', ''), '(^|[{v}])y', '\\1Y', 'g')"},
        {"r1": f"CASE WHEN starts_with(w, 'gener') OR starts_with(w, 'arsen') THEN 5 WHEN starts_with(w, 'commun') THEN 6 ELSE {_after('w', first)} END"},
        {"r2": f"r1 + {_after('substr(w, r1 + 1)', first)}", "w": "regexp_replace(w, '(''s''|''s|'')$', '')"},
        {"w": f"CASE WHEN ends_with(w, 'sses') THEN {_cut('w', '2')} WHEN regexp_matches(w, 'ie[ds]$') THEN {_cut('w', 'CASE WHEN length(w) > 4 THEN 2 ELSE 1 END')} WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '[us]s$') AND regexp_matches({_cut('w', '1')}, '[{v}].') THEN {_cut('w', '1')} ELSE w END"},
        {"kept": "CASE WHEN " + _in("w", "inning outing canning herring earring proceed exceed succeed") + " THEN w END", **end("eed eedly ed edly ing ingly")},
        base,
        {"w": f"CASE WHEN {_in('e', 'eed eedly')} THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN e <> '' AND regexp_matches(b, '[{v}]') THEN CASE WHEN regexp_matches(b, '(?:at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {_cut('b', '1')} WHEN length(b) <= r1 AND {short('b')} THEN b || 'e' ELSE b END ELSE w END"},
        {"w": f"CASE WHEN length(w) > 2 AND regexp_matches(w, '[^{v}][yY]$') THEN {_cut('w', '1')} || 'i' ELSE w END"},
        end(names(_STEP2) + " ogi li"),
        base,
        {"w": f"CASE WHEN e = '' OR length(b) < r1 THEN w WHEN e = 'ogi' THEN CASE WHEN ends_with(b, 'l') THEN {_cut('w', '1')} ELSE w END WHEN e = 'li' THEN CASE WHEN regexp_matches(b, '[cdeghkmnrt]$') THEN b ELSE w END ELSE b || {_map('e', _STEP2)} END"},
        end(names(_STEP3)),
        base,
        {"w": f"CASE WHEN e = '' OR length(b) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN w ELSE b || {_map('e', _STEP3)} END"},
        end(_STEP4),
        base,
        {"w": "CASE WHEN e <> '' AND length(b) >= r2 AND (e <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE w END"},
        {"b": _cut("w", "1")},
        {"w": f"CASE WHEN ends_with(w, 'e') AND (length(b) >= r2 OR length(b) >= r1 AND NOT {short('b')}) THEN b WHEN ends_with(w, 'll') AND length(b) >= r2 THEN b ELSE w END"},
        {"w": f"CASE WHEN length(termino) <= 2 THEN termino ELSE coalesce({_map('termino', _SPECIAL)}, lower(coalesce(kept, w))) END"},
    ])


def both(name: str, source: str) -> str:
    """Common tables up to ``name(termino, idioma_doc, raiz)``: the stem of every term of ``source`` in either language, as the index takes it."""
    fixed = " ".join(f"WHEN '{c}' THEN '{lang}'" for lang, concepts in (("es", lexicon.SPANISH_CONCEPTS), ("en", lexicon.ENGLISH_CONCEPTS)) for c in concepts)
    return (
        f"{spanish(f'{name}_es', source)}, {english(f'{name}_en', source)}, {name} AS MATERIALIZED (SELECT termino, idioma_doc, CASE WHEN regexp_matches(termino, '^<.*>$') THEN termino "
        f"WHEN CASE termino {fixed} ELSE idioma_doc END = 'en' THEN n.raiz ELSE s.raiz END AS raiz FROM {name}_es s JOIN {name}_en n USING (termino), (VALUES ('es'), ('en')) l(idioma_doc))"
    )
