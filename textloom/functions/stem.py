"""English (Porter 2), German and Spanish stemmers, after their published descriptions (the Snowball project's)."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    lead = re.match("gener|commun|arsen", w)
    found = lead or re.search("[aeiouy][^aeiouy]", w)
    r1 = found.end() if found else len(w)
    found = re.compile("[aeiouy][^aeiouy]").search(w, r1)
    return r1, found.end() if found else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=1 << 16)
def english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    w = word.replace("’", "'").removeprefix("'")
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)

    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _DONE:
        return w

    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("ly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"

    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _part(w: str, vowels: str, start: int = 0) -> int:
    """Where the region behind the first non-vowel that follows a vowel begins."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
    return found.end() if found else len(w)


def _longest(w: str, ends: tuple[str, ...]) -> str:
    return max((e for e in ends if w.endswith(e)), key=len, default="")


_GERMAN_V = "aeiouyäöü"


@lru_cache(maxsize=1 << 16)
def german(word: str) -> str:
    """The stem of a lower-case German word."""
    w = re.sub(f"(?<=[{_GERMAN_V}])[uy](?=[{_GERMAN_V}])", lambda m: m[0].upper(), word.replace("ß", "ss"))
    r1 = _part(w, _GERMAN_V)
    r2 = _part(w, _GERMAN_V, r1)
    r1 = max(r1, min(3, len(w)))
    inside = lambda end, region: end and len(w) - len(end) >= region

    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if inside(end, r1) and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    if inside(end, r1) and (end != "st" or (len(w) >= 6 and w[-3] in "bdfghklmnt")):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    before = w[: len(w) - len(end)]
    if inside(end, r2):
        if end in ("ig", "ik", "isch"):
            w = w if before.endswith("e") else before
        else:
            w = before
            more = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}[end]
            also = _longest(w, more)
            if inside(also, r1 if end in ("lich", "heit") else r2) and not (end in ("end", "ung") and w[:-2].endswith("e")):
                w = w[: -len(also)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


_SPANISH_V = "aeiouáéíóúü"
#: Fixed values of the algorithm.
_PRONOUNS = tuple("me se sela selo selas selos la le lo las les los nos".split())
_PLAIN = tuple("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split())
_WITH_IC = tuple("adora ador ación adoras adores aciones ante antes ancia ancias".split())
_CHANGED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_Y_VERBS = tuple("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
_VERBS = tuple(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
)
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _spanish_rv(w: str) -> int:
    v = _SPANISH_V
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        found = re.compile(f"[{v}]").search(w, 2)
        return found.end() if found else len(w)
    if w[0] in v:
        found = re.compile(f"[^{v}]").search(w, 2)
        return found.end() if found else len(w)
    return 3


@lru_cache(maxsize=1 << 16)
def spanish(word: str) -> str:
    """The stem of a lower-case Spanish word."""
    w, rv, r1 = word, _spanish_rv(word), _part(word, _SPANISH_V)
    r2 = _part(word, _SPANISH_V, r1)

    end = _longest(w, _PRONOUNS)
    if end and len(w) - len(end) >= rv:
        stem_, verb = w[: -len(end)], _longest(w[: -len(end)], ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb and len(stem_) - len(verb) >= rv and (verb != "yendo" or stem_[:-5].endswith("u")):
            w = stem_[: -len(verb)] + verb.translate(_ACUTE)
    whole = w
    inside = lambda e, region: bool(e) and len(w) - len(e) >= region

    end = _longest(w, (*_PLAIN, *_WITH_IC, *_CHANGED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    if end == "amente" and inside(end, r1):
        w = w[:-6]
        also = _longest(w, ("iv", "os", "ic", "ad"))
        if inside(also, r2):
            w = w[:-2]
            if also == "iv" and w.endswith("at") and inside("at", r2):
                w = w[:-2]
    elif end != "amente" and inside(end, r2):
        w = w[: -len(end)]
        if end in _CHANGED:
            w += _CHANGED[end]
        else:
            more = ("ic",) if end in _WITH_IC else ("ante", "able", "ible") if end == "mente" else ("abil", "ic", "iv") if end.startswith("idad") else ("at",) if end.startswith("iv") else ()
            also = _longest(w, more)
            if inside(also, r2):
                w = w[: -len(also)]
    if w == whole:
        end = _longest(w[rv:], _Y_VERBS)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w[rv:], (*_VERBS, "en", "es", "éis", "emos"))
            if end:
                w = w[: -len(end)]
                if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    end = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


ALGORITHMS = {"english": english, "en": english, "porter2": english, "german": german, "de": german, "spanish": spanish, "es": spanish}
