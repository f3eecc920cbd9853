"""English analysis of single words: a suffix-stripping stemmer (the published Snowball English algorithm) and stop words.

Both are applied to the distinct words of an index or a query, never to running text."""

from __future__ import annotations

import re

# The English stop words of full-text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a
    an the and but if or because as until while of at by for with about against between into through during before after above below to from
    up down in out on off over under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now""".split()
)

# Words with a stem of their own.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Endings of the second, third and fourth step, and what they become; None: they go.
_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_V = "[aeiouy]"
_REGION = re.compile(f".*?{_V}[^aeiouy]")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.match(r"^[aeiouy][^aeiouy]$", w))


def _without_plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        return w[:-1]
    return w


def _without_past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            rest = w[: -len(end)]
            if not re.search(_V, rest):
                return w
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if _DOUBLE.search(rest):
                return rest[:-1]
            return rest + "e" if len(rest) <= r1 and _short_end(rest) else rest
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word. Words of other alphabets, and of one or two letters, are their own."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    lead = re.match("gener|commun|arsen", w)
    found = lead or _REGION.match(w)
    r1 = found.end() if found else len(w)
    found = _REGION.match(w, r1)
    r2 = found.end() if found else len(w)

    w = _without_plural(w)
    if w in _KEPT_AFTER_PLURAL:
        return w
    w = _without_past(w, r1)
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    for end in sorted(_SECOND, key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + _SECOND[end]
            break
    for end in sorted(_THIRD, key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + _THIRD[end]
            break
    for end in sorted(_FOURTH, key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
