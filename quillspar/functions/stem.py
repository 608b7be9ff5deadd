"""The Snowball project's English stemmer (Porter2), from the published description of the algorithm."""

from __future__ import annotations

import functools
import re

VOWELS = "aeiouy"
#: Fixed values of the published algorithm.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _regions(w: str) -> tuple[int, int]:
    """Where the two regions start: after the first consonant that follows a vowel, and again from there."""
    m = re.match("gener|commun|arsen", w) or re.search("[aeiouy][^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.compile("[aeiouy][^aeiouy]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.match("[aeiouy][^aeiouy]$", w))


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)

    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in STOP_AFTER_1A:
        return w

    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[0].startswith("eed"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    for end, new in STEP2.items():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and not (end == "ogi" and w[at - 1 : at] != "l") and not (end == "li" and w[at - 1 : at] not in tuple(LI)):
                w = w[:at] + new
            break
    for end, new in STEP3.items():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and not (end == "ion" and w[at - 1 : at] not in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
