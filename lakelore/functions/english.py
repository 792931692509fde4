"""The English analyzer: tokens stemmed by the published Porter2 rules. Run it when chunks are written, not within a search."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import tokens

# Fixed values of the published algorithm.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile(f"(?:[^aeiouy]{_VOWEL}[^aeiouywxY]|^{_VOWEL}[^aeiouy])$")


def _ending(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


def _regions(word: str) -> tuple[int, int]:
    start = re.match("gener|commun|arsen", word)
    m = None if start else _REGION.search(word)
    r1 = start.end() if start else m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = w.removesuffix("'").removesuffix("'s")

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w

    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + "ee"
    elif end and re.search(_VOWEL, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    end = _ending(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or re.search("[cdeghkmnrt]$", before)):
            w = before + _STEP2[end]

    end = _ending(w, _STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _STEP3[end]

    end = _ending(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]

    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT_END.search(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words):
    return words.map(lambda ws: [stem(w) for w in ws])


@F.pandas_udf(T.StringType())
def _stem(words):
    return words.map(stem)


def stems(words: DataFrame) -> DataFrame:
    """lexeme, stem of a table of different words (lexeme)."""
    return words.select("lexeme", _stem("lexeme").alias("stem"))


def english_tokens(text: Column) -> Column:
    """Stems of a text's tokens, in order."""
    return _stemmed(tokens(text))
