"""Search words: case and accents folded, and the endings of English words taken off by Porter's published rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _plain(char: str) -> str:
    return unicodedata.normalize("NFD", char)[0]


#: Accented Latin letters and what they fold to, by rule: the first sign of the decomposed form.
_ACCENTED = "".join(chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if _plain(chr(c)) != chr(c))
_FOLDED = "".join(map(_plain, _ACCENTED)).lower()


def search_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased and without accents; an underscore parts words."""
    flat = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _FOLDED), r"\p{Mn}", "")
    return F.regexp_extract_all(flat, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# fixed values: endings and what replaces them
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str]) -> str:
    """The longest ending that fits decides; it goes only where something is left before it."""
    for end in sorted(rules, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + rules[end] if _measure(stem) > 0 else word
    return word


def _plural_and_past(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        stem = word[: -len(end)]
        if word.endswith(end) and "v" in _kinds(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Words under 3 or over 64 bytes stay as they are."""
    if not 3 <= len(word.encode("utf-8", "surrogatepass")) <= 64:
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short(left)):
            word = left
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word[:-1]) > 1 else word


@F.pandas_udf(StringType())
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for w in words:
        yield w.map(stem, na_action="ignore")
