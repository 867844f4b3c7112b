"""Porter's stemmer (Porter 1980), as a function and as an Arrow UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published suffix tables.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _consonants(word: str) -> str:
    """c or v for each letter; y counts by the letter before it."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _consonants(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _consonants(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _consonants(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """Stem of a lower-case word; words of other than a-z, or below three letters, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    again = False
    if word.endswith("eed"):
        if _m(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _m(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if word.endswith(suffix):
                if _m(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + new
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _m(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e") and (_m(word[:-1]) > 1 or (_m(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word


def stem_column(term: Column) -> Column:
    @F.pandas_udf("string")
    def run(words):
        return words.map(stem, na_action="ignore")

    return run(term)
