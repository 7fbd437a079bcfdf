"""English stems by the published Porter2 rules, over a distinct vocabulary."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Words with a stem of their own, and words left alone after step 1a.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# Suffix rules of steps 2 and 3, longest first.
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion", "al", "er", "ic",
)


def _regions(word: str) -> tuple[int, int]:
    head = re.match(r"gener|commun|arsen", word)
    after = re.compile(r"[aeiouy][^aeiouy]")
    if head:
        r1 = head.end()
    else:
        hit = after.search(word)
        r1 = hit.end() if hit else len(word)
    hit = after.search(word, r1)
    return r1, hit.end() if hit else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.match(r"[aeiouy][^aeiouy]$", word))


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.lstrip("'")
    # A y that acts as a consonant is held as Y.
    word = re.sub(r"^y", "Y", word)
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)

    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in _KEPT:
        return word

    past = re.search(r"(eedly|eed)$", word)
    gone = re.search(r"(ingly|edly|ing|ed)$", word)
    if past:
        if past.start() >= r1:
            word = word[: past.start()] + "ee"
    elif gone and re.search(r"[aeiouy]", word[: gone.start()]):
        word = word[: gone.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    for suffix, new in _STEP2:
        if word.endswith(suffix):
            cut = len(word) - len(suffix)
            fits = cut >= r1
            if suffix == "ogi":
                fits = fits and word[cut - 1 : cut] == "l"
            elif suffix == "li":
                fits = fits and word[cut - 1 : cut] in tuple("cdeghkmnrt")
            word = word[:cut] + new if fits else word
            break
    for suffix, new in _STEP3:
        if word.endswith(suffix):
            cut = len(word) - len(suffix)
            if cut >= (r2 if suffix == "ative" else r1):
                word = word[:cut] + new
            break
    for suffix in _STEP4:
        if word.endswith(suffix):
            cut = len(word) - len(suffix)
            if cut >= r2 and (suffix != "ion" or word[cut - 1 : cut] in ("s", "t")):
                word = word[:cut]
            break
    if word.endswith("e"):
        cut = len(word) - 1
        if cut >= r2 or (cut >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stem_column(term: Column) -> Column:
    """Stem of a lowercase term; apply it to distinct terms."""

    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    return stems(term)
