"""English stemmer after the published Porter2 (Snowball) algorithm, for a vocabulary at a time."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
# --- fixed values: exceptional forms of the algorithm ---
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(c: str) -> bool:
    return c in VOWELS


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if not _vowel(word[i]) and _vowel(word[i - 1]):
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel(w[0]) and not _vowel(w[1])
    return len(w) > 2 and not _vowel(w[-1]) and w[-1] not in "wxY" and _vowel(w[-2]) and not _vowel(w[-3])


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or _vowel(w[i - 1])) else c for i, c in enumerate(w))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    # 0: possessives
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(_vowel(c) for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b: past and present participles
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(_vowel(c) for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w[-2]):
        w = w[:-1] + "i"
    # 2
    e = _longest(w, (*STEP_2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in tuple(LI_ENDING) else w
        else:
            w = w[: -len(e)] + STEP_2[e]
    # 3
    e = _longest(w, (*STEP_3, "ative"))
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + STEP_3[e]
    # 4
    e = _longest(w, (*STEP_4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stem_word(word: pd.Series) -> pd.Series:
    return word.map(lambda x: None if x is None else stem(x))
