"""Search terms: folding, tokens and stems."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiou"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, from their decompositions."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and letter.islower() and base.isascii():
            pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *_accents())


def tokens(text: Column) -> Column:
    """Folded terms: letters, digits and ``_ - .``."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}_.\-]+)"), F.lit(1))


def _consonant(word: str, i: int) -> bool:
    if word[i] == "y":
        return i == 0 or not _consonant(word, i - 1)
    return word[i] not in VOWELS


def _measure(stem: str) -> int:
    """Number of vowel-consonant changes."""
    shape = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(shape, shape[1:]) if b and not a)


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


# Suffix rules of the published algorithm (Porter 1980), longest match first within a step.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _longest(word: str, suffixes):
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


@lru_cache(maxsize=1 << 17)
def stem_word(word: str) -> str:
    """Porter stem of a folded word; words of other scripts and short words stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        table = dict(rules)
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stem_batch(words: pd.Series) -> pd.Series:
    return words.map({w: None if w is None else stem_word(w) for w in words.unique()})


def stem(word: Column | str) -> Column:
    """Stem column; every distinct word of an Arrow batch is worked on once."""
    return F.pandas_udf(_stem_batch, T.StringType())(word)


def _stem_lists(lists: pa.Array) -> pa.Array:
    words = lists.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem_word(w) for w in words.dictionary.to_pylist()], pa.string())
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(words.indices), mask=lists.is_null())


def stems(words: Column | str) -> Column:
    """The stems of an array of words, in its order; every distinct word of an Arrow batch is worked on once."""
    return F.arrow_udf(_stem_lists, T.ArrayType(T.StringType()))(words)
