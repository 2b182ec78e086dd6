"""Term normalisation: folding to [0-9a-z] and a suffix stripper of the Porter family, as Arrow UDFs over distinct words.

The stripper's measure m counts vowel-to-consonant turns. It is taken once, from the word that step 1a leaves, and steps
2 to 5 depend on that value. A leading y is a vowel; step 1b's shortening acts on doubled vowels only; removing -ement
needs no measure. These are the rules of the algorithm that this package reproduces, not of the published one.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = re.compile(r"[^0-9a-z]")

# Fixed values: (suffix, replacement), by suffix length. A group applies where the word is longer than the suffix and the
# measure of what stands before it is not zero.
STEP_2 = {
    7: {"ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous"},
    6: {"biliti": "ble", "tional": "tion"},
    5: {"entli": "ent", "alism": "al", "ation": "ate", "aliti": "al", "iviti": "ive", "ousli": "ous"},
    4: {"enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "ator": "ate"},
}
STEP_3 = {5: {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic"}, 4: {"ical": "ic", "ness": ""}}
STEP_4 = {
    4: {"ance": "", "ence": "", "able": "", "ible": "", "ment": "", "tion": "t", "sion": "s"},
    3: dict.fromkeys(("ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize"), ""),
    2: dict.fromkeys(("al", "er", "ic", "ou"), ""),
}


def standardize(word: str) -> str:
    """Compatibility decomposition, case folding, then only 0-9 and a-z."""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", word).casefold())
    return _DROP.sub("", folded)


def vowels(word: str) -> str:
    """v or c for each letter; y is a vowel unless one stands before it."""
    out: list[str] = []
    for c in word:
        out.append("v" if c in "aeiou" or (c == "y" and out[-1:] != ["v"]) else "c")
    return "".join(out)


def measure(word: str) -> int:
    """Consonant runs after the first vowel. The empty word has measure 1; one whose first vowel ends it, or which has no
    vowel, has 0."""
    if not word:
        return 1
    kinds = vowels(word)
    first = kinds.find("v")
    return 0 if first < 0 else len(re.findall("c+", kinds[first:]))


def _strip(word: str, size: int, groups: dict[int, dict[str, str]], least: int) -> str:
    """The first suffix found, where the word had more than its length (size: the length that counts for that) and at least
    that measure before it."""
    for n, rules in groups.items():
        before = word[:-n] if len(word) >= n else None
        if size > n and before is not None and measure(before) >= least and word[-n:] in rules:
            return before + rules[word[-n:]]
    return word


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return len(word) >= 3 and vowels(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _after_removal(word: str, m: int) -> str:
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) >= 2 and word[-1] == word[-2] and vowels(word)[-2:] == "vv":
        return word[:-1]
    return word + "e" if m == 1 and _short_end(word) else word


def stem(word: str) -> str:
    w = standardize(word)
    if len(w) >= 3 and w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    m = measure(w)
    if m > 0 and w.endswith("eed"):
        w = w[:-1]
    elif "v" in vowels(w):
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                w = _after_removal(w[: -len(suffix)], m)
                break
    if w.endswith("y") and "v" in vowels(w[:-1]):
        w = w[:-1] + "i"
    if m > 0:
        if len(w) >= 3:
            n, after = len(w), _strip(w, len(w), STEP_2, 1)
            if after == w and w.endswith("eli") and measure(w[:-3]):
                after = w[:-2]
            elif w.endswith("ousli") and after != w:  # this one rule lets the later ones see its result
                after = _strip(after, n, {4: STEP_2[4]}, 1)
            w = after
        if len(w) >= 3:
            after = _strip(w, len(w), STEP_3, 1)
            w = w[:-3] if after == w and w.endswith("ful") and measure(w[:-3]) else after
    if m > 1 and w:
        size = len(w)
        if size > 5 and w.endswith("ement"):
            w = w[:-5]
        w = _strip(w, size, STEP_4, 2)
    if len(w) >= 3 and w.endswith("e"):
        w = w[:-1]
    return w[:-1] if m > 1 and len(w) >= 3 and w.endswith("ll") else w


def _mapped(f):
    def run(words: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in words.to_pylist()], pa.string())

    return run


_standardize, _stem = _mapped(standardize), _mapped(stem)


def normalise_words(df: DataFrame, word_col: str = "word") -> DataFrame:
    """word, standard and stem of each distinct word of df. Each word is folded once, on the executors; null stays null."""
    one = df.select(F.col(word_col).alias("word")).distinct()
    return one.select("word", F.arrow_udf(_standardize, "string")("word").alias("standard"), F.arrow_udf(_stem, "string")("word").alias("stem"))


def add_stems(df: DataFrame, word_col: str = "word") -> DataFrame:
    """df with standard and stem, joined back from the distinct words."""
    both = normalise_words(df, word_col).withColumnRenamed("word", "stem word")
    return df.join(both, F.col(word_col).eqNullSafe(F.col("stem word"))).drop("stem word")
