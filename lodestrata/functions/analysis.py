"""Text analyzers: expressions that turn a text column into an array of tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The short English stop list of the default analyzer profile.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that")

#: Letters and digits of any script; [^\\W_] is the same in Python.
TOKEN = r"[\pL\pN]+"


@dataclass(frozen=True)
class Analyzer:
    """Lower-case runs of Unicode letters and digits, without stop words; stem: also reduced to stems."""

    stop_words: tuple[str, ...] = field(default=())
    stem: bool = False

    def tokens(self, text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
        if self.stop_words:
            found = F.filter(found, lambda t: ~t.isin(*self.stop_words))
        return stem_all(found) if self.stem else found

    def line(self, text: Column) -> Column:
        """tokens() with a space between any two."""
        if self.stop_words or self.stem:
            return F.array_join(self.tokens(text), " ")
        return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\pL\pN]+", " "))

    def query(self, text: str) -> list[str]:
        """The distinct tokens of a query text, in order."""
        found = [t for t in re.findall(r"[^\W_]+", text.lower()) if t not in self.stop_words]
        return list(dict.fromkeys(stem_word(t) for t in found) if self.stem else dict.fromkeys(found))


TEXT = Analyzer()
TEXT_EN = Analyzer(STOP_WORDS, stem=True)


def edge_ngrams(tokens: Column, least: int = 3, most: int = 6) -> Column:
    """Prefixes of each token of the given lengths."""
    return F.flatten(
        F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(t)))), lambda n: F.substring(t, F.lit(1), n)))
    )


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    marks = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", marks))


# Suffix pairs of the published suffix-stripping algorithm (1980), steps 2 to 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem_word(word: str) -> str:
    """The stem of an English word by suffix stripping."""
    if len(word) <= 2:
        return word
    has_vowel = lambda s: bool(_VOWEL.search(s))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and s[-1] not in "aeiou"
    short = lambda s: bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", s))
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        elif _measure(cut) == 1 and short(cut):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_all(tokens: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def one(t: str) -> str:
            if t not in seen:
                seen[t] = stem_word(t)
            return seen[t]

        return s.map(lambda ts: None if ts is None else [one(t) for t in ts])

    return run(tokens)
