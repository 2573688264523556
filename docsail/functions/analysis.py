"""Text analysis: the tokens of a text as an array column, and the same for query strings.

``standard`` stays in the JVM. ``english`` adds possessives, stop words and Porter stems; ``korean`` and ``japanese`` fall back on
character pairs of ideographs, as no morphological dictionary is at hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
MAX_TOKEN = 255
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_WORD = regex.compile(WORD)
_PAIRED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])[\p{L}\p{M}\p{N}_])+")
_CJK = regex.compile(r"^[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def standard(text: Column) -> Column:
    """Lower-case words; one of more than MAX_TOKEN characters is cut into such parts. Null for a null text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def cut(words: Column) -> Column:
        parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("(?s).{1,%d}" % MAX_TOKEN), F.lit(0))))
        return F.when(F.exists(words, lambda w: F.length(w) > MAX_TOKEN), parts).otherwise(words)

    return F.transform(F.array(found), cut)[0]  # the lambda names the words, so that the text is matched once


def standard_terms(text: str) -> list[str]:
    return [w[i : i + MAX_TOKEN] for w in _WORD.findall(text.lower()) for i in range(0, len(w), MAX_TOKEN)]


def english_terms(words: list[str]) -> list[str]:
    bare = [w[:-2] if w.endswith(("'s", "’s")) else w for w in words]
    return [stem(w) for w in bare if w not in STOP]


def pair_terms(text: str) -> list[str]:
    out = []
    for run in _PAIRED.findall(text.lower()):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if _CJK.match(run) else [run]
    return out


def analyze(text: str, analyzer: str) -> list[str]:
    """The terms of a query string."""
    if analyzer == "standard":
        return standard_terms(text)
    if analyzer == "english":
        return english_terms(standard_terms(text))
    return pair_terms(text)


def english_lists(lists: pa.Array) -> pa.Array:
    """english_terms of every list of a batch; null for null. Python sees distinct words only, and of them those that a rule may change."""
    words = pc.dictionary_encode(lists.flatten())
    bare = pc.replace_substring_regex(words.dictionary, "['’]s$", "")
    ends_so = pc.match_substring_regex(bare, f"(?:{'|'.join(_SUFFIXES)})$")
    terms = pc.replace_with_mask(bare, ends_so, pa.array([stem(w) for w in bare.filter(ends_so).to_pylist()], pa.string()))
    keep = pc.invert(pc.is_in(bare, value_set=pa.array(sorted(STOP)))).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(lengths))]
    values = terms.take(words.indices.filter(pa.array(keep)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=lists.is_null())


def _pair_lists(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else pair_terms(x) for x in texts.to_pylist()], pa.list_(pa.string()))


def _listed(lists: Callable[[pa.Array], pa.Array], column: Column) -> Column:
    """A Python analyzer of batches as a column; null for null."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(lists, batches)

    return run(column)


def english(words: Column) -> Column:
    """The English terms of a text's standard tokens."""
    return _listed(english_lists, words)


def tokens(text: Column, analyzer: str) -> Column:
    if analyzer == "standard":
        return standard(text)
    return english(standard(text)) if analyzer == "english" else _listed(_pair_lists, text)


_VOWELS = frozenset("aeiou")
_VOWEL_CONSONANT = re.compile("[aeiou][^aeiou]")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    if "y" not in w:
        return len(_VOWEL_CONSONANT.findall(w))
    shape = [_consonant(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(shape, shape[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return not _VOWELS.isdisjoint(w) or "y" in w and any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_EVERY = {"s", "ed", "ing", "y", "e", "ll", *_STEP2, *_STEP3, *_STEP4}
#: What a word must end in for a rule to change it; suffixes that end in another one are covered by that.
_SUFFIXES = tuple(sorted(s for s in _EVERY if not any(s != x and s.endswith(x) for x in _EVERY)))
_TABLES = tuple((table, tuple(table)) for table in (_STEP2, _STEP3))


def _longest(w: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len) if w.endswith(suffixes) else None


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """The stem by Porter's algorithm (1980), with the two changes of its author's own later programs (bli, logi)."""
    if len(w) < 3 or not w.endswith(_SUFFIXES):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, suffixes in _TABLES:
        s = _longest(w, suffixes)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w
