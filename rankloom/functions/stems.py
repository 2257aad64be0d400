"""Stemmers: functions from a term to its stem, meant for distinct terms.

``plural_stem`` takes English plurals back to the singular by three rules.
``porter_stem`` is the published five-step suffix stripping algorithm for
English: a word is seen as runs of consonants and vowels, its measure is how
many times a vowel run is followed by a consonant run, and a suffix goes only
where the measure of what is left is large enough.
"""

from __future__ import annotations

import re

# Suffixes and what they become, step by step, in the order they are tried.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ASCII = re.compile("[a-z]+")


def plural_stem(term: str) -> str:
    """``ies`` to ``y`` (not after a or e), ``es`` to ``e`` (not after a, e or o), ``s`` off (not after s or u); the first rule that fits decides."""
    if term.endswith("ies") and not term.endswith(("eies", "aies")):
        return term[:-3] + "y"
    if term.endswith("es") and not term.endswith(("aes", "ees", "oes")):
        return term[:-1]
    if term.endswith("s") and not term.endswith(("us", "ss")):
        # A lone s stays.
        return term[:-1] or term
    return term


plural_stem.label = "plural"


def _shape(stem: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _mapped(word: str, rules, least: int) -> str:
    """The longest suffix of ``rules`` that the word has is exchanged if what is left has a measure above ``least``."""
    fits = [(old, new) for old, new in rules if word.endswith(old)]
    if fits:
        old, new = max(fits, key=lambda rule: len(rule[0]))
        if _measure(word[:-len(old)]) > least:
            return word[:-len(old)] + new
    return word


def _plurals(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past_and_gerund(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = next((word[:-len(end)] for end in ("ed", "ing") if word.endswith(end) and _has_vowel(word[:-len(end)])), None)
    if cut is None:
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if _doubled(cut) and cut[-1] not in "lsz":
        return cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut


def _long_suffix(word: str) -> str:
    fits = [end for end in STEP_4 if word.endswith(end)]
    if fits:
        stem = word[:-len(max(fits, key=len))]
        if _measure(stem) > 1 and (not word.endswith("ion") or stem[-1:] in ("s", "t")):
            return stem
    return word


def _final_letters(word: str) -> str:
    if word.endswith("e"):
        measure = _measure(word[:-1])
        if measure > 1 or (measure == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def porter_stem(term: str) -> str:
    """The stem of a lower-case English word; words of one or two letters and those with other letters stay."""
    if len(term) < 3 or not _ASCII.fullmatch(term):
        return term
    word = _past_and_gerund(_plurals(term))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, STEP_2, 0), STEP_3, 0)
    return _final_letters(_long_suffix(word))


porter_stem.label = "porter"
