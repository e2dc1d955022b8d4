"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for lower-case English words."""

from __future__ import annotations

#: Suffixes of the algorithm's steps 2, 3 and 4, and what steps 2 and 3 put in their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """``v`` for vowels and for y after a consonant, ``c`` for the rest."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _short_end(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural_and_past(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    cut = _longest(w, ("ed", "ing"))
    if cut and "v" in _kinds(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-1:] == w[-2:-1] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    return w


def stem(word: str) -> str:
    """The stem of a word of ASCII letters; other words and those of one or two letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = _plural_and_past(word)
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP_2, STEP_3):
        if (s := _longest(w, step)) and _measure(w[: -len(s)]):
            w = w[: -len(s)] + step[s]
    if (s := _longest(w, STEP_4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
