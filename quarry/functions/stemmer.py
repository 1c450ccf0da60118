"""The Porter stemmer, after the published algorithm (M. F. Porter, 1980)."""

from __future__ import annotations

import re

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_M0 = re.compile(f"^({_CC})?{_VV}{_CC}")
_M1 = re.compile(f"^({_CC})?{_VV}{_CC}({_VV})?$")
_M2 = re.compile(f"^({_CC})?{_VV}{_CC}{_VV}{_CC}")
_HAS_VOWEL = re.compile(f"^({_CC})?{_V}")
_CVC = re.compile(f"^{_CC}{_V}[^aeiouwxy]$")

# The suffix tables of steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_STEP2_RE = re.compile("^(.+?)(" + "|".join(_STEP2) + ")$")
_STEP3_RE = re.compile("^(.+?)(" + "|".join(_STEP3) + ")$")
_STEP4_RE = re.compile("^(.+?)(" + "|".join(_STEP4) + ")$")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters or with other characters than a-z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    y_first = word[0] == "y"
    w = "Y" + word[1:] if y_first else word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _HAS_VOWEL.match(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _CVC.match(w):
                    w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for pattern, table in ((_STEP2_RE, _STEP2), (_STEP3_RE, _STEP3)):
        if (m := pattern.match(w)) and _M0.match(m[1]):
            w = m[1] + table[m[2]]
    if m := _STEP4_RE.match(w):
        if _M2.match(m[1]):
            w = m[1]
    elif (m := re.match("^(.+?)(s|t)(ion)$", w)) and _M2.match(m[1] + m[2]):
        w = m[1] + m[2]
    if w.endswith("e"):
        head = w[:-1]
        if _M2.match(head) or (_M1.match(head) is None and _M0.match(head)) or (_M1.match(head) and not _CVC.match(head)):
            w = head
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if y_first else w
