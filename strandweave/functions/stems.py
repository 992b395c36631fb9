"""English word stems by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that a full-text index leaves out.
TEXT_STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
    had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
    don should now""".split()
)
#: Words with a stem of their own, words that stay, words that end after the plural, and endings.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FIXED = "sky news howe atlas cosmos bias andes".split()
FIXED_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}]")
_HEAD = re.compile("gener|commun|arsen")
_SHORT = re.compile(f"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(w: str) -> tuple[int, int]:
    """Where the two regions begin whose endings may go."""
    head, first = _HEAD.match(w), _REGION.search(w)
    r1 = head.end() if head else first.end() if first else len(w)
    second = _REGION.search(w, r1)
    return r1, second.end() if second else len(w)


def _ending(w: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if w.endswith(e)), key=len, default="")


def _has_vowel(w: str) -> bool:
    return any(c in _V for c in w)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not end:
        return w
    base = w[: -len(end)]
    if end.startswith("eed"):
        return base + "ee" if len(base) >= r1 else w
    if not _has_vowel(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE.search(base):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT.search(base) else base


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in FIXED:
        return word
    w = re.sub(f"(^|[{_V}])y", r"\1Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub("'(?:s'?)?$", "", w)
    w = _plural(w)
    if w in FIXED_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    end = _ending(w, STEP2)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base.endswith(tuple("cdeghkmnrt"))):
        w = base + STEP2[end]
    end = _ending(w, STEP3)
    base = w[: len(w) - len(end)]
    if end and len(base) >= (r2 if end == "ative" else r1):
        w = base + STEP3[end]
    end = _ending(w, STEP4)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
        w = base
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()
