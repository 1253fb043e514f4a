"""English stemming by the published Porter2 rules, and the usual English stop words."""

from __future__ import annotations

from functools import lru_cache

STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had"
    " having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any"
    " both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AS_IS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if not _vowel(w, i) and _vowel(w, i - 1):
                return i + 1
        return len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = first if first is not None else after(0)
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel(w, 0) and not _vowel(w, 1)
    return len(w) > 2 and not _vowel(w, len(w) - 3) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 1) and w[-1] not in "wxY"


@lru_cache(100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word
    if w[0] == "y":
        w = "Y" + w[1:]
    w = "".join("Y" if c == "y" and i and w[i - 1] in _VOWELS else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AS_IS:
        return w
    # step 1b
    if w.endswith(("eed", "eedly")):
        cut = len(w) - (3 if w.endswith("eed") else 5)
        if cut >= r1:
            w = w[:cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if any(c in _VOWELS for c in base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif base.endswith(_DOUBLES):
                        w = base[:-1]
                    elif r1 >= len(base) and _short_end(base):
                        w = base + "e"
                    else:
                        w = base
                break
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # step 2
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
                else:
                    w = w[: -len(end)] + _STEP2[end]
            break
    # step 3
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r1:
                if end == "ative":
                    w = w[:cut] if cut >= r2 else w
                else:
                    w = w[:cut] + _STEP3[end]
            break
    # step 4
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r2 and (end != "ion" or w[cut - 1 : cut] in ("s", "t")):
                w = w[:cut]
            break
    # step 5
    if w.endswith("e"):
        cut = len(w) - 1
        if cut >= r2 or cut >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
