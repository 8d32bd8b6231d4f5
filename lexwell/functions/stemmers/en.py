"""English: Porter2."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

V = "aeiouy"
# Fixed values of the algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "evening", "proceed", "exceed", "succeed"}
PREFIXES = ("univers", "commun", "arsen", "emerg", "gener", "inter", "later", "organ", "past")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogist": "og", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in V and w[1] not in V
    return w == "past" or len(w) > 2 and w[-3] not in V and w[-2] in V and w[-1] not in V + "wxY"


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in V) else c for i, c in enumerate(w))
    prefix = next((p for p in PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    w = _step1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    s = longest(w, STEP2)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if s == "li":
            w = before if before[-1:] in tuple("cdeghkmnrt") else w
        elif s != "ogi" or before.endswith("l"):
            w = before + STEP2[s]
    s = longest(w, STEP3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + STEP3[s]
    s = longest(w, STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _step1b(w: str, r1: int) -> str:
    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s is None:
        return w
    before = w[: -len(s)]
    if s.startswith("eed"):
        return before + "ee" if len(before) >= r1 and before not in ("proc", "exc", "succ") else w
    if s == "ing" and len(before) == 2 and before[1] in "yY" and before[0] not in V:
        return before[0] + "ie"
    if not any(c in V for c in before):
        return w
    w = before
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w if len(w) == 3 and w[0] in "aeo" else w[:-1]
    return w + "e" if len(w) <= r1 and _short(w) else w
