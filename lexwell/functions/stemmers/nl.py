"""Dutch, the classic five-step form."""

from lexwell.functions.stemmers import after_vowel_consonant

V = "aeiouyè"


def _undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def _en(w: str, suffix: str, r1: int) -> str:
    before = w[: -len(suffix)]
    if len(before) >= r1 and before and before[-1] not in V and not before.endswith("gem"):
        return _undouble(before)
    return w


def stem(word: str) -> str:
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = "".join(
        "Y" if c == "y" and (i == 0 or w[i - 1] in V) else "I" if c == "i" and 0 < i < len(w) - 1 and w[i - 1] in V and w[i + 1] in V else c
        for i, c in enumerate(w)
    )
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    r1 = max(r1, 3)
    if w.endswith("heden"):
        if len(w) - 5 >= r1:
            w = w[:-5] + "heid"
    elif w.endswith(("ene", "en")):
        w = _en(w, "ene" if w.endswith("ene") else "en", r1)
    elif w.endswith(("se", "s")):
        s = "se" if w.endswith("se") else "s"
        before = w[: -len(s)]
        if len(before) >= r1 and before and before[-1] not in V + "j":
            w = before
    removed_e = False
    if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in V:
        w, removed_e = _undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = _en(w, "en", r1)
    if w.endswith(("end", "ing")):
        if len(w) - 3 >= r2:
            w = w[:-3]
            if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                w = w[:-2]
            else:
                w = _undouble(w)
    elif w.endswith("ig"):
        if len(w) - 2 >= r2 and w[-3:-2] != "e":
            w = w[:-2]
    elif w.endswith("lijk"):
        if len(w) - 4 >= r2:
            w = w[:-4]
            if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in V:
                w = _undouble(w[:-1])
    elif w.endswith("baar"):
        if len(w) - 4 >= r2:
            w = w[:-4]
    elif w.endswith("bar"):
        if len(w) - 3 >= r2 and removed_e:
            w = w[:-3]
    if len(w) >= 4 and w[-4] not in V and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-1] not in V + "I":
        w = w[:-2] + w[-1]
    return w.lower()
