"""German, the classic form of the algorithm."""

from lexwell.functions.stemmers import after_vowel_consonant, longest, marked_between_vowels

V = "aeiouyäöü"


def stem(word: str) -> str:
    w = marked_between_vowels(word.replace("ß", "ss"), "uy", V)
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    r1 = max(r1, 3)
    s = longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        before = w[: -len(s)]
        if s in ("end", "ung"):
            w = before
            if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = before if not before.endswith("e") else w
        elif s in ("lich", "heit"):
            w = before[:-2] if before.endswith(("er", "en")) and len(before) - 2 >= r1 else before
        else:
            inner = longest(before, ("lich", "ig"), r2)
            w = before[: -len(inner)] if inner else before
    return w.lower().translate(str.maketrans("äöü", "aou"))
