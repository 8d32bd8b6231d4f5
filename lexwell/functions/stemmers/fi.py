"""Finnish."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

# Vowels, vowels without y, consonants, vowels that fall at the end.
V, SHORT, CONSONANTS, FINAL = "aeiouyäö", "aeiouäö", "bcdfghjklmnpqrstvwxz", "aäei"
LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")


def stem(word: str) -> str:
    w = word
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    s = longest(w, ("kin", "kaan", "kään", "ko", "kö", "han", "hän", "pa", "pä", "sti"), r1)
    if s and (len(w) - 3 >= r2 if s == "sti" else w[len(w) - len(s) - 1 : len(w) - len(s)] in tuple("nt" + V)):
        w = w[: -len(s)]
    w = _possessive(w, r1)
    w, cased = _case(w, r1)
    s = longest(w, ("mpi", "mpa", "mpä", "mmi", "mma", "mmä", "impi", "impa", "impä", "immi", "imma", "immä", "eja", "ejä"), r2)
    if s and (len(s) != 3 or s in ("eja", "ejä") or w[-5:-3] != "po"):
        w = w[: -len(s)]
    if cased:
        if w[-1:] in ("i", "j") and len(w) - 1 >= r1:
            w = w[:-1]
    elif w.endswith("t") and len(w) - 1 >= r1 and w[-2:-1] in tuple(V):
        w = w[:-1]
        s = longest(w, ("mma", "imma"), r2)
        if s and (s == "imma" or w[-5:-3] != "po"):
            w = w[: -len(s)]
    return _tidy(w, r1)


def _possessive(w: str, r1: int) -> str:
    s = longest(w, ("si", "ni", "nsa", "nsä", "mme", "nne", "an", "än", "en"), r1)
    if s is None:
        return w
    before = w[: -len(s)]
    if s == "si":
        return before if not before.endswith("k") else w
    if s == "ni":
        return before[:-3] + "ksi" if before.endswith("kse") else before
    if s in ("nsa", "nsä", "mme", "nne"):
        return before
    ends = {"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}[s]
    return before if before.endswith(ends) else w


def _case(w: str, r1: int) -> tuple[str, bool]:
    h = {f"h{v}n": v for v in SHORT}
    s = longest(
        w, (*h, "siin", "den", "tten", "seen", "a", "ä", "tta", "ttä", "ta", "tä", "ssa", "ssä", "sta", "stä", "lla", "llä", "lta", "ltä", "lle", "na", "nä", "ksi", "ine", "n"), r1
    )
    if s is None:
        return w, False
    before = w[: -len(s)]
    vi = before[-1:] == "i" and before[-2:-1] in tuple(SHORT)
    if s in h:
        return (before, True) if before.endswith(h[s]) else _n(w, r1)
    if s in ("siin", "den", "tten"):
        return (before, True) if vi else _n(w, r1)
    if s == "seen":
        return (before, True) if before.endswith(LONG) else _n(w, r1)
    if s in ("a", "ä"):
        return (before, True) if len(before) > 1 and before[-1] in V and before[-2] in CONSONANTS else (w, False)
    if s in ("tta", "ttä"):
        return (before, True) if before.endswith("e") else (w, False)
    if s == "n":
        return _n(w, r1)
    return before, True


def _n(w: str, r1: int) -> tuple[str, bool]:
    if not w.endswith("n") or len(w) - 1 < r1:
        return w, False
    w = w[:-1]
    if w.endswith(LONG) or w.endswith("ie"):
        w = w[:-1]
    return w, True


def _tidy(w: str, r1: int) -> str:
    if w.endswith(LONG) and len(w) - 2 >= r1:
        w = w[:-1]
    if len(w) > 1 and w[-1] in FINAL and w[-2] in CONSONANTS and len(w) - 2 >= r1:
        w = w[:-1]
    if w.endswith(("oj", "uj")) and len(w) - 2 >= r1:
        w = w[:-1]
    if w.endswith("jo") and len(w) - 2 >= r1:
        w = w[:-1]
    i = len(w)
    while i and w[i - 1] in V:
        i -= 1
    if i > 1 and w[i - 1] in CONSONANTS and w[i - 1] == w[i - 2]:
        w = w[: i - 1] + w[i:]
    return w.rstrip("'")
