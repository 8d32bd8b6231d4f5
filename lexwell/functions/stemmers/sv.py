"""Swedish."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

V = "aeiouyäåö"
# Fixed values of the algorithm.
MAIN = (
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens "
    "hetens erns at andet het ast et s"
).split()
OTHER = ("lig", "ig", "els", "löst", "öst", "fullt")
KEEP_ET = (
    "h", "iet", "uit", "fab", "cit", "dit", "alit", "ilit", "mit", "nit", "pit", "rit", "sit", "tit", "uit", "ivit", "kvit", "xit", "kom", "rak", "pak", "stak",
)


def _is_ending(before: str) -> bool:
    """Whether et after ``before`` is an ending: not in words such as paket, where too little or a listed form is before it."""
    return any(c in V for c in before[:-1]) and not before.endswith(KEEP_ET)


def stem(word: str) -> str:
    r1 = max(after_vowel_consonant(word, V), 3) if len(word) > 3 else len(word)
    w = word
    s = longest(w, MAIN, r1)
    if s == "s":
        if w.endswith("ets") and _is_ending(w[:-3]):
            w = w[:-3]
        elif w[-2:-1] in tuple("bcdfghjklmnoprtvy"):
            w = w[:-1]
    elif s == "et":
        w = w[:-2] if _is_ending(w[:-2]) else w
    elif s:
        w = w[: -len(s)]
    if longest(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    s = longest(w, OTHER, r1)
    if s in ("lig", "ig", "els"):
        w = w[: -len(s)]
    elif s == "löst" or s == "öst" and w[-4:-3] in tuple("iklnprtuv"):
        w = w[:-1]
    elif s == "fullt":
        w = w[:-1]
    return w
