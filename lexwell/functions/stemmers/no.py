"""Norwegian."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

V = "aeiouyæåøêòâ"
# Fixed values of the algorithm.
MAIN = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert".split()
OTHER = ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov")
KEEP_ERS = ("amm", "ast", "ind", "kap", "kk", "lt", "nk", "omm", "pp", "v", "øst")


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    r1 = max(after_vowel_consonant(word, V), 3)
    w = word
    s = longest(w, MAIN, r1)
    if s == "ers":
        w = w if w[:-3].endswith(KEEP_ERS) else w[:-3]
    elif s == "s":
        if w[-2:-1] in tuple("bcdfghjlmnoptvyz") or w.endswith("rs") and w[-3:-2] != "e" or w.endswith("ks") and w[-3:-2] not in V:
            w = w[:-1]
    elif s in ("erte", "ert"):
        w = w[: len(w) - len(s)] + "er"
    elif s:
        w = w[: -len(s)]
    if longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    s = longest(w, OTHER, r1)
    if s:
        w = w[: -len(s)]
    return w.rstrip("'")
