"""Danish."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

V = "aeiouyæåø"
# Fixed values of the algorithm.
MAIN = (
    "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets "
    "et eret s"
).split()


def _pair(w: str, r1: int) -> str:
    return w[:-1] if longest(w, ("gd", "dt", "gt", "kt"), r1) else w


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    r1 = max(after_vowel_consonant(word, V), 3)
    w = word
    s = longest(w, MAIN, r1)
    if s == "s":
        w = w[:-1] if w[-2:-1] in tuple("abcdfghjklmnoprtvyzå") else w
    elif s:
        w = w[: -len(s)]
    w = _pair(w, r1)
    if w.endswith("igst"):
        w = w[:-2]
    s = longest(w, ("ig", "lig", "elig", "els", "løst"), r1)
    if s == "løst":
        w = w[:-1]
    elif s:
        w = _pair(w[: -len(s)], r1)
    if len(w) - 1 >= r1 and w[-1:] == w[-2:-1] and w[-1] in "bcdfghjklmnpqrstvwxz":
        w = w[:-1]
    return w.rstrip("'")
