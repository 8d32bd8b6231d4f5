"""Portuguese."""

from lexwell.functions.stemmers import after_vowel_consonant, longest, romance_rv

V = "aeiouáéíóúâêô"
# Fixed values of the algorithm.
STANDARD = {
    **dict.fromkeys(
        "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante "
        "antes ância".split(), "delete"
    ),
    "logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente", "amente": "amente", "mente": "mente", "idade": "idade",
    "idades": "idade", "iva": "at", "ivo": "at", "ivas": "at", "ivos": "at", "ira": "ira", "iras": "ira",
}
VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem "
    "erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes "
    "erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis "
    "ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos "
    "armos ermos irmos eu iu ou ira iras"
).split()


def stem(word: str) -> str:
    if not word:
        return word
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv = romance_rv(w, V)
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    changed = _standard(w, rv, r1, r2)
    if changed is None and (s := longest(w, VERBS, rv)):
        changed = w[: -len(s)]
    if changed is not None:
        w = changed
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif s := longest(w, ("os", "a", "i", "o", "á", "í", "ó"), rv):
        w = w[: -len(s)]
    s = longest(w, ("e", "é", "ê"), rv)
    if s:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


def _standard(w: str, rv: int, r1: int, r2: int) -> str | None:
    s = longest(w, STANDARD)
    if not s:
        return None
    kind, before = STANDARD[s], w[: -len(s)]
    at = len(before)
    if kind == "ira":
        return before + "ir" if at >= rv and before.endswith("e") else None
    if kind == "amente":
        if at < r1:
            return None
        inner = longest(before, ("iv", "os", "ic", "ad"), r2)
        if inner:
            before = before[: -len(inner)]
            if inner == "iv" and before.endswith("at") and len(before) - 2 >= r2:
                before = before[:-2]
        return before
    if at < r2:
        return None
    if kind in ("log", "u", "ente"):
        return before + kind
    follow = {"delete": (), "mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "at": ("at",)}[kind]
    inner = longest(before, follow, r2)
    return before[: -len(inner)] if inner else before
