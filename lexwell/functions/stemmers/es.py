"""Spanish."""

from lexwell.functions.stemmers import after_vowel_consonant, longest, romance_rv

V = "aeiouáéíóúü"
ACUTE = str.maketrans("áéíóú", "aeiou")
# Fixed values of the algorithm.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
STRESSED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
PLAIN = ("ando", "iendo", "ar", "er", "ir")
STANDARD = {
    **dict.fromkeys("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(), "delete"),
    **dict.fromkeys("adora ador ación acion adoras adores aciones ante antes ancia ancias".split(), "ic"), "logía": "log", "logías": "log", "ución": "u",
    "uciones": "u", "encia": "ente", "encias": "ente", "amente": "amente", "mente": "mente", "idad": "idad", "idades": "idad",
    **dict.fromkeys("iva ivo ivas ivos".split(), "at"),
}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
EN = ("en", "es", "éis", "emos")
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás "
    "iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido "
    "ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos "
    "íamos imos áramos iéramos iésemos ásemos"
).split()


def stem(word: str) -> str:
    if not word:
        return word
    w = word
    rv = romance_rv(w, V)
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    w = _pronoun(w, rv)
    changed = _standard(w, r1, r2)
    if changed is None:
        changed = _y_verb(w, rv)
    if changed is None:
        changed = _verb(w, rv)
    w = w if changed is None else changed
    s = longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACUTE)


def _pronoun(w: str, rv: int) -> str:
    s = longest(w, PRONOUNS)
    if not s:
        return w
    before = w[: -len(s)]
    form = longest(before, (*STRESSED, *PLAIN, "yendo"))
    if not form or len(before) - len(form) < rv:
        return w
    if form in STRESSED:
        return before[: -len(form)] + STRESSED[form]
    if form == "yendo" and not before[:-5].endswith("u"):
        return w
    return before


def _standard(w: str, r1: int, r2: int) -> str | None:
    s = longest(w, STANDARD)
    if not s:
        return None
    kind, before = STANDARD[s], w[: -len(s)]
    at = len(before)
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
    follow = {"delete": (), "ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "at": ("at",)}[kind]
    inner = longest(before, follow, r2)
    return before[: -len(inner)] if inner else before


def _y_verb(w: str, rv: int) -> str | None:
    s = longest(w, Y_VERBS, rv)
    return w[: -len(s)] if s and w[: -len(s)].endswith("u") else None


def _verb(w: str, rv: int) -> str | None:
    s = longest(w, (*VERBS, *EN), rv)
    if not s:
        return None
    w = w[: -len(s)]
    return w[:-1] if s in EN and w.endswith("gu") else w
