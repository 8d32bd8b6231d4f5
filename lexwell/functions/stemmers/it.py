"""Italian."""

from lexwell.functions.stemmers import after_vowel_consonant, longest, romance_rv

V = "aeiouàèìòù"
# Fixed values of the algorithm.
PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene "
    "vela vele veli velo vene"
).split()
STANDARD = {
    **dict.fromkeys(
        "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split(),
        "delete",
    ),
    **dict.fromkeys("azione azioni atore atori".split(), "ic"), "logia": "log", "logie": "log", **dict.fromkeys("uzione uzioni usione usioni".split(), "u"),
    "enza": "ente", "enze": "ente", **dict.fromkeys("amento amenti imento imenti".split(), "rv"), "amente": "amente", "ità": "ità",
    **dict.fromkeys("ivo ivi iva ive".split(), "at"),
}
VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe "
    "erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei "
    "iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def stem(word: str) -> str:
    if not word:
        return word
    w = word.translate(str.maketrans("áéíóú", "àèìòù"))
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "u" and i and chars[i - 1] == "q" or c in "ui" and 0 < i < len(w) - 1 and w[i - 1] in V and w[i + 1] in V:
            chars[i] = c.upper()
    w = "".join(chars)
    rv = 5 if w.startswith("divan") else romance_rv(w, V)
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    s = longest(w, PRONOUNS)
    if s:
        before = w[: -len(s)]
        form = longest(before, ("ando", "endo", "ar", "er", "ir"), rv)
        if form:
            w = before if form in ("ando", "endo") else before + "e"
    changed = _standard(w, rv, r1, r2)
    if changed is None and (s := longest(w, VERBS, rv)):
        changed = w[: -len(s)]
    w = w if changed is None else changed
    if w[-1:] in tuple("aeioàèìò") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.lower()


def _standard(w: str, rv: int, r1: int, r2: int) -> str | None:
    s = longest(w, STANDARD)
    if not s:
        return None
    kind, before = STANDARD[s], w[: -len(s)]
    at = len(before)
    if kind == "rv":
        return before if at >= rv else None
    if kind == "amente":
        if at < r1:
            return None
        inner = longest(before, ("iv", "os", "ic", "abil"), r2)
        if inner:
            before = before[: -len(inner)]
            if inner == "iv" and before.endswith("at") and len(before) - 2 >= r2:
                before = before[:-2]
        return before
    if at < r2:
        return None
    if kind in ("log", "u", "ente"):
        return before + kind
    follow = {"delete": (), "ic": ("ic",), "ità": ("abil", "ic", "iv"), "at": ("at",)}[kind]
    inner = longest(before, follow, r2)
    if inner:
        before = before[: -len(inner)]
        if inner == "at" and before.endswith("ic") and len(before) - 2 >= r2:
            before = before[:-2]
    return before
