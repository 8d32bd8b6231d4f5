"""French."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

V = "aeiouyâàëéêèïîôûù"
# Fixed values of the algorithm.
STANDARD = {
    **dict.fromkeys("ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "delete"),
    **dict.fromkeys("atrice ateur ation atrices ateurs ations".split(), "ic"), "logie": "log", "logies": "log", **dict.fromkeys("usion ution usions utions".split(), "u"),
    "ence": "ent", "ences": "ent", "ement": "ement", "ements": "ement", "ité": "ité", "ités": "ité", **dict.fromkeys("if ive ifs ives".split(), "if"),
    "eaux": "eau", "aux": "al", "euse": "eux", "euses": "eux", "issement": "iss", "issements": "iss", "amment": "ant", "emment": "ent2", "ment": "ment",
    "ments": "ment",
}
I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse "
    "issent isses issez issiez issions issons it"
).split()
E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _marked(word: str) -> str:
    c = list(word)
    for i, x in enumerate(word):
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        inside = before and after and c[i - 1] in V and after in V
        if x == "u" and (inside or before == "q") or x == "i" and inside or x == "y" and (before and before in V or after and after in V):
            c[i] = x.upper()
    return "".join(c).replace("ë", "He").replace("ï", "Hi")


def _rv(w: str) -> int:
    if len(w) > 2 and w[0] in V and w[1] in V or w.startswith(("par", "col", "tap")) or w.startswith("ni") and w[2:3] in tuple(V):
        return 3
    return next((i + 1 for i in range(1, len(w)) if w[i] in V), len(w))


def stem(word: str) -> str:
    if not word:
        return word
    w = _marked(word)
    rv = _rv(w)
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    w, done, verb_next = _standard(w, rv, r1, r2)
    if not done or verb_next:
        found = _i_verb(w, rv)
        if found is None:
            found = _verb(w, rv, r2)
        if found is not None:
            w, done = found, True
        elif not done:
            w = _residual(w, rv, r2)
    if done:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    i = len(w)
    while i and w[i - 1] not in V:
        i -= 1
    if 0 < i < len(w) and w[i - 1] in "éè":
        w = w[: i - 1] + "e" + w[i:]
    return w.replace("He", "ë").replace("Hi", "ï").lower()


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool, bool]:
    """(word, whether an ending was removed, whether the verb steps still follow)."""
    s = longest(w, STANDARD)
    if not s:
        return w, False, False
    kind, before = STANDARD[s], w[: -len(s)]
    at = len(before)
    if kind in ("ant", "ent2"):
        return (before + kind[:3], True, True) if at >= rv else (w, False, False)
    if kind == "ment":
        inside = at - 1 >= rv and before[-1] in V
        return (before, True, True) if inside else (w, False, False)
    if kind == "iss":
        return (before, True, False) if at >= r1 and before and before[-1] not in V else (w, False, False)
    if kind == "eau":
        return before + "eau", True, False
    if kind == "al":
        return (before + "al", True, False) if at >= r1 else (w, False, False)
    if kind == "eux":
        if at >= r2:
            return before, True, False
        return (before + "eux", True, False) if at >= r1 else (w, False, False)
    if kind == "ement":
        if at < rv:
            return w, False, False
        w = before
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = w[:-2]
            return (w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w), True, False
        if w.endswith("eus"):
            return (w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w), True, False
        if w.endswith(("abl", "iqU")) and len(w) - 3 >= r2:
            return w[:-3], True, False
        if w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
            return w[:-3] + "i", True, False
        return w, True, False
    if at < r2:
        return w, False, False
    if kind in ("log", "u"):
        return before + kind, True, False
    if kind == "ent":
        return before + "ent", True, False
    w = before
    if kind == "ic" and w.endswith("ic"):
        w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    elif kind == "ité":
        if w.endswith("abil"):
            w = w[:-4] if len(w) - 4 >= r2 else w[:-2] + "l"
        elif w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif w.endswith("iv") and len(w) - 2 >= r2:
            w = w[:-2]
    elif kind == "if" and w.endswith("at") and len(w) - 2 >= r2:
        w = w[:-2]
        if w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    return w, True, False


def _i_verb(w: str, rv: int) -> str | None:
    s = longest(w, I_VERBS, rv)
    if s and len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] not in V + "H":
        return w[: -len(s)]
    return None


def _verb(w: str, rv: int, r2: int) -> str | None:
    s = longest(w, (*E_VERBS, *A_VERBS, "ions"), rv)
    if not s:
        return None
    before = w[: -len(s)]
    if s == "ions":
        return before if len(before) >= r2 else None
    if s in A_VERBS and before.endswith("e") and len(before) - 1 >= rv:
        return before[:-1]
    return before


def _residual(w: str, rv: int, r2: int) -> str:
    if w.endswith("s") and (w.endswith("His") or w[-2:-1] not in tuple("aiouès") + ("",)):
        w = w[:-1]
    s = longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
    if s == "ion":
        return w[:-3] if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
    if s in ("ier", "ière", "Ier", "Ière"):
        return w[: -len(s)] + "i"
    return w[:-1] if s else w
