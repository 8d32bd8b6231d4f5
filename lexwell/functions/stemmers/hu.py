"""Hungarian."""

from lexwell.functions.stemmers import longest

V = "aeiouáéíóőöúüű"
DIGRAPHS = ("cs", "dzs", "gy", "ly", "ny", "sz", "ty", "zs")
DOUBLE = ("bb", "cc", "ccs", "dd", "ff", "gg", "ggy", "jj", "kk", "ll", "lly", "mm", "nn", "nny", "pp", "rr", "ss", "ssz", "tt", "tty", "vv", "zz", "zzs")
# Fixed values of the algorithm.
CASES = (
    "ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként "
    "anként ként en on an ön n t"
).split()
OWNED = {
    "é": "", "éi": "", "oké": "", "öké": "", "aké": "", "eké": "", "ké": "", "okéi": "", "ökéi": "", "akéi": "", "ekéi": "", "kéi": "", "áké": "a", "éké": "e",
    "ákéi": "a", "ékéi": "e", "áéi": "a", "ééi": "e", "éé": "e", "áé": "a",
}
SINGULAR = {
    **dict.fromkeys("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o".split(), ""), "ánk": "a", "énk": "e", "ájuk": "a", "éjük": "e", "ám": "a",
    "ém": "e", "ád": "a", "éd": "e", "á": "a", "é": "e",
}
PLURAL_OWNER = {
    **dict.fromkeys(
        "jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik".split(), ""
    ),
    **{f"á{s}": "a" for s in ("im", "id", "i", "ink", "itok", "ik")}, **{f"é{s}": "e" for s in ("im", "id", "i", "ink", "itek", "ik")},
}
PLURAL = {"ák": "a", "ék": "e", **dict.fromkeys(("ök", "ok", "ek", "ak", "k"), "")}


def _region(w: str) -> int:
    n = len(w)
    if n and w[0] in V:
        i = next((i for i in range(1, n) if w[i] not in V), n)
        if i >= n:
            return n
        return next((i + len(d) for d in sorted(DIGRAPHS, key=len, reverse=True) if w.startswith(d, i)), i + 1)
    return next((i + 1 for i, c in enumerate(w) if c in V), n)


def _undoubled(w: str) -> str:
    d = longest(w, DOUBLE)
    return w[: -len(d)] + d[1:] if d else w


def _table(w: str, r1: int, table: dict[str, str]) -> str:
    s = longest(w, table)
    return w[: -len(s)] + table[s] if s and len(w) - len(s) >= r1 else w


def stem(word: str) -> str:
    w = word
    r1 = _region(w)
    if w.endswith(("al", "el")) and len(w) - 2 >= r1 and longest(w[:-2], DOUBLE):
        w = _undoubled(w[:-2])
    s = longest(w, CASES)
    if s and len(w) - len(s) >= r1:
        w = w[: -len(s)]
        if w[-1:] in ("á", "é") and len(w) - 1 >= r1:
            w = w[:-1] + {"á": "a", "é": "e"}[w[-1]]
    w = _table(w, r1, {"én": "e", "án": "a", "ánként": "a"})
    w = _table(w, r1, {"astul": "", "estül": "", "stul": "", "stül": "", "ástul": "a", "éstül": "e"})
    if w[-1:] in ("á", "é") and len(w) - 1 >= r1 and longest(w[:-1], DOUBLE):
        w = _undoubled(w[:-1])
    for table in (OWNED, SINGULAR, PLURAL_OWNER, PLURAL):
        w = _table(w, r1, table)
    return w
