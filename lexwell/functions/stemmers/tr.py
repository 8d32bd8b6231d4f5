"""Turkish: suffixes are taken off from the end, checked for vowel harmony and buffer letters."""

from __future__ import annotations

V, U = "aeıioöuü", "ıiuü"
# The vowels a suffix vowel agrees with.
HARMONY = {"a": "aıou", "e": "eiöü", "ı": "aı", "i": "ei", "o": "ou", "ö": "öü", "u": "ou", "ü": "öü"}


def _u(pattern: str) -> tuple[str, ...]:
    return tuple(pattern.replace("U", u) for u in U)


# Suffixes by name: (endings, whether vowel harmony is checked, buffer letter or None).
SUFFIXES = {
    "possessive": (("m", "n", *_u("mUz"), *_u("nUz")), False, "U"),
    "sU": (tuple(U), True, "s"),
    "lArI": (("leri", "ları"), False, None),
    "yU": (tuple(U), True, "y"),
    "nU": (_u("nU"), True, None),
    "nUn": (_u("Un"), True, "n"),
    "yA": (("a", "e"), True, "y"),
    "nA": (("na", "ne"), True, None),
    "DA": (("da", "de", "ta", "te"), True, None),
    "ndA": (("nda", "nde"), True, None),
    "DAn": (("dan", "den", "tan", "ten"), True, None),
    "ndAn": (("ndan", "nden"), True, None),
    "ylA": (("la", "le"), True, "y"),
    "ki": (("ki",), False, None),
    "ncA": (("ca", "ce"), True, "n"),
    "yUm": (_u("Um"), True, "y"),
    "sUn": (_u("sUn"), True, None),
    "yUz": (_u("Uz"), True, "y"),
    "sUnUz": (_u("sUnUz"), False, None),
    "lAr": (("ler", "lar"), True, None),
    "nUz": (_u("nUz"), True, None),
    "DUr": ((*_u("tUr"), *_u("dUr")), True, None),
    "cAsInA": (("casına", "cesine"), False, None),
    "yDU": (tuple(x for d in "td" for end in ("m", "n", "k", "") for x in _u(f"{d}U{end}")), True, "y"),
    "ysA": (("sam", "san", "sak", "sem", "sen", "sek", "sa", "se"), False, "y"),
    "ymUs": (_u("mUş"), True, "y"),
    "yken": (("ken",), False, "y"),
}


class _Word:
    """A word being cut; positions are counted from its end, so they hold when a part is deleted."""

    def __init__(self, word: str) -> None:
        self.w, self.at, self.ket, self.nouns = word, 0, 0, True

    def mark(self, *names: str) -> bool:
        """Moves over the first of these suffixes that ends here."""
        return any(self._mark(n) for n in names)

    def _mark(self, name: str) -> bool:
        endings, harmony, buffer = SUFFIXES[name]
        head = self.w[: len(self.w) - self.at]
        if harmony and not self._harmonious(head):
            return False
        ending = max((e for e in endings if head.endswith(e)), key=len, default=None)
        if ending is None:
            return False
        head = head[: -len(ending)]
        if buffer:
            letters, around = (U, lambda c: c not in V) if buffer == "U" else (buffer, lambda c: c in V)
            if len(head) < 2 or not around(head[-2]):
                return False
            if head[-1] in letters:
                head = head[:-1]
        self.at = len(self.w) - len(head)
        return True

    @staticmethod
    def _harmonious(head: str) -> bool:
        last = next((i for i in range(len(head) - 1, -1, -1) if head[i] in V), -1)
        return last >= 0 and any(c in HARMONY[head[last]] for c in head[:last])

    def open(self) -> bool:
        self.ket = self.at
        return True

    def delete(self) -> bool:
        end = len(self.w)
        self.w = self.w[: end - self.at] + self.w[end - self.ket :]
        self.at = self.ket
        return True

    def attempt(self, step) -> bool:
        """Runs a step; where it fails the position, not the word, is restored."""
        at = self.at
        if step():
            return True
        self.at = at
        return False

    def maybe(self, step) -> bool:
        self.attempt(step)
        return True

    # Verb suffixes on nouns

    def verb_suffixes(self) -> bool:
        persons = ("sUnUz", "lAr", "yUm", "sUn", "yUz")
        self.open()
        steps = (
            lambda: self.mark("ymUs", "yDU", "ysA", "yken"),
            lambda: self.mark("cAsInA") and self.maybe(lambda: self.mark(*persons)) and self.mark("ymUs"),
            lambda: self.mark("lAr") and self.delete() and self.maybe(lambda: self.open() and self.mark("DUr", "yDU", "ysA", "ymUs")) and self._only_verb(),
            lambda: self.mark("nUz") and self.mark("yDU", "ysA"),
            lambda: self.mark("sUnUz", "yUz", "sUn", "yUm") and self.delete() and self.maybe(lambda: self.open() and self.mark("ymUs")),
            lambda: self.mark("DUr")
            and self.delete()
            and self.maybe(lambda: self.open() and self.maybe(lambda: self.mark(*persons)) and self.mark("ymUs")),
        )
        return any(self.attempt(s) for s in steps) and self.delete()

    def _only_verb(self) -> bool:
        self.nouns = False
        return True

    # Noun suffixes

    def cut(self, *names: str) -> bool:
        return self.open() and self.mark(*names) and self.delete()

    def plural_chain(self) -> bool:
        return self.cut("lAr") and self.chain()

    def owned(self, *names: str) -> bool:
        return self.cut(*names) and self.maybe(self.plural_chain)

    def chain(self) -> bool:
        """What stands before -ki."""
        self.open()
        if not self.mark("ki"):
            return False

        def where() -> bool:
            def after() -> bool:
                return self.attempt(lambda: self.cut("lAr") and self.maybe(self.chain)) or self.attempt(lambda: self.owned("possessive"))

            return self.mark("DA") and self.delete() and self.maybe(after)

        def whose() -> bool:
            def after() -> bool:
                return self.attempt(lambda: self.cut("lArI")) or self.attempt(lambda: self.owned("possessive", "sU")) or self.attempt(self.chain)

            return self.mark("nUn") and self.delete() and self.maybe(after)

        def within() -> bool:
            return self.mark("ndA") and (
                self.attempt(lambda: self.mark("lArI") and self.delete())
                or self.attempt(lambda: self.mark("sU") and self.delete() and self.maybe(self.plural_chain))
                or self.attempt(self.chain)
            )

        return self.attempt(where) or self.attempt(whose) or self.attempt(within)

    def noun_suffixes(self) -> bool:
        def like() -> bool:
            def after() -> bool:
                return self.attempt(lambda: self.cut("lArI")) or self.attempt(lambda: self.owned("possessive", "sU")) or self.attempt(self.plural_chain)

            return self.cut("ncA") and self.maybe(after)

        def inside() -> bool:
            return self.open() and self.mark("ndA", "nA") and (
                self.attempt(lambda: self.mark("lArI") and self.delete())
                or self.attempt(lambda: self.mark("sU") and self.delete() and self.maybe(self.plural_chain))
                or self.attempt(self.chain)
            )

        def object_() -> bool:
            return self.open() and self.mark("ndAn", "nU") and (
                self.attempt(lambda: self.mark("sU") and self.delete() and self.maybe(self.plural_chain)) or self.attempt(lambda: self.mark("lArI"))
            )

        def from_() -> bool:
            def after() -> bool:
                return self.attempt(lambda: self.owned("possessive")) or self.attempt(lambda: self.cut("lAr") and self.maybe(self.chain)) or self.attempt(self.chain)

            return self.cut("DAn") and self.maybe(after)

        def with_() -> bool:
            def after() -> bool:
                return self.attempt(self.plural_chain) or self.attempt(lambda: self.owned("possessive", "sU")) or self.attempt(self.chain)

            return self.cut("nUn", "ylA") and self.maybe(after)

        def place() -> bool:
            def after() -> bool:
                self.open()
                found = self.attempt(lambda: self.mark("possessive") and self.delete() and self.maybe(lambda: self.open() and self.mark("lAr")))
                return (found or self.mark("lAr")) and self.delete() and self.chain()

            return self.cut("DA", "yU", "yA") and self.maybe(after)

        steps = (
            lambda: self.cut("lAr") and self.maybe(self.chain), like, inside, object_, from_, with_, lambda: self.cut("lArI"), self.chain, place,
            lambda: self.owned("possessive", "sU"),
        )
        return any(self.attempt(s) for s in steps)


def stem(word: str) -> str:
    if sum(c in V for c in word) < 2:
        return word
    x = _Word(word.split("'")[0])
    x.verb_suffixes()
    if not x.nouns:
        return x.w
    x.at = 0
    x.noun_suffixes()
    w = x.w
    if w in ("ad", "soyad"):
        return w
    if w.endswith(("d", "g")):
        last = next((c for c in reversed(w) if c in V), "")
        return w + {"a": "ı", "ı": "ı", "e": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}.get(last, "")
    return w[:-1] + {"b": "p", "c": "ç", "d": "t", "ğ": "k"}.get(w[-1:], w[-1:])
