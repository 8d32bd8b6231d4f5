"""Phonetic codes: Kölner Phonetik for German, Double Metaphone (primary code) for English."""

from __future__ import annotations

import re

# The published rules of the Kölner Phonetik, in order; each replaces letters by code digits.
KOELNER_RULES = tuple(
    (re.compile(pattern), code)
    for pattern, code in (
        (r"[dt](?=[csz])", "8"), (r"[dt]", "2"), (r"p(?=h)", "3"), (r"[bp]", "1"), (r"[fvw]", "3"), (r"(?<=[ckq])x", "8"), (r"x", "48"),
        (r"^c(?=[ahkloqrux])", "4"), (r"(?<=[sz])c", "8"), (r"(?<=.)c(?=[ahkoqux])", "4"), (r"c", "8"), (r"[gkq]", "4"), (r"l", "5"), (r"[mn]", "6"),
        (r"r", "7"), (r"[sz]", "8"), (r"[aeijouy]", "0"),
    )
)


def koelner(token: str) -> str | None:
    """The code of a token; null if no letter of it has one."""
    word = re.sub(r"[^a-z]", lambda m: {"ä": "a", "ö": "o", "ü": "u", "ß": "s"}.get(m.group(), "?"), token.lower())
    codes = [""] * len(word)
    for pattern, code in KOELNER_RULES:
        for m in pattern.finditer(word):
            codes[m.start()] = codes[m.start()] or code
    digits = re.sub(r"(.)\1+", r"\1", "".join(codes))
    return (digits[:1] + digits[1:].replace("0", "")) or None


class _Metaphone:
    """Philips' rules; each letter's method gives (code, letters used)."""

    VOWELS = "AEIOUY"

    def __init__(self, word: str) -> None:
        self.w, self.n = word.upper(), len(word)
        self.slavic = any(s in self.w for s in ("W", "K", "CZ", "WITZ"))
        self.germanic = self.w.startswith(("VAN ", "VON ", "SCH"))

    def at(self, i: int, *parts: str) -> bool:
        return i >= 0 and any(self.w.startswith(p, i) for p in parts)

    def vowel(self, i: int) -> bool:
        return 0 <= i < self.n and self.w[i] in self.VOWELS

    def code(self, most: int = 4) -> str:
        out, i = "", 1 if self.at(0, "GN", "KN", "PN", "WR", "PS") else 0
        if self.at(0, "X"):
            out, i = "S", 1
        while i < self.n and len(out) < most:
            code, used = self.letter(i)
            out += code
            i += used
        return out[:most]

    SIMPLE = {"B": "P", "F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}

    def letter(self, i: int) -> tuple[str, int]:
        c = self.w[i]
        if c in self.VOWELS:
            return ("A" if i == 0 else ""), 1
        if c in self.SIMPLE:
            return self.SIMPLE[c], 2 if self.at(i + 1, c) else 1
        if c == "Ç":
            return "S", 1
        if c == "Ñ":
            return "N", 1
        rule = getattr(self, f"_{c.lower()}", None) if c.isascii() else None
        return rule(i) if rule else ("", 1)

    def _c(self, i: int) -> tuple[str, int]:
        if i > 1 and not self.vowel(i - 2) and self.at(i - 1, "ACH") and not self.at(i + 2, "I") and (not self.at(i + 2, "E") or self.at(i - 2, "BACHER", "MACHER")):
            return "K", 2
        if i == 0 and self.at(i, "CAESAR"):
            return "S", 2
        if self.at(i, "CHIA"):
            return "K", 2
        if self.at(i, "CH"):
            if i > 0 and self.at(i, "CHAE"):
                return "K", 2
            if i == 0 and self.at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not self.at(0, "CHORE"):
                return "K", 2
            hard = self.germanic or self.at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or self.at(i + 2, "T", "S")
            before = i == 0 or self.at(i - 1, "A", "O", "U", "E")
            if hard or before and (i + 2 >= self.n or self.at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W")):
                return "K", 2
            return ("K" if self.at(0, "MC") else "X"), 2
        if self.at(i, "CZ") and not self.at(i - 2, "WICZ"):
            return "S", 2
        if self.at(i + 1, "CIA"):
            return "X", 3
        if self.at(i, "CC") and not (i == 1 and self.w[0] == "M"):
            if self.at(i + 2, "I", "E", "H") and not self.at(i + 2, "HU"):
                return ("KS" if i == 1 and self.w[0] == "A" or self.at(i - 1, "UCCEE", "UCCES") else "X"), 3
            return "K", 2
        if self.at(i, "CK", "CG", "CQ"):
            return "K", 2
        if self.at(i, "CI", "CE", "CY"):
            return "S", 2
        if self.at(i + 1, " C", " Q", " G"):
            return "K", 3
        return "K", 2 if self.at(i + 1, "C", "K", "Q") and not self.at(i + 1, "CE", "CI") else 1

    def _d(self, i: int) -> tuple[str, int]:
        if self.at(i, "DG"):
            return ("J", 3) if self.at(i + 2, "I", "E", "Y") else ("TK", 2)
        return "T", 2 if self.at(i, "DT", "DD") else 1

    def _g(self, i: int) -> tuple[str, int]:
        if self.at(i + 1, "H"):
            if i > 0 and not self.vowel(i - 1):
                return "K", 2
            if i == 0:
                return ("J" if self.at(2, "I") else "K"), 2
            if i > 1 and self.at(i - 2, "B", "H", "D") or i > 2 and self.at(i - 3, "B", "H", "D") or i > 3 and self.at(i - 4, "B", "H"):
                return "", 2
            if i > 2 and self.w[i - 1] == "U" and self.at(i - 3, "C", "G", "L", "R", "T"):
                return "F", 2
            return ("K" if self.w[i - 1] != "I" else ""), 2
        if self.at(i + 1, "N"):
            if i == 1 and self.vowel(0) and not self.slavic:
                return "KN", 2
            return ("N" if not self.at(i + 2, "EY") and not self.at(i + 1, "Y") and not self.slavic else "KN"), 2
        if self.at(i + 1, "LI") and not self.slavic:
            return "KL", 2
        if i == 0 and self.at(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
            return "K", 2
        if self.at(i + 1, "ER", "Y") and not self.at(0, "DANGER", "RANGER", "MANGER") and not self.at(i - 1, "E", "I", "RGY", "OGY"):
            return "K", 2
        if self.at(i + 1, "E", "I", "Y") or self.at(i - 1, "AGGI", "OGGI"):
            return ("K" if self.germanic or self.at(i + 1, "ET") else "J"), 2
        return "K", 2 if self.at(i + 1, "G") else 1

    def _h(self, i: int) -> tuple[str, int]:
        return ("H", 2) if (i == 0 or self.vowel(i - 1)) and self.vowel(i + 1) else ("", 1)

    def _j(self, i: int) -> tuple[str, int]:
        if self.at(i, "JOSE") or self.at(0, "SAN "):
            return "H", 1
        used = 2 if self.at(i + 1, "J") else 1
        if i == 0 or self.vowel(i - 1) and not self.slavic and self.at(i + 1, "A", "O") or i == self.n - 1:
            return "J", used
        spoken = not self.at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not self.at(i - 1, "S", "K", "L")
        return ("J" if spoken else ""), used

    def _l(self, i: int) -> tuple[str, int]:
        return "L", 2 if self.at(i + 1, "L") else 1

    def _m(self, i: int) -> tuple[str, int]:
        silent = self.at(i - 1, "UMB") and (i + 1 == self.n - 1 or self.at(i + 2, "ER"))
        return "M", 2 if silent or self.at(i + 1, "M") else 1

    def _p(self, i: int) -> tuple[str, int]:
        if self.at(i + 1, "H"):
            return "F", 2
        return "P", 2 if self.at(i + 1, "P", "B") else 1

    def _r(self, i: int) -> tuple[str, int]:
        silent = i == self.n - 1 and not self.slavic and self.at(i - 2, "IE") and not self.at(i - 4, "ME", "MA")
        return ("" if silent else "R"), 2 if self.at(i + 1, "R") else 1

    def _s(self, i: int) -> tuple[str, int]:
        if self.at(i - 1, "ISL", "YSL"):
            return "", 1
        if i == 0 and self.at(0, "SUGAR"):
            return "X", 1
        if self.at(i, "SH"):
            return ("S" if self.at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
        if self.at(i, "SIO", "SIA"):
            return ("X" if not self.slavic else "S"), 3
        if i == 0 and self.at(1, "M", "N", "L", "W") or self.at(i + 1, "Z"):
            return "S", 2 if self.at(i + 1, "Z") else 1
        if self.at(i, "SC"):
            if self.at(i + 2, "H"):
                if self.at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                    return ("X" if self.at(i + 3, "ER", "EN") else "SK"), 3
                return "X", 3
            return ("S" if self.at(i + 2, "I", "E", "Y") else "SK"), 3
        silent = i == self.n - 1 and self.at(i - 2, "AI", "OI")
        return ("" if silent else "S"), 2 if self.at(i + 1, "S", "Z") else 1

    def _t(self, i: int) -> tuple[str, int]:
        if self.at(i, "TION", "TIA", "TCH"):
            return "X", 3
        if self.at(i, "TH", "TTH"):
            return ("T" if self.at(i + 2, "OM", "AM") or self.germanic else "0"), 2
        return "T", 2 if self.at(i + 1, "T", "D") else 1

    def _w(self, i: int) -> tuple[str, int]:
        if self.at(i, "WR"):
            return "R", 2
        if i == 0 and (self.vowel(1) or self.at(0, "WH")):
            return "A", 1
        if i == self.n - 1 and self.vowel(i - 1) or self.at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or self.at(0, "SCH"):
            return "", 1
        return ("TS", 4) if self.at(i, "WICZ", "WITZ") else ("", 1)

    def _x(self, i: int) -> tuple[str, int]:
        silent = i == self.n - 1 and (self.at(i - 3, "IAU", "EAU") or self.at(i - 2, "AU", "OU"))
        return ("" if silent else "KS"), 2 if self.at(i + 1, "C", "X") else 1

    def _z(self, i: int) -> tuple[str, int]:
        return ("J", 2) if self.at(i + 1, "H") else ("S", 2 if self.at(i + 1, "Z") else 1)


def double_metaphone(token: str) -> str | None:
    """The primary code of up to four letters; null if nothing in the token has one."""
    return _Metaphone(token).code() or None
