"""Text functions as columns: tokens, index terms, folding, trigrams. All stay in the JVM."""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"
TERM = r"[\p{L}\p{N}\p{Co}]+"
MARKS = r"\p{Mn}+"
DOTTED = "İ"  # its lower case is two characters, which no rule here wants


@lru_cache(maxsize=1)
def latin_accents() -> tuple[str, str]:
    """Lower-case accented Latin letters and their ASCII letters, as the index tokenizer folds them."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        base, *marks = ud.normalize("NFD", c)
        if marks and base.isascii() and base.isalpha() and all(ud.category(m) == "Mn" for m in marks) and c == c.lower():
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def all_accents() -> tuple[str, str]:
    """Lower-case letters of the BMP that decompose into one character and marks, and that character."""
    pairs = []
    for code in range(0xC0, 0xD800):
        c = chr(code)
        base, *marks = ud.normalize("NFD", c)
        if marks and all(ud.category(m) == "Mn" for m in marks) and ud.category(base) != "Mn" and c == c.lower():
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column) -> Column:
    """Runs of letters and decimal digits, lower-cased, in order, repeats kept, accents kept; null gives null."""
    pattern, zero = F.lit(WORD), F.lit(0)
    plain = F.regexp_extract_all(F.lower(text), pattern, zero)
    apart = F.transform(F.regexp_extract_all(text, pattern, zero), lambda t: F.replace(F.lower(t), F.lit("i̇"), F.lit(DOTTED)))
    return F.when(F.contains(text, F.lit(DOTTED)), apart).otherwise(plain)


def fold_terms(text: Column) -> Column:
    """Lower case without Latin accents and combining marks, as the index sees a text before it is cut into terms."""
    accented, plain = latin_accents()
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), MARKS, "")


def fold_terms_text(text: str) -> str:
    """``fold_terms`` of one string."""
    return "".join(c for c in text.lower().translate(_accents()) if ud.category(c) != "Mn")


@lru_cache(maxsize=1)
def _accents() -> dict[int, str]:
    return str.maketrans(*latin_accents())


def terms(text: Column) -> Column:
    """Index terms of a text: runs of letters, numbers and private-use characters of the folded text."""
    return F.regexp_extract_all(fold_terms(text), F.lit(TERM), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without any accent; separators stay. One character for one, but for removed marks."""
    accented, plain = all_accents()
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), MARKS, "")


def fold_text(text: str) -> str:
    """``fold`` of one string, also for letters that decompose into several characters."""
    return "".join(c for c in ud.normalize("NFD", text) if ud.category(c) != "Mn").lower().replace("i̇", "i")


class _Folded(dict):
    """Characters to what they are folded to, found when first asked for."""

    def __missing__(self, c: str) -> str:
        self[c] = fold_text(c)
        return self[c]


_FOLDED = _Folded()


def fold_with_map(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text and, for each of its characters, start and end of the character it came from."""
    parts = list(map(_FOLDED.__getitem__, text))
    if max(map(len, parts), default=1) == min(map(len, parts), default=1) == 1:
        return "".join(parts), list(range(len(parts))), list(range(1, len(parts) + 1))
    out, starts, ends = [], [], []
    for i, part in enumerate(parts):
        for f in part:
            out.append(f)
            starts.append(i)
            ends.append(i + 1)
    return "".join(out), starts, ends


def trigrams(text: Column) -> Column:
    """Windows of three characters of the lower-cased text, in order; empty for shorter texts, null for null.

    The text is cut into characters, and these are zipped with themselves from the second and the third on. Taking
    substrings by position would read the text from its start each time.
    """
    c = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))

    def joined(a: Column, b: Column) -> Column:
        return F.concat(a, b)  # null, and dropped below, where the longer array goes on

    return F.array_compact(F.zip_with(F.zip_with(c, F.slice(c, 2, 1 << 30), joined), F.slice(c, 3, 1 << 30), joined))


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters; the whole text if ``most`` is 0."""
    return F.substring(text, 1, most) if most > 0 else text


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the BMP count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text``, overlaps counted (a look-ahead finds each start once); 0 if it is empty."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(F.length(part) > 0, F.regexp_count(text, quoted)).otherwise(0)
