"""Stemmers for fifteen languages, written from the published Snowball algorithm descriptions.

Each module has ``stem(token)``; tokens are lower-case runs of letters and digits. The empty token gives the empty stem.
"""

from __future__ import annotations


def after_vowel_consonant(word: str, vowels: str, start: int = 0) -> int:
    """The position after the first non-vowel that follows a vowel, from ``start`` on; the length if there is none."""
    i, n = start, len(word)
    while i < n and word[i] not in vowels:
        i += 1
    while i < n and word[i] in vowels:
        i += 1
    return i + 1 if i < n else n


def longest(word: str, suffixes, start: int = 0) -> str | None:
    """The longest of the suffixes that ends the word and lies at or after ``start``; the suffixes need no order."""
    found = None
    for s in suffixes:
        if word.endswith(s) and len(word) - len(s) >= start and (found is None or len(s) > len(found)):
            found = s
    return found


def marked_between_vowels(word: str, letters: str, vowels: str) -> str:
    """The letters, where they stand between vowels, in upper case."""
    chars = list(word)
    for i in range(1, len(chars) - 1):
        if chars[i] in letters and chars[i - 1] in vowels and chars[i + 1] in vowels:
            chars[i] = chars[i].upper()
    return "".join(chars)


def romance_rv(word: str, vowels: str) -> int:
    """RV of Spanish, Italian, Portuguese and Romanian."""
    n = len(word)
    if n < 2:
        return n
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, n) if word[i] in vowels), n)
    if word[0] in vowels:
        return next((i + 1 for i in range(2, n) if word[i] not in vowels), n)
    return min(3, n)
