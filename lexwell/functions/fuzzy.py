"""Token-set similarity of a query and a text."""

from __future__ import annotations

import numpy as np


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of the longer text."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        matched = row & at[c]
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """Similarity in percent: 100 for equal texts, by insertions and deletions over the sum of lengths."""
    if not a and not b:
        return 100
    if not a or not b:
        return 0
    if a == b:
        return 100
    return round(200 * longest_common(a, b) / (len(a) + len(b)))


class TokenSet:
    """A text that is compared with many queries: its words are found once.

    The ratio is the best of: common words against common words with the rest of the query, against common words with
    the rest of the text, and these two against each other. All three begin with the common words.
    """

    def __init__(self, text: str | None) -> None:
        self.words = frozenset((text or "").split())
        self.letters = sum(map(len, self.words))
        self._sorted: list[str] | None = None

    def ratio(self, query: str | None) -> int:
        asked = frozenset((query or "").split())
        common = asked & self.words
        if len(common) == len(asked) or len(common) == len(self.words):
            return 100  # one is part of the other; so are empty texts
        shared = sum(map(len, common))
        rest_a = sorted(asked - common)
        n_rest_a, n_rest_b = len(" ".join(rest_a)), self.letters - shared + len(self.words) - len(common) - 1
        if not common:
            return self._rests(rest_a, common, 0, 0, n_rest_a, n_rest_b)
        n = shared + len(common) - 1
        n_a, n_b = n + 1 + n_rest_a, n + 1 + n_rest_b
        least = max(round(200 * n / (n + n_a)), round(200 * n / (n + n_b)))
        return self._rests(rest_a, common, least, n + 1, n_a, n_b)

    def _rests(self, rest_a: list[str], common: frozenset[str], least: int, same: int, n_a: int, n_b: int) -> int:
        """The ratio of two texts of these lengths that begin with ``same`` equal characters, if it is above ``least``."""
        if round(200 * min(n_a, n_b) / (n_a + n_b)) <= least:
            return least  # no common subsequence is longer than the shorter text
        if self._sorted is None:
            self._sorted = sorted(self.words)
        a, b = " ".join(rest_a), " ".join(w for w in self._sorted if w not in common)
        return max(least, round(200 * (same + longest_common(a, b)) / (n_a + n_b)))

    def score(self, query: str | None) -> float:
        return self.ratio(query) / 100


def token_set_ratio(a: str, b: str) -> int:
    """The token-set ratio of two texts in percent."""
    return TokenSet(b).ratio(a)


def token_set_score(query: str | None, text: str | None) -> float:
    """Token-set ratio between 0 and 1; nulls count as empty."""
    return TokenSet(text).score(query)
