"""Problem 5: text decoded with another character encoding than it was written in.

Method: best-first search over encode, decode and unescape operations. A state is a list of words; an operation writes
all of them in one single-byte encoding and reads the bytes as another encoding, or undoes a character escape. The
frontier is ordered by how implausible the characters of a state are plus a price per operation; a state is entered again
only if it is reached in a better way, and may be entered though it looks worse than the one before it. The search ends when
bounds show that no state left can lead to a cheaper one. The cheapest state that is reached is the restored text.

The search runs on the words of a text that do not fit the language of the text, together, so that short words are
restored by what longer ones prove; the operations found are then applied to every word of the text they bring nearer to
its language. Words that are garbled in another way than the text are searched for each by itself.

Plausibility comes from labelled samples of the languages in use: a non-ASCII character is plausible if a sample of
some language has it between the same neighbours, less so if it only has the character, and implausible otherwise.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata as ud
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.llm.canonical import canonical
from lexwell.llm.common import ship

# Python's names of the encodings between which a text may have been confused.
ENCODINGS = (
    "latin_1", "cp1252", "cp850", "cp437", "mac_roman", "cp1251", "koi8_r", "cp866", "iso8859_2", "cp1250", "cp852",
    "iso8859_9", "cp1254", "iso8859_15", "iso8859_16", "iso8859_5", "mac_cyrillic", "cp1253", "cp1257",
)
# Signs that any text may hold.
SIGNS = frozenset("§°±×µμ€–—‘’‚“”„…«»‹›¿¡№²³½•‑‐ £")

# A no-break space ends a word, except where it may be the second byte of a letter read as two characters.
_WORD = re.compile(r"(?:[^ \n\t\r\xa0]|(?<=[ÃÂÐÑРСÄÅĂГ])\xa0)+")
# Characters that no byte of a misread letter gives here: other scripts, spaces and soft hyphens that stand alone.
_ODD = re.compile(r"[\u0300-\U0010ffff]|(?<![ÃÂÐÑРСÄÅĂГ├┬])[\xa0\xad]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_PAIR = re.compile(r"[ÂÃÄÅÐÑРСВГ├┬][^\w\s.,;:!?()'\"-]|[ÂÃÄÅ├┬][\xa0\xad]")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+")  # quoted-printable bytes
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UTF7 = re.compile(r"\+[A-Za-z0-9+/]{2,}-")
# Scripts without their letters; the blocks between them hold typographic signs, which any text may hold.
_FOREIGN = re.compile(r"[\u0370-\u1fff\u2c00-\u2dff\u3040-\ufe0f\U00010000-\U0010ffff]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_ESCAPED = re.compile(r"\\[ux]|&#?\w+;|=[89A-F][0-9A-F]|%[89A-Fa-f][0-9A-Fa-f]|\+A[A-Za-z0-9+/]{2,}-")
# All letters of Cyrillic text are non-ASCII, most of them between neighbours that some sample has: one that is not says more.
SCRIPT_WEIGHT = {"ru": 4.0}
_SEPARATE, _READ = 1.0, 0.25  # the price of reading bytes as a single-byte encoding, as UTF-8


def _both_ways(name: str) -> tuple[dict[int, str], dict[int, str]]:
    """(character to byte, byte to character) as latin-1 strings; bytes that the encoding leaves open stay as they are."""
    to, back = {}, {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        back[b] = c
        to.setdefault(ord(c), chr(b))
    return to, back


_TABLES = {name: _both_ways(name) for name in ENCODINGS}
_WRITABLE = frozenset(chr(c) for to, _ in _TABLES.values() for c in to if c > 127)


_ALLOWED = {name: frozenset(map(chr, to)) for name, (to, _) in _TABLES.items()}


def _encode(text: str, encoding: str) -> bytes | None:
    return text.translate(_TABLES[encoding][0]).encode("latin_1") if _ALLOWED[encoding].issuperset(text) else None


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


@dataclass
class Plausibility:
    """What the samples say about characters between their neighbours, by language."""

    letters: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    pairs: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    triples: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    spoken: dict[str, list[str]] = field(default_factory=dict)
    _parts: dict[str, tuple[float, dict[str, float]]] = field(default_factory=dict)
    _vectors: dict[str, np.ndarray] = field(default_factory=dict)
    _floors: dict[str, np.ndarray | float] = field(default_factory=dict)
    _names: list[str] | None = None

    @classmethod
    def learn(cls, samples: Iterable[tuple[str, str]]) -> "Plausibility":
        self = cls()
        for language, text in samples:
            for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
                listed = self.spoken.setdefault(word, [])
                if language not in listed:
                    listed.append(language)
                if word.isascii():
                    continue
                w = f" {word} "
                for i, c in enumerate(word, 1):
                    if c > "\x7f":
                        self.letters[language].add(c)
                        self.pairs[language].update((w[i - 1 : i + 1], w[i : i + 2]))
                        self.triples[language].add(w[i - 1 : i + 2])
        return self

    def parts(self, word: str) -> tuple[float, dict[str, float]]:
        """How implausible the non-ASCII characters of a word are: what no language matters for, and the letters by language."""
        if word not in self._parts:
            if len(self._parts) >= 300_000:
                self._parts.clear()
            self._parts[word] = self._weigh(word)
        return self._parts[word]

    def _weigh(self, word: str) -> tuple[float, dict[str, float]]:
        if word.isascii():
            return 0.0, {}
        rest, letters = 0.0, []
        padded = f" {word} "
        lower = padded.lower()
        if len(lower) != len(padded):
            lower = padded
        for i in range(1, len(padded) - 1):
            c = padded[i]
            if c < "\x80":
                if "A" <= c <= "Z" and "\x7f" < padded[i - 1] and padded[i - 1].islower():
                    rest += 1.0
                continue
            before, after = padded[i - 1], padded[i + 1]
            if c < "\xa0":
                rest += 6.0
            elif c.isalpha() and c not in "ªº" and c not in SIGNS:
                letters.append((lower[i], lower[i - 1], lower[i + 1]))
                if c.isupper() and before.islower():
                    rest += 2.0
                rest += 0.1
            elif c in SIGNS:
                rest += 0.1 + 2.0 * (before.isalpha() or before > "\x7f") * (after.isalpha() or after > "\x7f") * (c not in "’‑‐–—‘")
                if c in "€„…‚‹›“”•" and before.isalpha() and before > "\x7f":
                    rest += 2.0
                if c in "§°±" and before.isalpha() and before > "\x7f":
                    rest += 1.0
            elif c in _WRITABLE and c not in "\xa0\xad":
                rest += 3.0
            elif c in "\xa0\xad":
                rest += 3.0 if before.isalpha() and after.isalpha() else 0.2
            elif ud.category(c) in ("Mn", "Co", "Cn", "So", "Sk") or _FOREIGN.match(c):
                rest += 4.0
            else:
                rest += 0.2
        if not letters:
            return rest, {}
        if (foreign := sum(c > "\u036f" for c, _, _ in letters)) and (own := sum("a" <= c <= "z" or "\xc0" <= c < "\u0250" for c in lower)):
            rest += 2.0 * min(foreign, own)  # two scripts in one word
        around = [(c, b if b.isalpha() else " ", a if a.isalpha() else " ") for c, b, a in letters]
        by = {}
        for language in self.letters:
            known, pairs, triples, total = self.letters[language], self.pairs[language], self.triples[language], 0.0
            for c, b, a in around:
                if c not in known:
                    total += 4.0 if c < "ɐ" or "Ͱ" <= c < "԰" else 6.0
                elif b + c + a in triples:
                    continue
                elif "Ѐ" <= c < "԰":
                    total += 0.1 if b + c in pairs and c + a in pairs else 0.2
                else:
                    total += 0.4 if b + c in pairs and c + a in pairs else 1.0
            by[language] = total
        return rest, by or {"": 4.0 * len(letters)}

    def cost(self, word: str) -> float:
        """How implausible the non-ASCII characters of a word are in the language they fit best; 0 for ASCII."""
        rest, by = self.parts(word)
        return rest + (min(by.values()) if by else 0.0)

    def cost_in(self, word: str, language: str) -> float:
        """The same in one language; letters of a language written in another script than Latin count by their neighbours."""
        rest, by = self.parts(word)
        return rest + SCRIPT_WEIGHT.get(language, 1.0) * by.get(language, 0.0)

    def vector(self, word: str) -> np.ndarray:
        """``cost_in`` of a word for each language, in the order of ``languages``."""
        found = self._vectors.get(word)
        if found is None:
            if len(self._vectors) >= 300_000:
                self._vectors.clear()
            rest, by = self.parts(word)
            found = self._vectors[word] = np.array([rest + SCRIPT_WEIGHT.get(l, 1.0) * by.get(l, 0.0) for l in self.languages])
        return found

    def floor(self, text: str) -> np.ndarray | float:
        """What the words of a text cost at least for each language, whatever stands beside their characters."""
        total: np.ndarray | float = 0.0
        for c in text:
            if c > "\x7f":
                if c not in self._floors:
                    self._floors[c] = self._floor(c)
                total = total + self._floors[c]
        return total

    def _floor(self, c: str) -> np.ndarray | float:
        if c < "\xa0":
            return 6.0
        if c.isalpha() and c not in "ªº" and c not in SIGNS:
            return np.array([
                0.1 + (0.0 if c in self.letters[l] or c.lower() in self.letters[l] else 4.0 * SCRIPT_WEIGHT.get(l, 1.0)) for l in self.languages
            ])
        return 3.0 if c in _WRITABLE and c not in SIGNS and c not in "\xa0\xad" else 0.1

    @property
    def languages(self) -> list[str]:
        if self._names is None:
            self._names = sorted(self.letters)
        return self._names

    def votes(self, words: Iterable[str]) -> dict[str, float]:
        """For each language how many of these words its samples have; a word of several languages counts for each in part."""
        out: dict[str, float] = {}
        for w in words:
            listed = self.spoken.get(w.lower())
            if listed:
                for language in listed:
                    out[language] = out.get(language, 0.0) + 1 / len(listed)
        return out

    def fits(self, word: str) -> dict[str, int]:
        """For each language, how many non-ASCII letters of a word it has between the same neighbours."""
        out: dict[str, int] = {}
        w = f" {word.lower()} "
        for i, c in enumerate(w):
            if c > "\x7f" and c.isalpha():
                around = "".join(x if x.isalpha() else " " for x in w[i - 1 : i + 2])
                for language, triples in self.triples.items():
                    if around in triples:
                        out[language] = out.get(language, 0) + 1
        return out

    def explains(self, word: str, other: str, language: str) -> bool:
        """Whether the letters that differ fit the language in ``other`` and do not in ``word``."""
        before, after = f" {word.lower()} ", f" {other.lower()} "
        changed = [i for i, (x, y) in enumerate(zip(before, after)) if x != y]
        if len(before) != len(after) or len(word) != len(other) or len(before) != len(word) + 2 or not changed or any(c > "\x7f" and not c.isalpha() for c in other):
            return False
        # A misread letter keeps its case, or a whole word changes it; names and words of other languages seldom do.
        turned = sum(before_c.isupper() != after_c.isupper() for before_c, after_c in ((word[i - 1], other[i - 1]) for i in changed))
        if turned and turned < max(4, 0.8 * len(changed)):
            return False
        known = self.triples.get(language, frozenset())

        def fitting(w: str) -> int:
            return sum("".join(x if x.isalpha() else " " for x in w[i - 1 : i + 2]) in known for i in changed)

        return fitting(before) <= 0.2 * len(changed) and fitting(after) >= 0.8 * len(changed)


@dataclass(frozen=True)
class Restored:
    text: str
    gain: float
    steps: tuple[str, ...]

    @property
    def decoded(self) -> bool:
        return any(s != "unescape" for s in self.steps)

    @property
    def utf8(self) -> bool:
        return _is_utf8(self.steps)


def _bytes_of(escaped: str, sign: str) -> str:
    data = bytes.fromhex(escaped.replace(sign, ""))
    text = _utf8(data)
    return data.decode("latin_1") if text is None else text


def _utf7(m: re.Match) -> str:
    try:
        return m.group().encode("ascii").decode("utf-7")
    except UnicodeDecodeError:
        return m.group()


# Character escapes: a sign the text must hold, and what undoes the escape.
_UNESCAPES = (
    ("&", html.unescape),
    ("\\", lambda t: _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), t)),
    ("=", lambda t: _QUOTED.sub(lambda m: _bytes_of(m.group(), "="), t)),
    ("%", lambda t: _PERCENT.sub(lambda m: _bytes_of(m.group(), "%"), t)),
    ("+", lambda t: _UTF7.sub(_utf7, t)),
)
State = tuple[str, ...]


def _moves(words: State) -> Iterator[tuple[str, State, float]]:
    """(operation, next state, price), cheap ones first; equal bytes and equal states come once."""
    for sign, undo in _UNESCAPES:
        if any(sign in w for w in words) and (t := tuple(undo(w) if sign in w else w for w in words)) != words:
            yield "unescape", t, _READ
    if all(map(str.isascii, words)):
        return
    written: dict[tuple[bytes, ...], str] = {}
    for encoding in ENCODINGS:
        data = []
        for w in words:
            if (d := _encode(w, encoding)) is None:
                break
            data.append(d)
        else:
            written.setdefault(tuple(data), encoding)
    for data, encoding in written.items():
        read = list(map(_utf8, data))
        if 2 * read.count(None) < len(read):  # a word that was garbled otherwise stays
            yield f"{encoding}>utf-8", tuple(w if r is None else r for w, r in zip(words, read)), _READ
    done = {words}
    for data, encoding in written.items():
        plain = [d.decode("latin_1") for d in data]
        for other in ENCODINGS:
            if other != encoding and (t := tuple(p.translate(_TABLES[other][1]) for p in plain)) not in done:
                done.add(t)
                yield f"{encoding}>{other}", t, _SEPARATE


def _applied(word: str, steps: tuple[str, ...]) -> str | None:
    """A word after these operations; null where one of them cannot be applied."""
    for step in steps:
        if step == "unescape":
            for sign, undo in _UNESCAPES:
                word = undo(word) if sign in word else word
            continue
        encoding, other = step.split(">")
        data = _encode(word, encoding)
        if data is None:
            return None
        word = _utf8(data) if other == "utf-8" else data.decode("latin_1").translate(_TABLES[other][1])
        if word is None:
            return None
    return word


def _letters(words: State) -> int:
    return sum(sum(map(str.isalpha, w)) for w in words)


def _least(n: int, readable: bool) -> float:
    """What a state of ``n`` non-ASCII characters, and any reached from it, costs at least, with the prices of readings as UTF-8.

    A character costs 0.1 or more, operations on single bytes keep their number, escapes add to it, and reading as UTF-8
    makes one of up to four.
    """
    least, paid = 0.1 * n, 0.0
    while readable and n > 1:
        n, paid = -(-n // 4), paid + _READ
        least = min(least, paid + 0.1 * n)
    return least


def _readable(words: State) -> bool:
    """Whether an escape can be undone, or the words can be UTF-8 in some encoding, be it after operations on single bytes.

    Those replace equal characters by equal ones, and UTF-8 has other bytes first in a letter than after that.
    """
    if any(sign in w for sign, _ in _UNESCAPES for w in words):
        return True
    no = 0
    for w in words:
        runs = _RUN.findall(w)
        first = {r[0] for r in runs}
        no += any(len(r) < 2 or r[1] in first or r[-1] in first for r in runs)
    return 2 * no < len(words)


def best_first(
    words: State, cost, max_steps: int, max_states: float = math.inf, slack: float = math.inf, below: float = math.inf, floor=None
) -> tuple[float, State, tuple[str, ...]]:
    """(total, state, operations) of the cheapest state that is reached in ``max_steps`` operations; ``cost`` of a state, to
    which the prices paid are added, is 0.1 or more for each of its non-ASCII characters, and ``floor`` of it if that is given.

    The search ends when no state that waits can lead to a cheaper one, or to one ``below`` which a caller has use for. A
    caller may end it earlier: after ``max_states`` states, or when all that wait look worse than the first by more than
    ``slack``.
    """
    start = cost(words)
    best, limit, number, entered = (start, words, ()), min(start, below), 0, 0
    # The ways a state was reached: price, letters before its bytes were confused, confusions, operations. A way that is
    # better in none of them than one before is not entered.
    seen: dict[State, list[tuple[float, int, int, int]]] = {words: [(0.0, _letters(words), 0, 0)]}
    frontier: list[tuple[float, int, State, float, int, int, tuple[str, ...]]] = [(start, 0, words, 0.0, _letters(words), 0, ())]

    def hopeless(n: int, paid: float, lost: int, confused: int, readable: bool) -> tuple[bool, bool]:
        """Whether no reading as UTF-8 or undone escape, and no reading as single bytes, can lead from here below the limit."""
        least = _least(n, readable)
        reading = not readable or paid + lost + _READ + _least(-(-n // 4), True) >= limit
        return reading, paid + _SEPARATE + 1.5 * confused + least >= limit

    while frontier and entered < max_states:
        total, _, state, paid, letters, confused, steps = heapq.heappop(frontier)
        if total > start + slack:
            break  # the frontier is ordered
        n, readable, lost = sum(c > "\x7f" for w in state for c in w), _readable(state), max(0, letters - _letters(state))
        no_reading, no_single = hopeless(n, paid, lost, confused, readable)
        if no_reading and no_single:
            continue
        entered += 1
        for step, following, price in _moves(state):
            separate = price == _SEPARATE
            if separate and no_single:
                break  # cheap ones came first
            # Confusions of single bytes beside another confusion are rarer than one.
            reached = paid + price + (0.0 if step == "unescape" else 1.5 * confused) + (0.0 if separate else lost)
            left, can = (n, readable) if separate else (sum(c > "\x7f" for w in following for c in w), _readable(following))
            if reached + _least(left, can) >= limit:
                continue
            now = _letters(following)
            before, taken = letters if separate else now, (*steps, step)
            way = reached, before, confused + separate, len(taken)
            ways = seen.setdefault(following, [])
            if any(all(x <= y for x, y in zip(other, way)) for other in ways):
                continue
            ways.append(way)
            signs = max(0, before - now)  # letters seldom become signs
            enter = len(taken) < max_steps and not all(hopeless(left, reached, signs, way[2], can))
            if not enter and floor is not None and reached + signs + floor(following) >= limit:
                continue
            after = reached + signs + cost(following)
            number += 1
            if after < limit:
                best, limit = (after, following, taken), after
            if enter:
                heapq.heappush(frontier, (after, number, following, reached, before, way[2], taken))
    return best


class Repair:
    """Best-first repair of words, and of texts by their words; keeps what it found for each distinct word."""

    def __init__(self, plausible: Plausibility, max_steps: int = 4, cache: int = 300_000, sample: int = 6) -> None:
        self.plausible, self.max_steps, self.cache, self.sample = plausible, max_steps, cache, sample
        self.known: dict[str, Restored | None] = {}
        self._usual: set[str] | None = None
        self.fit: dict[str, dict[str, int]] = {}
        self.readings: dict[tuple[str, str], dict[str, str]] = {}

    def word(self, word: str) -> Restored | None:
        """The cheapest reachable form of a word, or None if no form is cheaper than the word itself."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[word] = found = self._search(word)
        return found

    def _search(self, word: str) -> Restored | None:
        start = self.plausible.cost(word)
        if start < 0.9 and not _ESCAPED.search(word):
            return None
        odd = _ODD.search(word) and self.plausible.cost(canonical(word) or "") < max(1.5, 0.5 * start)
        if odd and not any(_is_utf8((step,)) for step, _, _ in takewhile(lambda m: m[2] == _READ, _moves((word,)))):
            return None  # as below, without a search
        total, state, steps = best_first((word,), lambda s: self.plausible.cost(s[0]), self.max_steps)
        if odd:
            known = all(c < "\x80" or c in SIGNS or any(c.lower() in letters for letters in self.plausible.letters.values()) for c in state[0])
            if len(steps) != 1 or not _is_utf8(steps) or not known:
                return None  # odd characters, not a wrong encoding
        if not steps and not word.isascii():
            return None
        if not steps:  # an escape in ASCII costs nothing by itself; undone, it must give plausible text
            plain = _applied(word, ("unescape",))
            return Restored(plain, 0.0, ("unescape",)) if plain != word and self.plausible.cost(plain) < 0.9 else None
        return Restored(state[0], start - total, steps)

    def together(self, words: list[str], said: Callable[[], dict[str, float]]) -> tuple[str, ...]:
        """The operations that restore a text with these distinct words, found on those that fit its language least; () if none do.

        A language is as near as the words its samples have. Operations are accepted if they take most of the cost of at
        least two words, or of two letters, away.
        """
        odd = [w for w in words if not w.isascii()]
        languages = self.plausible.languages
        if len(odd) < 2 or not languages:
            return ()
        total = sum(self.plausible.vector(w) for w in odd)
        if total.min() < 0.9:
            return ()  # some language has it all
        votes = said()
        most = max(votes.values(), default=0.0)
        prior = np.array([0.0 if most < 3 else 1.5 * (1 - votes.get(l, 0.0) / most) for l in languages])

        def cost(state: State) -> float:
            return float((prior + sum(self.plausible.vector(w) for w in state)).min())

        near = int((prior + total).argmin())
        weights = {w: float(self.plausible.vector(w)[near]) for w in odd}
        worst = sorted((w for w in odd if weights[w] >= 0.9 and len(w) < 60), key=lambda w: (-weights[w] / len(w), w))[: self.sample]
        if len(worst) < 2 or 2 * sum(v >= 0.9 for v in weights.values()) < len(odd):
            return ()
        if all(_ODD.search(w) and self.plausible.cost(canonical(w) or "") < 1.5 for w in worst):
            return ()
        def floor(state: State) -> float:
            return float((prior + self.plausible.floor("".join(state))).min()) - 1e-9

        state = tuple(worst)
        start = cost(state)
        useful = min(0.5 * start, start - 3.0)
        _, _, steps = best_first(state, cost, self.max_steps, below=math.nextafter(useful, math.inf), floor=floor)
        if not steps or all(s == "unescape" for s in steps):
            return ()
        return steps

    def _readings(self, word: str, language: str) -> dict[str, str]:
        """The single-byte readings of a word that the language explains."""
        key = word, language
        if key not in self.readings:
            if len(self.readings) >= self.cache:
                self.readings.clear()
            moves = _moves((word,)) if len(word) < 40 else ()
            self.readings[key] = {step: t for step, (t,), price in moves if price == _SEPARATE and self.plausible.explains(word, t, language)}
        return self.readings[key]

    def _explained(self, words: list[str], said: Callable[[], dict[str, float]]) -> dict[str, Restored]:
        """The words of a text that one single-byte reading brings to letters of the text's language, if it does so for half
        of the words that do not fit the language; how many they are does not matter."""
        if not words:
            return {}
        total: dict[str, float] = defaultdict(float, said())
        for w in words:
            if w not in self.fit:
                if len(self.fit) >= self.cache:
                    self.fit.clear()
                self.fit[w] = self.plausible.fits(w)
            for language, n in self.fit[w].items():
                total[language] += n
        if not total:
            return {}
        language = max(sorted(total), key=total.__getitem__)
        letters = self.plausible.letters.get(language, frozenset())
        odd = [w for w in words if self.known.get(w) or any(c > "\x7f" and c.isalpha() and c not in letters for c in w.lower())]
        ways: dict[str, dict[str, str]] = defaultdict(dict)
        for w in odd:
            for step, t in self._readings(w, language).items():
                ways[step][w] = t
        if not ways:
            return {}
        step = max(ways, key=lambda k: len(ways[k]))
        letters_read = sum(x != y for w, t in ways[step].items() for x, y in zip(w, t))
        if 2 * len(ways[step]) < len(odd) or letters_read < 2 and not any(self.known.get(w) for w in ways[step]):
            return {}  # a single letter that another language has is a name or a foreign word
        return {w: Restored(t, 0.0, (step,)) for w, t in ways[step].items()}

    def suspicious(self, text: str) -> bool:
        """A quick test for texts that may be garbled: characters no sample has, or a letter that begins a pair misread from UTF-8."""
        if self._usual is None:
            letters = set().union(*self.plausible.letters.values()) if self.plausible.letters else set()
            self._usual = letters | {c.upper() for c in letters} | SIGNS | set(map(chr, range(128)))
        return not self._usual.issuperset(text) or _PAIR.search(text) is not None

    def _restored(self, text: str, words: set[str], chain: tuple[str, ...]) -> tuple[str, str]:
        """(text, operations): each word by these operations where they bring it nearer to the language, else by its own."""
        odd = [w for w in words if not w.isascii()]
        moved = {w: m for w in odd if (m := _applied(w, chain)) is not None}
        language = min(self.plausible.letters, key=lambda l: (sum(self.plausible.cost_in(moved.get(w, w), l) for w in odd), l))
        cost, spoken = self.plausible.cost_in, self.plausible.spoken
        nearer = sum(cost(moved[w], language) < cost(w, language) for w in moved)
        whole = nearer >= 0.7 * len(odd)  # then words that say nothing by themselves follow the others
        right = set() if 5 * sum(w.lower() in spoken for w in odd) < len(odd) else spoken
        use, steps = {}, set(chain)
        for w in odd:
            before = cost(w, language)
            if w in moved and cost(moved[w], language) - before < (1.0 if whole and w.lower() not in right else 0.0):
                use[w] = moved[w]
            elif before >= 0.9 and (own := self.word(w)) is not None and own.utf8:
                use[w] = own.text
                steps |= set(own.steps)
        return _WORD.sub(lambda m: use.get(m.group(), m.group()), text), ",".join(sorted(steps))

    def text(self, text: str | None) -> tuple[bool, str | None, str]:
        """(affected, restored text, operations) of one text.

        A text is affected if it holds replacement characters or C1 controls, if a word of it becomes plausible when
        read as UTF-8, if the words that one other single-byte reading makes plausible gain enough together, or if such a
        reading explains the words that do not fit the language of the text, be it one. Null and ASCII texts are not
        affected. What was lost (replacement characters) stays.
        """
        if text is None or text.isascii() and not _ESCAPED.search(text):
            return False, text, ""
        found, by_steps, strong = {}, defaultdict(float), "�" in text
        words = set(_WORD.findall(text))
        known: list[dict[str, float]] = []

        def said() -> dict[str, float]:
            """The languages of the text by its words, found when they are asked for."""
            if not known:
                known.append(self.plausible.votes(re.findall(r"[^\W\d_]+", text)))
            return known[0]

        chain = self.together(sorted(words), said)
        if chain:
            rest = self._restored(text, words, chain)
            return (True, *rest)
        for word in words:
            if word.isascii() and not _ESCAPED.search(word):
                continue
            fixed = self.word(word)
            if fixed is not None:
                found[word] = fixed
                if fixed.decoded:
                    strong |= fixed.utf8 and fixed.gain >= 0.5
                    boxes = any("\u2500" <= c < "\u25a0" for c in word)  # line drawing beside letters and figures
                    by_steps[fixed.steps] += fixed.gain * (1 + boxes) if fixed.utf8 or fixed.gain >= 0.9 else 0.0
        ways = {k for k, gain in by_steps.items() if _is_utf8(k) or gain >= 2.5}
        if explained := self._explained(sorted(w for w in words if not w.isascii() and not ((r := found.get(w)) and r.utf8)), said):
            found |= explained
            ways = {k for k in ways if _is_utf8(k)} | {r.steps for r in explained.values()}
        affected = strong or any(ud.category(c) == "Cc" and c > "\x7f" for c in text) or any(not _is_utf8(k) for k in ways)
        if not affected:
            ways = set()
        use = {w: r for w, r in found.items() if not r.decoded or r.steps in ways}
        if not use:
            return affected, text, ""
        restored = _WORD.sub(lambda m: use[m.group()].text if m.group() in use else m.group(), text)
        return affected, restored, ",".join(sorted({s for r in use.values() for s in r.steps}))


def _is_utf8(steps: tuple[str, ...]) -> bool:
    return any(s.endswith(">utf-8") for s in steps)


def repaired(df: DataFrame, record: str, text: str, samples: list[tuple[str, str]], max_steps: int = 4) -> DataFrame:
    """(record, affected, restored, operations) of every row; ``samples`` are (language, text) pairs, a small fixed table.

    One pass without a shuffle. Rows repeat as they come; null texts give affected = false and restored = null.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(Plausibility.learn(samples), max_steps)
        for batch in batches:
            done = [repair.text(t) for t in batch["t"]]
            yield pd.DataFrame(
                {"r": batch["r"], "affected": [x[0] for x in done], "restored": [x[1] for x in done], "operations": [x[2] for x in done]}
            )

    kind = df.schema[record].dataType.simpleString()
    rows = df.select(F.col(record).alias("r"), F.col(text).alias("t"))
    odd = F.col("t").rlike(r"[^\x00-\x7f]|" + _ESCAPED.pattern)
    plain = rows.where(~F.coalesce(odd, F.lit(False))).select(
        "r", F.lit(False).alias("affected"), F.col("t").alias("restored"), F.lit("").alias("operations")
    )
    searched = rows.where(odd).mapInPandas(run, f"r {kind}, affected boolean, restored string, operations string")
    return plain.unionByName(searched).withColumnRenamed("r", record)
