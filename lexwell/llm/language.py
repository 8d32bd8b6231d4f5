"""Problem 2: the language of each document and of each stretch of it, with a confidence.

Method: language-bitmask n-gram filters. All languages share one bit-sliced Bloom filter: a slot holds one bit per
language, so one look-up returns every language that has an n-gram. A word counts, per language, the n-grams found; the
counts are corrected by each language's false-positive rate and shared among the languages found. The best sequence of
languages over the words of a text, with a price for each change of language, gives the stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwell.llm.canonical import canonical
from lexwell.llm.common import ship
from lexwell.llm.mojibake import Plausibility, Repair

_WORD = re.compile(r"[^\W\d_]+")
# What is no text in any language; the other words of its line are.
_NO_WORDS = re.compile(r"\[cid:[^\]\n]*\]?|[^\s<>()\[\]]*(?:@|www\.|https?:)[^\s<>()\[\]]*|-{4,}|_{4,}|\*{4,}")
_HEADER = re.compile(r"[>|\s*]*\*?[^\W\d_]{1,12}\*?\s?:\*?\s(.*)")
_HEADER_WORDS = 12


def text_of(text: str) -> str:
    """The text without addresses, rules and the lines of header blocks.

    A line is a header only beside another header, and only if its value is short; a paragraph that begins like one is text.
    """
    lines = text.split("\n")
    found = [_HEADER.fullmatch(l) for l in lines]
    header = [m is not None and len(_WORD.findall(_NO_WORDS.sub(" ", m[1]))) < _HEADER_WORDS for m in found]
    beside = [h and (i > 0 and header[i - 1] or i + 1 < len(header) and header[i + 1]) for i, h in enumerate(header)]
    return _NO_WORDS.sub(" ", "\n".join(" " if b else l for l, b in zip(lines, beside)))


# ISO 639-2 codes of the languages that have a two-letter code here.
THREE_LETTERS = {
    "dan": "da", "deu": "de", "ger": "de", "eng": "en", "spa": "es", "fin": "fi", "fra": "fr", "fre": "fr", "hun": "hu", "ita": "it",
    "nld": "nl", "dut": "nl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "swe": "sv", "tur": "tr",
}


def grams(word: str) -> list[str]:
    """The word itself and its pieces of two to five letters, word ends marked."""
    padded = f" {word} "
    return [padded, *(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1) if n < len(padded))]


class LanguageFilter:
    """A Bloom filter with one bit per language and slot."""

    def __init__(self, samples: Iterable[tuple[str, str]], slots: int = 1 << 18, hashes: int = 2) -> None:
        texts = [(l, t) for l, t in samples if l and t]
        self.languages = sorted({l for l, _ in texts})
        if len(self.languages) > 64:
            raise ValueError("at most 64 languages share a filter")
        self.slots, self.hashes = slots, hashes
        self.filter = np.zeros(slots, np.uint64)
        number = {l: i for i, l in enumerate(self.languages)}
        for language in self.languages:
            found = {g for l, t in texts if l == language for w in _WORD.findall(t.lower()) for g in grams(w)}
            if found:
                for at in self._at(sorted(found)):
                    self.filter[at] |= np.uint64(1 << number[language])
        self.bits = np.array([1 << i for i in range(len(self.languages))], np.uint64)
        filled = np.array([((self.filter & b) != 0).mean() for b in self.bits]) if self.languages else np.zeros(0)
        self.false = filled**hashes
        self.known: dict[str, np.ndarray] = {}
        self.whole: set[str] = set()

    def _at(self, pieces: list[str]) -> list[np.ndarray]:
        full = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64)
        low, high = full & np.uint64(0xFFFFFFFF), full >> np.uint64(32)
        return [((low + np.uint64(i) * (high | np.uint64(1))) % np.uint64(self.slots)).astype(np.int64) for i in range(self.hashes)]

    def word(self, word: str) -> np.ndarray:
        """The evidence of a lower-case word for each language, between 0 and 1."""
        known = self.known.get(word)
        if known is not None:
            return known
        if len(self.known) > 400_000:
            self.known.clear()
            self.whole.clear()
        pieces = grams(word)
        mask = np.bitwise_and.reduce([self.filter[at] for at in self._at(pieces)])
        found = ((mask[:, None] & self.bits) != 0).astype(np.float64)
        corrected = np.clip((found - self.false) / (1 - self.false), 0, 1)
        if mask[0]:
            self.whole.add(word)
        shared = corrected / np.maximum(corrected.sum(1), 1)[:, None]
        shared[0] *= len(pieces)  # a whole word counts as much as all of its pieces
        evidence = shared.sum(0) / (2 * len(pieces))
        evidence = np.where(evidence > 0.08, evidence, 0)
        self.known[word] = evidence
        return evidence

    def evidence(self, text: str) -> np.ndarray:
        """One row per word of the text, without headers, addresses and rules."""
        words = _WORD.findall(text_of(text))
        if not words:
            return np.zeros((0, len(self.languages)))
        lower = [w.lower() for w in words]
        rows = np.array([self.word(w) for w in lower])
        # A capitalised word that no language has as a whole is taken for a name, which says little.
        return rows * np.array([self.name_weight if w[0].isupper() and l not in self.whole else 1.0 for w, l in zip(words, lower)])[:, None]

    name_weight = 0.25

    def stretches(self, text: str, price: float = 3.0, label: str | None = None) -> tuple[list[tuple[str, float, int]], float]:
        """(language, confidence, words) of consecutive stretches; neighbours differ; [] if no word says anything.

        The second result is by how much the evidence for the first language exceeds that for the language ``label``.
        """
        if not self.languages:
            return [], 0.0
        e = self.evidence(text)
        e = e[e.any(1)]
        if not len(e):
            return [], 0.0
        total = e.sum(0)
        main = int(total.argmax())
        path = np.full(len(e), main)
        if (e.max(1) - e[:, main]).sum() > price:  # else no change of language can pay
            path = self._best(e, price)
        cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            inside = e[a:b].sum(0)
            out.append((self.languages[path[a]], float(inside[path[a]] / max(inside.sum(), 1e-9)), int(b - a)))
        own = total[self.languages.index(label)] if label in self.languages else 0.0
        return out, float(total[main] - own)

    @staticmethod
    def _best(e: np.ndarray, price: float) -> np.ndarray:
        n, k = e.shape
        back, score, same = np.empty((n, k), np.int64), e[0].copy(), np.arange(k)
        for i in range(1, n):
            top = int(score.argmax())
            change = score[top] - price > score
            back[i] = np.where(change, top, same)
            score = np.where(change, score[top] - price, score) + e[i]
        path = np.empty(n, np.int64)
        path[-1] = int(score.argmax())
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def normal_label(label: Column) -> Column:
    """The language a label names: lower case, without region, three letters to two; null if it names none."""
    short = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    mapped = F.coalesce(F.create_map(*(F.lit(x) for pair in THREE_LETTERS.items() for x in pair))[short], short)
    return F.when(~mapped.isin("", "und"), mapped)


def languages(
    df: DataFrame, record: str, text: str, samples: list[tuple[str, str]], label: Column | None = None, price: float = 3.0
) -> DataFrame:
    """(record, label, language, confidence, margin, segments) of every row, segments an array of (seg_no, lang,
    confidence, words); ``label`` is the language the record is said to be in, ``margin`` by how much more evidence the
    text has for another one.

    Garbled text is repaired and odd characters are brought to one form before the words are looked up. Null texts, and
    texts without a word any filter knows, have null language and no segments. ``samples`` is a small fixed table of
    (language, text). One pass without a shuffle; rows repeat as they come.
    """
    ship(df.sparkSession)
    kind = df.schema[record].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters, repair = LanguageFilter(samples), Repair(Plausibility.learn(samples))
        for batch in batches:
            rows = []
            for t, said in zip(batch["t"], batch["label"]):
                if isinstance(t, str) and not t.isascii():
                    t = canonical(repair.text(t)[1] if repair.suspicious(t) else t)
                found, margin = filters.stretches(t, price, said) if isinstance(t, str) else ([], 0.0)
                weight: dict[str, float] = {}
                for l, c, n in found:
                    weight[l] = weight.get(l, 0.0) + c * n
                main = max(weight, key=weight.get) if weight else None
                share = weight[main] / sum(n for *_, n in found) if weight else None
                rows.append((main, share, [(i, *f) for i, f in enumerate(found, 1)], margin))
            yield pd.DataFrame(
                {
                    "r": batch["r"],
                    "label": batch["label"],
                    "language": [x[0] for x in rows],
                    "confidence": [x[1] for x in rows],
                    "margin": [x[3] for x in rows],
                    "segments": [[{"seg_no": i, "lang": l, "confidence": c, "words": n} for i, l, c, n in x[2]] for x in rows],
                }
            )

    schema = f"r {kind}, label string, language string, confidence double, margin double, segments array<struct<seg_no:int,lang:string,confidence:double,words:int>>"
    said = F.lit(None).cast("string") if label is None else label
    rows = df.select(F.col(record).alias("r"), F.col(text).alias("t"), said.alias("label"))
    return rows.mapInPandas(run, schema).withColumnRenamed("r", record)
