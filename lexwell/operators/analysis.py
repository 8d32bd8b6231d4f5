"""Token streams: languages of texts, stems and phonetic codes of their tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.functions.text import fold_terms_text
from lexwell.schema import IndexOptions
from lexwell.sources.shipping import ship

MEMO = 400_000  # analyzed tokens a worker keeps for each language; beyond it starts anew


def resolved_language(df: DataFrame, options: IndexOptions, text: str) -> DataFrame:
    """Fills ``language``: as given, else detected, else the default. Only rows without a language reach the detector."""
    if options.language_detector is not None:
        ship(df.sparkSession)
        detect = options.language_detector

        @F.pandas_udf("string")
        def detected(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield s.map(lambda t: detect(t) if t else None)

        given = df.where(F.col("language").isNotNull())
        missing = df.where(F.col("language").isNull()).withColumn("language", detected(text))
        df = given.unionByName(missing)
    return df.withColumn("language", F.coalesce("language", F.lit(options.default_language).cast("string")))


class Vocabulary:
    """Stems and codes of tokens by language; each token of a language is analyzed once and then remembered.

    A language without an analyzer keeps its tokens as stems and has no codes.
    """

    def __init__(self, options: IndexOptions) -> None:
        self.options = options
        self.stems = options.enable_stemming
        self.codes = options.enable_phonetic and any(a.encode for a in options.analyzers.values())
        self._memo: dict[str, dict[str, tuple[str, str | None]]] = {}
        self._terms: dict[str, list[str]] = {}

    @property
    def derives(self) -> bool:
        return self.stems or self.codes

    def analyzed(self, language: str | None, token: str) -> tuple[str, str | None]:
        """(stem, code) of a token; '' and null where it has none or is a stop word that is left out."""
        known = self._memo.setdefault(language or "", {})
        if token not in known:
            if len(known) >= MEMO:
                known.clear()
            a = self.options.analyzers.get(language or "")
            if a is None:
                known[token] = token, None
            elif self.options.remove_stop_words and a.is_stop_word(token):
                known[token] = "", None
            else:
                known[token] = a.stem(token), a.encode(token) if self.codes and a.encode else None
        return known[token]

    def index_terms(self, value: str) -> list[str]:
        """A stem or code as the index tokenizer reads it."""
        if value not in self._terms:
            if len(self._terms) >= MEMO:
                self._terms.clear()
            self._terms[value] = re.findall(r"[^\W_]+", fold_terms_text(value))
        return self._terms[value]

    def streams(self, languages: list[str | None], words: list[list[str]]) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
        """For each derived stream (row, term, tf): distinct values of a text, folded; what coincides then adds up."""
        out: dict[str, tuple[list[int], list[str], list[int]]] = {}
        if self.stems:
            out["stem"] = [], [], []
        if self.codes:
            out["phonetic"] = [], [], []
        for row, (language, listed) in enumerate(zip(languages, words)):
            pairs = [self.analyzed(language, w) for w in listed or ()]
            for name, at in (("stem", 0), ("phonetic", 1)):
                if name not in out:
                    continue
                counts: Counter[str] = Counter()
                for value in {p[at] for p in pairs if p[at]}:
                    counts.update(self.index_terms(value))
                rows, found, tf = out[name]
                rows += [row] * len(counts)
                found += counts.keys()
                tf += counts.values()
        return {k: (np.array(r, np.int64), t, np.array(n, np.int64)) for k, (r, t, n) in out.items()}
