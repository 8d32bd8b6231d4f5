"""Analyzers by language: stemmer, phonetic encoder, stop words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lexwell.functions.phonetics import double_metaphone, koelner
from lexwell.functions.stemmers import da, de, en, es, fi, fr, hu, it, nl, no, pt, ro, ru, sv, tr
from lexwell.functions.stopwords import STOP_WORDS


@dataclass(frozen=True)
class Analyzer:
    """Functions of one token: its stem, its phonetic code (null if it has none), whether it is a stop word."""

    stem: Callable[[str], str]
    encode: Callable[[str], str | None] | None = None
    stop_words: frozenset[str] = frozenset()

    def is_stop_word(self, token: str) -> bool:
        return token in self.stop_words


_ENCODERS = {"de": koelner, "en": double_metaphone}
_STEMMERS = {"da": da, "de": de, "en": en, "es": es, "fi": fi, "fr": fr, "hu": hu, "it": it, "nl": nl, "no": no, "pt": pt, "ro": ro, "ru": ru, "sv": sv, "tr": tr}
ANALYZERS: dict[str, Analyzer] = {
    code: Analyzer(module.stem, _ENCODERS.get(code), STOP_WORDS[code]) for code, module in _STEMMERS.items()
}
