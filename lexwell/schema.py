"""Schemas, options and errors of the search engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import types as T

if TYPE_CHECKING:
    from lexwell.functions.analyzers import Analyzer

SCHEMA_VERSION = "1"
TOKENIZER = "unicode61 remove_diacritics 2"
STREAMS = ("base", "stem", "phonetic")


class SearchIndexError(Exception):
    """An index cannot be opened or used as asked: wrong version, other layout flags, missing metadata schema, closed."""


def entries_schema(metadata: T.StructType) -> T.StructType:
    """Entries to index; ``ord`` is their input order, by which the last of equal ids wins."""
    return T.StructType(
        [
            T.StructField("doc_id", T.StringType(), False),
            T.StructField("content", T.StringType()),
            T.StructField("metadata", metadata),
            T.StructField("language", T.StringType()),
            T.StructField("ord", T.LongType()),
        ]
    )


DOCUMENTS = T.StructType(
    [
        T.StructField("rowid", T.LongType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("language", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("rank_text", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("query_text", T.StringType()),
        T.StructField("term_match", T.StringType()),
        T.StructField("result_limit", T.IntegerType()),
        T.StructField("result_offset", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("include_snippet", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class SnippetOptions:
    max_length: int = 200
    start_marker: str = "<mark>"
    end_marker: str = "</mark>"


@dataclass(frozen=True)
class IndexOptions:
    """How texts are analyzed and stored. The first six are fixed by the index; others may differ at each opening."""

    store_content: bool = True
    enable_trigram: bool = True
    enable_stemming: bool = True
    enable_phonetic: bool = True
    remove_stop_words: bool = False
    tokenizer: str = TOKENIZER
    max_content_chars: int = 0
    analyzers: dict[str, "Analyzer"] = field(default_factory=dict)
    language_detector: Callable[[str], str | None] | None = None
    default_language: str | None = None
    fuzzy_ranker: Callable[[str, str], float] | None = None  # None: token-set ratio
    metadata_schema: T.StructType | None = None
    buckets: int = 32  # into how many folders a new index deals its tables; an index keeps the number it was made with

    FLAGS = ("store_content", "enable_trigram", "enable_stemming", "enable_phonetic", "remove_stop_words", "tokenizer")

    def flags(self) -> dict[str, str]:
        """The flags an index stores, as text."""
        values = {name: getattr(self, name) for name in self.FLAGS}
        return {k: v if isinstance(v, str) else str(v).lower() for k, v in values.items()}

    def with_language(self, code: str, analyzer: "Analyzer | None" = None) -> "IndexOptions":
        from lexwell.functions.analyzers import ANALYZERS

        return replace(self, analyzers={**self.analyzers, code.lower(): analyzer or ANALYZERS[code.lower()]})

    def with_all_languages(self) -> "IndexOptions":
        from lexwell.functions.analyzers import ANALYZERS

        return replace(self, analyzers={**self.analyzers, **ANALYZERS})


def desktop(options: IndexOptions = IndexOptions()) -> IndexOptions:
    """Everything on, whole texts."""
    return replace(options, enable_trigram=True, store_content=True, enable_phonetic=True, remove_stop_words=False, max_content_chars=0)


def mobile(options: IndexOptions = IndexOptions()) -> IndexOptions:
    """No substring search, stop words left out of the stems, texts cut at 4000 characters."""
    return replace(options, enable_trigram=False, store_content=True, enable_phonetic=True, remove_stop_words=True, max_content_chars=4000)


@dataclass(frozen=True)
class QueryOptions:
    limit: int = 50
    offset: int = 0
    min_score: float = 0.0
    term_match: str = "AllTerms"  # or AnyTerm
    enable_fuzzy: bool = True
    enable_phonetic: bool = True
    language: str | None = None
    include_snippet: bool = False
    candidate_pool_size: int = 300
    snippet: SnippetOptions = SnippetOptions()


def version_at_least(version: str | None, least: tuple[int, int, int]) -> bool | None:
    """Whether a version of up to three dotted numbers is at least ``least``; None if it is none."""
    parts = (version or "").split(".")
    if not 1 <= len(parts) <= 3 or not all(p.isascii() and p.isdigit() for p in parts):
        return None
    numbers = [int(p) for p in parts]
    return tuple(numbers + [0] * (3 - len(numbers))) >= least
