"""The plan of a ranked search: which phrases are looked up in which stream, and its rendering as match text.

Every search goes through ``make_plan``, one call a query; ``planned`` does so for a DataFrame of queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.functions.text import DOTTED, fold_terms
from lexwell.schema import QUERIES, IndexOptions, QueryOptions
from lexwell.sources.shipping import ship

_WORD = re.compile(r"[^\W_]+")


def query_tokens(text: str) -> list[str]:
    """Tokens of a query: runs of letters and decimal digits, lower-cased one by one, repeats kept."""
    out = []
    for run in _WORD.findall(text):
        kept = "".join(c if c.isalpha() or c.isdecimal() else " " for c in run)
        out += [t.lower().replace("i̇", DOTTED) for t in kept.split()]
    return out


def utf16_units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


@dataclass(frozen=True)
class Phrase:
    stream: str
    term: str
    is_prefix: bool = False


@dataclass(frozen=True)
class MatchPlan:
    """What a query looks up: the strict pass (all phrases), the any-term pass, and the substring, each possibly absent."""

    text: str
    strict: tuple[Phrase, ...]
    any_term: tuple[Phrase, ...]
    substring: str | None

    @property
    def empty(self) -> bool:
        return not self.any_term and self.substring is None


def _distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def make_plan(text: str | None, index: IndexOptions, query: QueryOptions) -> MatchPlan:
    """Blank queries give an empty plan. Short queries (under three UTF-16 units) also look their last token up as a prefix."""
    if text is None or not text.strip():
        return MatchPlan(text or "", (), (), None)
    found = query_tokens(text)
    units = utf16_units(text)
    substring = text.lower() if index.enable_trigram and units >= 3 else None
    if not found:
        return MatchPlan(text, (), (), substring)
    language = query.language
    if language is None and index.language_detector is not None:
        language = index.language_detector(text)
    if language is None:
        language = index.default_language
    analyzer = index.analyzers.get((language or "").lower())
    phrases = [Phrase("base", t) for t in found]
    if units < 3:
        phrases.append(Phrase("base", found[-1], True))
    useful = [t for t in found if not (index.remove_stop_words and analyzer and analyzer.is_stop_word(t))]
    if index.enable_stemming:
        phrases += [Phrase("stem", s) for s in _distinct(analyzer.stem(t) if analyzer else t for t in useful)]
    if index.enable_phonetic and query.enable_phonetic and analyzer and analyzer.encode:
        phrases += [Phrase("phonetic", p) for p in _distinct(analyzer.encode(t) for t in useful)]
    strict = tuple(Phrase("base", t) for t in found) if query.term_match == "AllTerms" and len(found) > 1 else ()
    return MatchPlan(text, strict, tuple(phrases), substring)


def escaped(token: str) -> str:
    return '"' + token.replace('"', '""') + '"'


def render(phrases: tuple[Phrase, ...], joiner: str = " OR ") -> str:
    """The phrases as match text, one clause a stream, for explanations and tests: ``base : ("a" OR "b"*)``."""
    clauses = []
    for stream in dict.fromkeys(p.stream for p in phrases):
        inside = joiner.join(escaped(p.term) + "*" * p.is_prefix for p in phrases if p.stream == stream)
        clauses.append(f"{stream} : ({inside})")
    return " OR ".join(clauses)


_PHRASES = "array<struct<stream:string,term:string,is_prefix:boolean>>"
_PLANS = f"query_id bigint, query_text string, result_limit int, result_offset int, include_snippet boolean, required int, part string, phrases {_PHRASES}"


def planned(queries: DataFrame, index: IndexOptions, query: QueryOptions) -> DataFrame:
    """(query_id, query_text, result_limit, result_offset, include_snippet, required, part, phrases) of the queries that look something up.

    ``queries`` needs query_id and query_text; other columns of ``schema.QUERIES`` that are missing or null take the
    values of ``query``. ``required`` is the number of phrases the strict pass needs, 0 if there is none; ``part`` the
    substring. Blank queries and queries without tokens and substring have no row.
    """
    ship(queries.sparkSession)
    defaults = {
        "term_match": query.term_match, "result_limit": query.limit, "result_offset": query.offset, "language": query.language,
        "include_snippet": query.include_snippet,
    }

    def column(f):
        value = F.lit(defaults.get(f.name)).cast(f.dataType)
        return (F.coalesce(F.col(f.name), value) if f.name in queries.columns else value).cast(f.dataType).alias(f.name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                text = r.query_text if isinstance(r.query_text, str) else None
                language = r.language if isinstance(r.language, str) else None
                plan = make_plan(text, index, replace(query, term_match=r.term_match, language=language))
                if not plan.empty:
                    phrases = [{"stream": p.stream, "term": p.term, "is_prefix": p.is_prefix} for p in plan.any_term]
                    rows.append((r.query_id, text, r.result_limit, r.result_offset, r.include_snippet, len(plan.strict), plan.substring, phrases))
            yield pd.DataFrame(rows, columns=["query_id", "query_text", "result_limit", "result_offset", "include_snippet", "required", "part", "phrases"])

    return queries.select(*map(column, QUERIES.fields)).mapInPandas(run, _PLANS)


def phrases_of(plans: DataFrame) -> DataFrame:
    """(query_id, stream, term, is_prefix), one row a phrase, the terms folded as the index folds them."""
    p = plans.select("query_id", F.explode("phrases").alias("p"))
    return p.select("query_id", "p.stream", fold_terms(F.col("p.term")).alias("term"), "p.is_prefix")
