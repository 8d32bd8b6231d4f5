"""Queries of the language functions: stems, phonetic codes, stop words, detection, analyzed searches, snippets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.catalogue import _INDEX_DOCUMENTS, _QUERIES_SQL, PLAIN, _tokens_sql, course, query, table
from lexwell.functions.analyzers import ANALYZERS, Analyzer
from lexwell.functions.detect import detect
from lexwell.functions.snippet import build_snippet
from lexwell.functions.stopwords import STOP_WORDS
from lexwell.functions.text import tokens
from lexwell.operators import search
from lexwell.operators.packed import Collection
from lexwell.schema import IndexOptions, QueryOptions, SnippetOptions
from lexwell.sources.shipping import ship


def _vocabulary(spark, sf, language: str) -> DataFrame:
    """Distinct tokens of the documents of a language; Norwegian, which has none, takes the Danish ones."""
    docs = table(spark, sf, "documents").where(F.col("lang") == {"no": "da"}.get(language, language))
    return docs.select(F.explode(tokens(F.col("text"))).alias("token")).distinct()


def _mapped(vocabulary: DataFrame, function, name: str) -> DataFrame:
    ship(vocabulary.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], name: [function(t) for t in b["token"]]})

    return vocabulary.mapInPandas(run, f"token string, {name} string")


for _code in ANALYZERS:

    def _stems(spark, sf, code=_code):
        return _mapped(_vocabulary(spark, sf, code), ANALYZERS[code].stem, "stem")

    query(None, f"stem_{_code}")(_stems)



def koelner_ctes(tokens_sql: str) -> str:
    """CTEs that end with ``koelner`` (token, code) of a table of tokens."""
    return f"""
l AS (SELECT token, string_split(translate(token, 'äöüß', 'aous'), '') AS c FROM {tokens_sql}),
d AS (SELECT token, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE
  WHEN c[i] IN ('a', 'e', 'i', 'j', 'o', 'u', 'y') THEN '0' WHEN c[i] = 'b' THEN '1' WHEN c[i] = 'p' THEN CASE WHEN c[i + 1] = 'h' THEN '3' ELSE '1' END
  WHEN c[i] IN ('d', 't') THEN CASE WHEN c[i + 1] IN ('c', 's', 'z') THEN '8' ELSE '2' END WHEN c[i] IN ('f', 'v', 'w') THEN '3'
  WHEN c[i] IN ('g', 'k', 'q') THEN '4'
  WHEN c[i] = 'c' AND i = 1 THEN CASE WHEN c[2] IN ('a', 'h', 'k', 'l', 'o', 'q', 'r', 'u', 'x') THEN '4' ELSE '8' END
  WHEN c[i] = 'c' THEN CASE WHEN c[i - 1] IN ('s', 'z') THEN '8' WHEN c[i + 1] IN ('a', 'h', 'k', 'o', 'q', 'u', 'x') THEN '4' ELSE '8' END
  WHEN c[i] = 'x' THEN CASE WHEN i > 1 AND c[i - 1] IN ('c', 'k', 'q') THEN '8' ELSE '48' END WHEN c[i] = 'l' THEN '5' WHEN c[i] IN ('m', 'n') THEN '6'
  WHEN c[i] = 'r' THEN '7' WHEN c[i] IN ('s', 'z') THEN '8' ELSE '' END), '') AS s FROM l),
e AS (SELECT token, CASE WHEN s = '' THEN [] ELSE string_split(s, '') END AS k FROM d),
kk AS (SELECT token, list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1]) AS k FROM e),
koelner AS (SELECT token, nullif(array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> '0'), ''), '') AS code FROM kk)"""


_KOELNER = f"WITH v AS (SELECT DISTINCT unnest({_tokens_sql('text')}) AS token FROM documents WHERE lang = 'de'), {koelner_ctes('v')} SELECT token, code FROM koelner"


@query(_KOELNER)
def koelner_codes(spark, sf):
    return _mapped(_vocabulary(spark, sf, "de"), ANALYZERS["de"].encode, "code")


@query()
def double_metaphone_codes(spark, sf):
    return _mapped(_vocabulary(spark, sf, "en"), ANALYZERS["en"].encode, "code")


for _code in sorted(STOP_WORDS):
    _listed = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS[_code]))

    def _stripped(spark, sf, code=_code):
        """Tokens of the documents of a language without its stop words, counted; Norwegian ones from the Danish documents, none has its label."""
        docs = table(spark, sf, "documents").where(F.col("lang") == {"no": "da"}.get(code, code))
        words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
        return words.where(~F.col("token").isin(*sorted(STOP_WORDS[code]))).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))

    query(
        f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents WHERE lang = '{'da' if _code == 'no' else _code}') "
        f"WHERE token NOT IN ({_listed}) GROUP BY doc_id, token",
        f"stopword_strip_{_code}",
    )(_stripped)


@query()
def detect_language(spark, sf):
    """The language each document is labelled with and the one its n-grams are nearest to."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "lang"]].assign(detected=[detect(t) for t in b["text"]])

    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs.mapInPandas(run, "doc_id bigint, lang string, detected string")


# Searches with analyzers, over the index documents

ALL = IndexOptions(default_language="en").with_all_languages()


indexed = Collection


def _searched(spark, sf, asked: DataFrame, index: IndexOptions, options: QueryOptions) -> DataFrame:
    """The pages of the queries over every index document; each query with its own language and wish for a snippet."""
    tables = indexed(table(spark, sf, "index_documents"), index, f"{sf}/index_documents")
    hits = search.search_tables(tables, asked, index, options)
    return hits.select("query_id", F.col("position").cast("int").alias("position"), "doc_id", "score", "tier", "snippet")


def asked_in(queries: DataFrame, language: str) -> DataFrame:
    """The queries that are analyzed in a language; those that name none have the default one."""
    return queries.where(F.lower(F.coalesce("language", F.lit(ALL.default_language))) == language)


for _language in ("de", "en", "fr"):

    def _stemmed(spark, sf, language=_language):
        asked = asked_in(table(spark, sf, "search_queries"), language)
        return _searched(spark, sf, asked, replace(ALL, enable_phonetic=False), QueryOptions(enable_fuzzy=False)).drop("snippet")

    query(None, f"search_stemmed_{_language}")(_stemmed)


_ASKED_IN = f"SELECT * FROM ({_QUERIES_SQL}) WHERE lower(coalesce(language, 'en')) = "
_PAGE = "SELECT query_id, position, doc_id, score, tier FROM page"
_GERMAN_CODES = replace(PLAIN, enable_phonetic=True, default_language="en", analyzers={"de": ANALYZERS["de"]})


@query(course(_ASKED_IN + "'de'", _INDEX_DOCUMENTS, True, koelner_ctes("(SELECT token FROM vocab WHERE lang = 'de')")
  + ", analysis AS (SELECT 'de' AS lang, token, '' AS stem, code FROM koelner)", "en") + _PAGE)
def search_phonetic_de(spark, sf):
    """German queries with the codes of their tokens beside the tokens."""
    return _searched(spark, sf, asked_in(table(spark, sf, "search_queries"), "de"), _GERMAN_CODES, QueryOptions(enable_fuzzy=False)).drop("snippet")


@query()
def search_phonetic_en(spark, sf):
    return _searched(spark, sf, asked_in(table(spark, sf, "search_queries"), "en"), ALL, QueryOptions(enable_fuzzy=False)).drop("snippet")


@query(course(_QUERIES_SQL, _INDEX_DOCUMENTS, True, "analysis AS (SELECT lang, token, token AS stem, NULL AS code FROM vocab)") + _PAGE)
def search_fallback_analyzer(spark, sf):
    """Without analyzers every language keeps its distinct tokens as stems and has no codes."""
    options = replace(PLAIN, enable_stemming=True, enable_phonetic=True)
    return _searched(spark, sf, table(spark, sf, "search_queries"), options, QueryOptions(enable_fuzzy=False)).drop("snippet")


def _cut(token: str) -> str:
    return token[:-1] if token.endswith(("s", "n")) else token


def _first_letters(token: str) -> str | None:
    return token[:3].upper() if len(token) > 4 else None


_OWN_STOPS = ("the", "und", "der", "die", "of", "and", "to")
_OWN = Analyzer(_cut, _first_letters, frozenset(_OWN_STOPS))


@query(course(_QUERIES_SQL, _INDEX_DOCUMENTS, False, f"""analysis AS (SELECT lang, token,
  CASE WHEN coalesce(lang, '') NOT IN ('de', 'en') THEN token WHEN token IN ({', '.join(repr(w) for w in _OWN_STOPS)}) THEN ''
    ELSE regexp_replace(token, '[sn]$', '') END AS stem,
  CASE WHEN coalesce(lang, '') IN ('de', 'en') AND length(token) > 4 AND token NOT IN ({', '.join(repr(w) for w in _OWN_STOPS)}) THEN upper(token[1:3]) END AS code
  FROM vocab)""", "de") + _PAGE)
def search_own_analyzer(spark, sf):
    """Analyzers given by the user: stemmer, encoder and stop words, which leave the stems but not the base tokens; no substrings."""
    options = IndexOptions(enable_trigram=False, remove_stop_words=True, default_language="de", analyzers={"de": _OWN, "en": _OWN})
    return _searched(spark, sf, table(spark, sf, "search_queries"), options, QueryOptions(enable_fuzzy=False)).drop("snippet")


@query()
def search_fuzzy(spark, sf):
    """Every search query with fuzzy ranking over every index document."""
    return _searched(spark, sf, table(spark, sf, "search_queries"), PLAIN, QueryOptions()).drop("snippet")


def snippet_sql(rows: str) -> str:
    """CTEs that end with ``marked`` (key, snippet) of ``rows``: (key, content, w), w the tokens to mark, in a window of 200."""
    return f"""
row0 AS ({rows}),
folds AS (SELECT content, string_split(content, '') AS c, list_transform(string_split(content, ''), lambda x: regexp_replace(strip_accents(lower(x)), '\\p{{Mn}}+', '', 'g')) AS f
  FROM (SELECT DISTINCT content FROM row0) WHERE content <> ''),
folded AS (SELECT content, c, array_to_string(f, '') AS folded, list_filter(range(1, len(c) + 1), lambda i: f[i] <> '') AS kept FROM folds),
row1 AS (SELECT key, content, c, folded, kept, len(c) AS n, list_transform(w, lambda x: regexp_replace(strip_accents(x), '\\p{{Mn}}+', '', 'g')) AS w FROM row0 JOIN folded USING (content)),
row2 AS (SELECT *, list_transform(w, lambda x: strpos(folded, x)) AS spots FROM row1),
row3 AS (SELECT *, list_min(list_filter(spots, lambda p: p > 0)) AS lead, least(200, n) AS width FROM row2),
row4 AS (SELECT *, kept[lead] - 1 AS s, kept[lead + length(w[list_position(spots, lead)]) - 1] AS e FROM row3),
row5 AS (SELECT *, least(greatest((s + e) // 2 - width // 2, 0), n - width) AS l FROM row4),
row6 AS (SELECT *, CASE WHEN lead IS NULL THEN [] ELSE flatten(list_transform(w, lambda x: flatten(list_transform(
    list_filter(range(greatest(1, l - 260), least(length(folded) - length(x) + 2, l + width + 1)), lambda a: folded[a:a + length(x) - 1] = x),
    lambda a: range(kept[a], kept[a + length(x) - 1] + 1))))) END AS hit FROM row5),
row7 AS (SELECT *, list_distinct(list_filter(hit, lambda i: i > l AND i <= l + width)) AS hits FROM row6),
marked AS (SELECT key, CASE WHEN lead IS NULL THEN content[1:200] ELSE array_to_string(list_transform(range(l + 1, l + width + 1), lambda i:
    CASE WHEN NOT list_contains(hits, i) THEN c[i] ELSE (CASE WHEN list_contains(hits, i - 1) THEN '' ELSE '<mark>' END) || c[i]
      || (CASE WHEN list_contains(hits, i + 1) THEN '' ELSE '</mark>' END) END), '') END AS snippet FROM row7)"""


@query(course(_QUERIES_SQL, _INDEX_DOCUMENTS) + ", " + snippet_sql(
    "SELECT struct_pack(q := query_id, p := position) AS key, d.content, q.w FROM page JOIN q USING (query_id) JOIN search_queries USING (query_id) "
    "JOIN index_documents d ON d.rowid = page.rowid WHERE include_snippet AND d.content IS NOT NULL")
    + " SELECT p.query_id, position, doc_id, snippet FROM page p LEFT JOIN marked ON key.q = p.query_id AND key.p = position")
def search_snippets(spark, sf):
    """Every search query over every index document, with snippets where it asks for them."""
    hits = _searched(spark, sf, table(spark, sf, "search_queries"), PLAIN, QueryOptions(enable_fuzzy=False))
    return hits.select("query_id", "position", "doc_id", "snippet")


@query()
def search_batch(spark, sf):
    """Every search query in its own language with stems, codes, fuzzy ranking and the snippets it asks for."""
    return _searched(spark, sf, table(spark, sf, "search_queries"), ALL, QueryOptions())


# Snippets of all documents

_FOLDED = r"regexp_replace(strip_accents(lower(text)), '\p{Mn}+', '', 'g')"


def _snippets(spark, sf, token: str, options: SnippetOptions) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "snippet": [build_snippet(t or "", [token], options) for t in b["text"]]})

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, snippet string")


@query(
    f"WITH d AS (SELECT doc_id, text, length(text) AS n, strpos({_FOLDED}, 'pump') - 1 AS s FROM documents), "
    "w AS (SELECT *, least(60, n) AS width FROM d), a AS (SELECT *, CASE WHEN s < 0 THEN 0 ELSE least(greatest((s + s + 4) // 2 - width // 2, 0), n - width) END AS l FROM w) "
    "SELECT doc_id, substring(text, l + 1, width) AS snippet FROM a"
)
def snippet_window(spark, sf):
    """The window around the first occurrence of a token, without marks."""
    return _snippets(spark, sf, "pump", SnippetOptions(60, "", ""))


@query("SELECT doc_id, substring(text, 1, 200) AS snippet FROM documents")
def snippet_no_token(spark, sf):
    return _snippets(spark, sf, "zzzzqq", SnippetOptions())


@query("WITH " + snippet_sql("SELECT doc_id AS key, text AS content, ['notice'] AS w FROM documents") + " SELECT doc_id, coalesce(snippet, '') AS snippet FROM documents LEFT JOIN marked ON key = doc_id")
def snippet_marked(spark, sf):
    return _snippets(spark, sf, "notice", SnippetOptions())


