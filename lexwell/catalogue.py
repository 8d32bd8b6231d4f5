"""Named queries over the test tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwell.api import SearchIndex
from lexwell.functions import text as X
from lexwell.operators import postings as P
from lexwell.operators import rank, recall, search, upsert
from lexwell.operators.packed import Collection
from lexwell.plans.match import planned
from lexwell.schema import IndexOptions, QueryOptions, SearchIndexError, version_at_least
from lexwell.sources.checkpoint import new_folder, saved
from lexwell.sources.shipping import ship
from lexwell.sources.store import Store, new_manifest

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = search.base_only()
SQL: dict[str, str] = {}
QUERY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERY[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The table documents in the layout of an index."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("rowid"), F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("language"),
        F.to_json(F.struct("source", "n_chars")).alias("metadata"), F.lit("").alias("rank_text"), F.col("text").alias("content"),
    )


_STORED: dict[tuple, tuple[Store, dict]] = {}


def indexed(documents: DataFrame, options: IndexOptions = PLAIN, name: str | None = None) -> P.IndexTables:
    """A stored index of documents that have their rowids; one with a ``name`` is written once a session and used again."""
    spark = documents.sparkSession
    flags = tuple(sorted(options.flags().items()))
    key = spark.sparkContext.applicationId, name, flags, tuple(sorted((c, id(a)) for c, a in options.analyzers.items()))
    if name is None or key not in _STORED or not _STORED[key][0].intact():
        store = Store(spark, new_folder(spark, "index"))
        segment = store.write_segment(documents, options, options.buckets)
        manifest = {**new_manifest(options), **{k: segment[k] for k in ("n_docs", "sum_dl", "sum_tri")}, "segments": [segment] if segment["n_docs"] else []}
        store.commit(manifest, 1)
        _STORED[key] = store, manifest
    store, manifest = _STORED[key]
    return store.tables(manifest)


_A, _B = X.latin_accents()


def _fold_sql(column: str) -> str:
    return f"regexp_replace(translate(lower({column}), '{_A}', '{_B}'), '\\p{{Mn}}+', '', 'g')"


def _terms_sql(column: str) -> str:
    return f"regexp_extract_all({_fold_sql(column)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{Nd}}]+')"


_TERMS_OF, _TOKENS_OF = _terms_sql("text"), _tokens_sql("text")

# Text


@query(f"SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS token FROM (SELECT doc_id, {_TOKENS_OF} AS l FROM documents)")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "token"))


@query(
    f"SELECT doc_id, token, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS n FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS token "
    f"FROM (SELECT doc_id, {_TOKENS_OF} AS l FROM documents)) GROUP BY doc_id, token"
)
def token_positions(spark, sf):
    return tokenize(spark, sf).groupBy("doc_id", "token").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(lower(text)), '\p{Mn}+', '', 'g') AS folded FROM documents")
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, substring(text, 1, 4000) AS content FROM documents")
def truncate_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncated(F.col("text"), 4000).alias("content"))


@query(f"SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS term FROM (SELECT doc_id, {_TERMS_OF} AS l FROM documents)")
def fts_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.terms(F.col("text"))).alias("pos", "term"))


@query(
    "WITH c AS (SELECT doc_id, string_split(lower(text), '') AS l FROM documents), "
    "g AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2])) AS gram FROM c) "
    "SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram"
)
def trigrams(spark, sf):
    grams = table(spark, sf, "documents").select("doc_id", F.explode(X.trigrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("gram").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


def _entries(spark, sf):
    return table(spark, sf, "entries").select("doc_id", "content", "metadata", "language", "ord")


@query("SELECT DISTINCT doc_id, ord, '' AS rank_text, coalesce(content, '') AS content FROM entries")
def column_layout(spark, sf):
    return upsert.prepared(_entries(spark, sf), PLAIN).select("doc_id", "ord", "rank_text", "content").distinct()


@query("SELECT DISTINCT doc_id, ord, coalesce(content, '') AS rank_text, CAST(NULL AS VARCHAR) AS content FROM entries")
def column_layout_no_content(spark, sf):
    options = replace(PLAIN, store_content=False)
    return upsert.prepared(_entries(spark, sf), options).select("doc_id", "ord", "rank_text", "content").distinct()


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE doc_id IS NULL OR doc_id = '') AS invalid FROM entries")
def validate_entries(spark, sf):
    entries = _entries(spark, sf)
    return entries.select(F.lit(0).alias("bad")).unionByName(upsert.invalid(entries).select(F.lit(1).alias("bad"))).agg(
        F.sum(1 - F.col("bad")).alias("entries"), F.sum("bad").alias("invalid")
    )


@query(
    "SELECT s_suppkey, v AS version, CASE WHEN regexp_full_match(v, '[0-9]+(\\.[0-9]+){0,2}') THEN "
    "list_transform(list_concat(string_split(v, '.'), ['0', '0'])[1:3], lambda x: CAST(x AS INTEGER)) >= [3, 43, 0] END AS supported FROM "
    "(SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat(s_suppkey % 7, '.', s_suppkey % 61) WHEN 1 THEN concat('3.', s_suppkey % 61, '.', s_suppkey % 3) "
    "WHEN 2 THEN concat(s_suppkey % 5, '.x') ELSE concat(s_suppkey % 9, '.43.0') END AS v FROM supplier)"
)
def version_gate(spark, sf):
    key = F.col("s_suppkey")

    def part(m: int):
        return (key % m).cast("string")

    made = (
        F.when(key % 4 == 0, F.concat(part(7), F.lit("."), part(61))).when(key % 4 == 1, F.concat(F.lit("3."), part(61), F.lit("."), part(3)))
        .when(key % 4 == 2, F.concat(part(5), F.lit(".x"))).otherwise(F.concat(part(9), F.lit(".43.0")))
    )

    @F.pandas_udf("boolean")
    def supported(versions: pd.Series) -> pd.Series:
        return versions.map(lambda v: version_at_least(v, (3, 43, 0))).astype(object)

    ship(spark)
    return table(spark, sf, "supplier").select("s_suppkey", made.alias("version")).withColumn("supported", supported("version"))


# Index

_POST = f"""
WITH docs AS (SELECT doc_id AS rowid, coalesce(text, '') AS t FROM documents),
post AS (SELECT rowid, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT rowid, unnest({_terms_sql('t')}) AS term FROM docs) GROUP BY rowid, term),
dl AS (SELECT d.rowid, CAST(coalesce(sum(p.tf), 0) AS BIGINT) AS dl, CAST(greatest(length(any_value(d.t)) - 2, 0) AS BIGINT) AS tri_len
  FROM docs d LEFT JOIN post p USING (rowid) GROUP BY d.rowid)
"""


@query(_POST + "SELECT 'base' AS stream, term, rowid, tf FROM post")
def postings(spark, sf):
    return P.postings_of(corpus(spark, sf), PLAIN)


@query(_POST + "SELECT 'base' AS stream, term, count(*) AS df FROM post GROUP BY term")
def term_stats(spark, sf):
    return P.term_stats_of(P.postings_of(corpus(spark, sf), PLAIN))


@query(_POST + "SELECT rowid, dl, tri_len FROM dl")
def doc_stats(spark, sf):
    docs = corpus(spark, sf)
    return P.doc_stats_of(P.all_postings(docs, PLAIN))


@query(_POST + "SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_dl, round(avg(tri_len), 6) AS avg_tri FROM dl")
def corpus_stats(spark, sf):
    return doc_stats(spark, sf).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avg_dl"), F.round(F.avg("tri_len"), 6).alias("avg_tri"))


@query(
    f"SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS INTEGER) AS place FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, "
    f"unnest(l) AS term FROM (SELECT doc_id, {_TOKENS_OF} AS l FROM documents)) GROUP BY doc_id, term"
)
def dedupe_terms(spark, sf):
    """Distinct tokens of a document in the order they first occur."""
    deduped = F.array_distinct(X.tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(deduped).alias("at", "term")).select("doc_id", "term", (F.col("at") + 1).alias("place"))


# Searches. The SQL states the whole course for a table q of queries; each query shows one stage of it.

# Queries beside those of search_queries: operator characters, prefixes, folding, paging, limits.
PROBES = (
    ("draft contract", "AllTerms", 10, 0), ("notice", "AllTerms", 50, 0), ("the seal", "AnyTerm", 20, 5), ("lager prüft", "AllTerms", 50, 0),
    ("pallet pallet missing", "AnyTerm", 50, 0), ("zzzzqq", "AllTerms", 50, 0), ('"seal" OR NOT (pump)', "AnyTerm", 30, 0), ("se", "AllTerms", 50, 0),
    ("hous", "AllTerms", 50, 0), ("   ", "AllTerms", 50, 0), ("the", "AllTerms", 50, 0), ("broken seal courier", "AllTerms", 500, 10),
    ("SECOND COPY", "AllTerms", 50, 0), ("m'envoyer une", "AllTerms", 50, -3), ("§ 5", "AllTerms", 50, 0), ("клапана", "AllTerms", 0, 0),
    ("d", "AnyTerm", 25, 0), ("wi", "AnyTerm", 40, 0),
)
_LITERALS = ", ".join(f"({-i}, '{t.replace(chr(39), chr(39) * 2)}', '{m}', {n}, {o})" for i, (t, m, n, o) in enumerate(PROBES, 1))
_FIELDS = "query_id, query_text, term_match, result_limit, result_offset"
# The query set of searches: all search queries whose id is divisible by 100, and the probes.
_ASKED_SQL = f"SELECT {_FIELDS} FROM search_queries WHERE query_id % 100 = 0 UNION ALL SELECT CAST(query_id AS BIGINT), query_text, term_match, result_limit, result_offset FROM (VALUES {_LITERALS}) v({_FIELDS})"
POOL = 300


def course(queries: str, docs: str, trigram: bool = True, analyzed: str | None = None, default_language: str | None = None) -> str:
    """The CTEs of a search without fuzzy ranking, up to the page.

    ``docs`` has rowid, doc_id, t and lang. ``analyzed``, if given, is the SQL of CTEs that end with a table ``analysis`` of
    (lang, token, stem, code), made from a table ``vocab`` of (lang, token); '' and null are no stem and no code.
    """
    asked_language = f"coalesce(language, {default_language!r})" if default_language else "language"
    derived = f"""
doctok AS (SELECT DISTINCT rowid, lower(lang) AS lang, unnest({_tokens_sql('t')}) AS token FROM docs),
qtok AS (SELECT DISTINCT query_id, lower(lang) AS lang, unnest(w) AS token FROM q),
vocab AS (SELECT lang, token FROM doctok UNION SELECT lang, token FROM qtok),
{analyzed},
docval AS (SELECT DISTINCT rowid, 'stem' AS stream, stem AS v FROM doctok d JOIN analysis a ON a.token = d.token AND a.lang IS NOT DISTINCT FROM d.lang WHERE stem <> ''
  UNION ALL SELECT DISTINCT rowid, 'phonetic', code FROM doctok d JOIN analysis a ON a.token = d.token AND a.lang IS NOT DISTINCT FROM d.lang WHERE code <> ''),
qval AS (SELECT DISTINCT query_id, 'stem' AS stream, stem AS v FROM qtok d JOIN analysis a ON a.token = d.token AND a.lang IS NOT DISTINCT FROM d.lang WHERE stem <> ''
  UNION ALL SELECT DISTINCT query_id, 'phonetic', code FROM qtok d JOIN analysis a ON a.token = d.token AND a.lang IS NOT DISTINCT FROM d.lang WHERE code <> ''),
""" if analyzed else ""
    more_terms = f" UNION ALL SELECT stream, rowid, unnest({_terms_sql('v')}) FROM docval" if analyzed else ""
    more_phrases = f" UNION ALL SELECT query_id, NULL, NULL, NULL, stream, {_fold_sql('v')} FROM qval" if analyzed else ""
    return f"""
WITH docs AS ({docs}),
q0 AS (SELECT *, {_tokens_sql('query_text')} AS w, length(query_text) AS units FROM ({queries}) WHERE regexp_matches(query_text, '\\S')),
q AS (SELECT query_id, query_text, coalesce(term_match, 'AllTerms') = 'AllTerms' AS all_terms, result_limit, coalesce(result_offset, 0) AS result_offset, w,
  {asked_language if analyzed else 'NULL'} AS lang, len(w) AS k, units, CASE WHEN units >= 3 AND {str(trigram).upper()} THEN lower(query_text) END AS part FROM q0),
{derived}
post AS (SELECT stream, rowid, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT 'base' AS stream, rowid, unnest({_terms_sql('t')}) AS term FROM docs{more_terms})
  GROUP BY stream, rowid, term),
dl AS (SELECT d.rowid, coalesce(sum(p.tf), 0) AS dl, greatest(length(any_value(d.t)) - 2, 0) AS tri FROM docs d LEFT JOIN post p USING (rowid) GROUP BY d.rowid),
tot AS (SELECT count(*) AS n, avg(dl) AS avg_dl, avg(tri) AS avg_tri FROM dl),
word AS (SELECT query_id, all_terms, k, unnest(range(0, len(w))) AS no, unnest(w) AS raw FROM q),
phrase AS (SELECT query_id, all_terms, k, no, 'base' AS stream, {_fold_sql('raw')} AS term FROM word{more_phrases}),
df AS (SELECT stream, term, count(*) AS df FROM post GROUP BY stream, term),
whole AS (SELECT query_id, stream, all_terms, k, no, rowid, CAST(tf AS DOUBLE) AS f, df FROM phrase JOIN post USING (stream, term) JOIN df USING (stream, term)),
prefix AS (SELECT query_id, rowid, CAST(sum(tf) AS DOUBLE) AS f FROM (SELECT query_id, {_fold_sql('w[-1]')} AS p FROM q WHERE units < 3 AND k > 0) x
  JOIN post ON stream = 'base' AND starts_with(term, p) GROUP BY query_id, rowid),
begun AS (SELECT query_id, rowid, f, count(*) OVER (PARTITION BY query_id) AS df FROM prefix),
hit AS (SELECT query_id, 'any' AS pass, rowid, f, df FROM whole UNION ALL SELECT query_id, 'strict', rowid, f, df FROM whole WHERE stream = 'base' AND all_terms AND k > 1
  UNION ALL SELECT query_id, 'any', rowid, f, df FROM begun),
shares AS (SELECT query_id, pass, rowid, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS share FROM hit JOIN dl USING (rowid), tot),
ranked AS (SELECT query_id, pass, rowid, -round(sum(share), 9) AS rank, count(*) AS matched FROM shares GROUP BY query_id, pass, rowid),
strict_all AS (SELECT r.query_id, r.rowid, r.rank FROM ranked r JOIN q USING (query_id) WHERE pass = 'strict' AND matched = k),
strict AS (SELECT * FROM strict_all QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, rowid) <= {POOL}),
n_strict AS (SELECT query_id, count(*) AS c FROM strict GROUP BY query_id),
loose AS (SELECT r.query_id, r.rowid, r.rank FROM ranked r JOIN q USING (query_id) LEFT JOIN n_strict s USING (query_id)
  WHERE pass = 'any' AND (NOT (all_terms AND k > 1) OR coalesce(c, 0) < greatest(result_limit, 0))
  QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, r.rowid) <= {POOL}),
contain AS (SELECT query_id, rowid, part, lower(t) AS low FROM q JOIN docs ON part IS NOT NULL AND contains(lower(t), part)),
counted AS (SELECT query_id, rowid, CAST(CASE WHEN len(list_filter(range(1, length(part)), lambda i: part[1:i] = part[length(part) - i + 1:])) > 0
  THEN len(list_filter(range(1, length(low) - length(part) + 2), lambda i: low[i:i + length(part) - 1] = part))
  ELSE len(string_split(low, part)) - 1 END AS DOUBLE) AS f FROM contain),
substring_rank AS (SELECT query_id, rowid, -round((CASE WHEN ln((n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END)
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * tri / avg_tri)), 9) AS rank
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM counted) JOIN dl USING (rowid), tot),
substr AS (SELECT * FROM substring_rank QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, rowid) <= {POOL}),
tiers AS (SELECT query_id, rowid, 0 AS tier, rank FROM strict UNION ALL SELECT query_id, rowid, 1, rank FROM loose UNION ALL SELECT query_id, rowid, 1, rank FROM substr),
merged AS (SELECT query_id, rowid, min(tier) AS tier, min(rank) AS rank FROM tiers GROUP BY query_id, rowid),
pool AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, rowid) <= {POOL}),
normed AS (SELECT *, CASE WHEN max(rank) OVER w = min(rank) OVER w THEN 1.0 ELSE (max(rank) OVER w - rank) / (max(rank) OVER w - min(rank) OVER w) END AS norm
  FROM pool WINDOW w AS (PARTITION BY query_id)),
boosted AS (SELECT query_id, rowid, doc_id, tier, norm, contains(regexp_replace(strip_accents(lower(t)), '\\p{{Mn}}+', '', 'g'),
  regexp_replace(strip_accents(lower(query_text)), '\\p{{Mn}}+', '', 'g')) AS exact FROM normed JOIN docs USING (rowid) JOIN q USING (query_id)),
scored AS (SELECT query_id, rowid, doc_id, tier, round(CASE WHEN exact THEN least(1.0, norm + 0.15) ELSE norm END, 9) AS score FROM boosted),
placed AS (SELECT s.query_id, rowid, doc_id, tier, score, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY tier, score DESC, doc_id) AS INTEGER) AS position, result_limit, result_offset
  FROM scored s JOIN q USING (query_id)),
page AS (SELECT query_id, position, rowid, doc_id, tier, score FROM placed
  WHERE position > greatest(result_offset, 0) AND position <= greatest(result_offset, 0) + greatest(result_limit, 0))
"""


_INDEX_DOCUMENTS = "SELECT rowid, doc_id, coalesce(content, rank_text, '') AS t, language AS lang FROM index_documents"


def asked(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    """The query set of searches that fulfil a condition (SQL that Spark and DuckDB both understand)."""
    rows = [(-i, t, m, n, o) for i, (t, m, n, o) in enumerate(PROBES, 1)]
    few = spark.createDataFrame(rows, "query_id bigint, query_text string, term_match string, result_limit int, result_offset int")
    listed = table(spark, sf, "search_queries").where("query_id % 100 = 0").select(*few.columns)
    return listed.unionByName(few).where(where)


def _course(where: str = "true") -> str:
    return course(f"SELECT * FROM ({_ASKED_SQL}) WHERE {where}", _INDEX_DOCUMENTS)


class Course:
    """The stages of a search of some queries over the whole table index_documents."""

    def __init__(self, spark: SparkSession, sf: str, where: str = "true") -> None:
        self.tables = indexed(table(spark, sf, "index_documents"), PLAIN, f"{sf}/index_documents")
        self.plans = saved(planned(asked(spark, sf, where), PLAIN, QueryOptions()))

    def ranked(self) -> DataFrame:
        return recall.bm25(self.plans, self.tables)

    def strict(self) -> DataFrame:
        return self.ranked().where("pass = 'strict'").select("query_id", "rowid", "rank")

    def substrings(self) -> DataFrame:
        return recall.substring_hits(self.plans.where("part IS NOT NULL").select("query_id", "part"), self.tables)

    def pool(self) -> DataFrame:
        return recall.candidate_pool(self.plans, self.tables, POOL)

    def scored(self, min_score: float = 0.0) -> DataFrame:
        return rank.scored(self.pool(), self.plans, self.tables, False, None, min_score)

    def page(self) -> DataFrame:
        hits = rank.paged(self.scored(), self.plans)
        return hits.select("query_id", F.col("position").cast("int").alias("position"), "doc_id", "tier", "score")


_ANY = "SELECT query_id, rowid, rank FROM ranked WHERE pass = 'any'"
for _name, _where in {
    "match_any": "term_match = 'AnyTerm'", "match_duplicate_terms": "query_id = -5", "match_no_hit": "query_id = -6",
    "match_operators_literal": "query_id = -7 OR query_text LIKE '%\"%' OR query_text LIKE '%(%' OR query_text LIKE '%*%'", "bm25_any": "true",
    "bm25_common_term_clamp": "query_id = -11", "bm25_prefix": "length(query_text) < 3", "match_prefix": "length(query_text) = 2",
}.items():

    def _any(spark, sf, where=_where):
        return Course(spark, sf, where).ranked().where("pass = 'any'").select("query_id", "rowid", "rank")

    query(_course(_where) + _ANY, _name)(_any)

_MANY = "query_text LIKE '% %'"


@query(_course(_MANY) + "SELECT query_id, rowid FROM strict_all")
def match_all(spark, sf):
    return Course(spark, sf, _MANY).strict().select("query_id", "rowid")


@query(_course() + "SELECT query_id, rowid, rank FROM strict_all")
def bm25_all(spark, sf):
    return Course(spark, sf).strict()


@query(_course() + "SELECT query_id, rowid, rank FROM substring_rank")
def bm25_substring(spark, sf):
    return Course(spark, sf).substrings()


@query(_course("length(query_text) = 3 OR query_id = -9") + "SELECT query_id, rowid FROM substring_rank")
def match_substring(spark, sf):
    """Parts of three characters, whose trigram is the answer, and longer ones, which are verified."""
    return Course(spark, sf, "length(query_text) = 3 OR query_id = -9").substrings().select("query_id", "rowid")


@query(_course(_MANY) + "SELECT query_id, rowid, tier FROM pool")
def match_fallback(spark, sf):
    """Strict matches, and any-term matches where these are fewer than the limit."""
    return Course(spark, sf, _MANY).pool().select("query_id", "rowid", "tier")


@query(_course("length(query_text) >= 3") + "SELECT query_id, rowid, rank FROM pool")
def match_union_keep_min(spark, sf):
    """Token and substring matches of one query, each document with the lower rank."""
    return Course(spark, sf, "length(query_text) >= 3").pool().select("query_id", "rowid", "rank")


@query(_course() + "SELECT query_id, rowid, tier FROM pool")
def tier_merge(spark, sf):
    return Course(spark, sf).pool().select("query_id", "rowid", "tier")


@query(_course() + "SELECT query_id, rowid, tier, rank FROM pool")
def pool_topk(spark, sf):
    return Course(spark, sf).pool()


@query(_course() + "SELECT query_id, rowid, round(norm, 9) AS norm FROM normed")
def normalize_pool(spark, sf):
    return rank.normalized(Course(spark, sf).pool()).select("query_id", "rowid", F.round("norm", 9).alias("norm"))


@query(_course() + "SELECT query_id, doc_id, score FROM scored")
def exact_boost(spark, sf):
    return Course(spark, sf).scored().select("query_id", "doc_id", "score")


@query(_course() + "SELECT query_id, doc_id, score FROM scored WHERE score >= 0.5")
def min_score(spark, sf):
    return Course(spark, sf).scored(0.5).select("query_id", "doc_id", "score")


@query(_course("result_offset <> 0 OR result_limit = 0") + "SELECT query_id, position, doc_id, score FROM page")
def page_offset(spark, sf):
    return Course(spark, sf, "result_offset <> 0 OR result_limit = 0").page().drop("tier")


@query(_course(_MANY) + "SELECT query_id, position, doc_id, tier FROM page")
def tier_order(spark, sf):
    return Course(spark, sf, _MANY).page().drop("score")


# Every search query, by mode

_QUERIES_SQL = f"SELECT {_FIELDS}, language, include_snippet FROM search_queries"
for _name, _where in {
    "search_nofuzzy_allterms": "term_match = 'AllTerms' AND query_text LIKE '% %'", "search_nofuzzy_anyterms": "term_match = 'AnyTerm'",
    "search_single_token": "query_text NOT LIKE '% %'", "search_batch_nofuzzy": "true",
}.items():

    def _nofuzzy(spark, sf, where=_where):
        documents = Collection(table(spark, sf, "index_documents"), PLAIN, f"{sf}/index_documents")
        hits = search.search_tables(documents, table(spark, sf, "search_queries").where(where), PLAIN, QueryOptions(enable_fuzzy=False))
        return hits.select("query_id", "position", "doc_id", "score")

    query(course(f"SELECT * FROM ({_QUERIES_SQL}) WHERE {_where}", _INDEX_DOCUMENTS) + "SELECT query_id, position, doc_id, score FROM page", _name)(_nofuzzy)


# The index in a folder


def opened(spark: SparkSession, sf: str, options: IndexOptions = PLAIN) -> SearchIndex:
    """A new index in the shared folder, for the metadata of entries."""
    kind = table(spark, sf, "entries").schema["metadata"].dataType
    return SearchIndex.open(spark, new_folder(spark, "index"), replace(options, metadata_schema=kind))


def filled(spark: SparkSession, sf: str, options: IndexOptions = PLAIN) -> SearchIndex:
    """A new index with the log of entries. A first batch submits all ids with empty texts, so rowids are in the order of
    the ids, as the SQL numbers them; the second one, the whole log, replaces them all."""
    index = opened(spark, sf, options)
    entries = _entries(spark, sf)
    empty = [F.lit("").alias("content"), F.lit(None).cast(entries.schema["metadata"].dataType).alias("metadata"), F.lit(None).cast("string").alias("language")]
    index.add_range(entries.select("doc_id", *empty, F.lit(0).cast("bigint").alias("ord")).distinct())
    index.add_range(entries)
    return index


_LATEST = """
(SELECT doc_id, max_by(struct_pack(c := coalesce(content, ''), l := language, o := ord, m := metadata), struct_pack(o := ord, c := coalesce(content, ''), l := coalesce(language, ''))) AS e
  FROM entries GROUP BY doc_id)"""
_ENTRY_DOCUMENTS = f"SELECT row_number() OVER (ORDER BY doc_id) AS rowid, doc_id, e.c AS t, e.l AS lang FROM {_LATEST}"


def _answers(index: SearchIndex, queries: DataFrame) -> DataFrame:
    hits = index.search_batch(queries, QueryOptions(enable_fuzzy=False))
    return hits.select("query_id", F.col("position").cast("int").alias("position"), "doc_id", "score")


@query(course(_QUERIES_SQL, _ENTRY_DOCUMENTS) + "SELECT query_id, position, doc_id, score FROM page")
def search_stored_index(spark, sf):
    """An index is opened and filled by two changes, and answers every search query from its two segments."""
    return _answers(filled(spark, sf), table(spark, sf, "search_queries"))


_GONE = f"SELECT * FROM ({_ENTRY_DOCUMENTS}) WHERE doc_id NOT IN (SELECT doc_id FROM search_hits WHERE hit_pos = 1)"


@query(course(_QUERIES_SQL, _GONE) + "SELECT query_id, position, doc_id, score FROM page")
def optimize_keeps_results(spark, sf):
    """The same after many documents were removed and all segments were merged into one."""
    index = filled(spark, sf)
    index.remove_all(table(spark, sf, "search_hits").where("hit_pos = 1").select("doc_id"))
    index.optimize()
    return _answers(index, table(spark, sf, "search_queries"))


# Changes

_LAST = """
WITH latest AS (SELECT doc_id, max_by(struct_pack(c := coalesce(content, ''), l := language, o := ord), struct_pack(o := ord, c := coalesce(content, ''), l := coalesce(language, ''))) AS e
  FROM entries GROUP BY doc_id)
"""


@query(_LAST + "SELECT doc_id, e.o AS ord, e.c AS content, e.l AS language FROM latest")
def upsert_last_wins(spark, sf):
    kept = upsert.prepared(upsert.last_entries(_entries(spark, sf)), PLAIN)
    return kept.select("doc_id", "ord", "content", "language")


_LOG = "(SELECT * FROM entries UNION ALL SELECT * REPLACE (concat(doc_id, '-x') AS doc_id) FROM entries)"


@query(
    _LAST.replace("FROM entries", f"FROM {_LOG}") + ", cur AS (SELECT rowid, doc_id FROM index_documents), "
    "new AS (SELECT doc_id, e, row_number() OVER (ORDER BY e.o, doc_id) + (SELECT max(rowid) FROM cur) AS rowid FROM latest WHERE doc_id NOT IN (SELECT doc_id FROM cur)) "
    "SELECT rowid, doc_id, e.c AS text FROM latest JOIN cur USING (doc_id) UNION ALL SELECT rowid, doc_id, e.c FROM new "
    "UNION ALL SELECT rowid, doc_id, coalesce(content, rank_text) FROM index_documents WHERE doc_id NOT IN (SELECT doc_id FROM latest)"
)
def upsert_keeps_rowid(spark, sf):
    """The log of entries, and all of it once more under new ids, over the whole index: known ids keep their rowid, new ones count on."""
    entries = _entries(spark, sf)
    log = entries.unionByName(entries.withColumn("doc_id", F.concat("doc_id", F.lit("-x"))))
    merged = upsert.upserted(table(spark, sf, "index_documents"), upsert.prepared(upsert.last_entries(log), PLAIN))
    return merged.select("rowid", "doc_id", F.coalesce("content", "rank_text").alias("text"))


@query("SELECT DISTINCT doc_id FROM entries WHERE doc_id NOT IN (SELECT doc_id FROM search_hits WHERE hit_pos = 1)")
def remove_ids(spark, sf):
    index = filled(spark, sf)
    index.remove_all(table(spark, sf, "search_hits").where("hit_pos = 1").select("doc_id"))
    return index.documents().select("doc_id")


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM search_hits UNION ALL SELECT concat(doc_id, '-x') FROM entries) WHERE doc_id IN (SELECT doc_id FROM entries)")
def contains_ids(spark, sf):
    ids = table(spark, sf, "search_hits").select("doc_id").unionByName(table(spark, sf, "entries").select(F.concat("doc_id", F.lit("-x")).alias("doc_id")))
    return filled(spark, sf).contained(ids)


@query("SELECT count(DISTINCT doc_id) AS n FROM entries")
def count_docs(spark, sf):
    return spark.createDataFrame([(filled(spark, sf).count(),)], "n bigint")


@query("SELECT doc_id FROM entries WHERE false")
def clear_index(spark, sf):
    index = filled(spark, sf)
    index.clear()
    return index.documents().select("doc_id")


@query(_LAST + ", t AS (SELECT doc_id, unnest(" + _terms_sql("e.c") + ") AS term FROM latest) SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf FROM t GROUP BY doc_id, term")
def rebuild_equals_build(spark, sf):
    """Postings of an index after all changes, derived anew from the stored texts."""
    index = filled(spark, sf)
    index.rebuild()
    tables = index.tables()
    return tables.postings.where("stream = 'base'").join(tables.documents.select("rowid", "doc_id"), "rowid").select("doc_id", "term", "tf")


@query("SELECT true AS rejected, count(DISTINCT doc_id) AS documents FROM entries")
def batch_with_invalid_id_is_rejected(spark, sf):
    """A batch with one entry without id raises and adds nothing."""
    index, entries = filled(spark, sf), _entries(spark, sf)
    batch = entries.withColumn("doc_id", F.concat("doc_id", F.lit("-x"))).unionByName(entries.limit(1).withColumn("doc_id", F.lit("")))
    try:
        index.add_range(batch)
        rejected = False
    except ValueError:
        rejected = True
    return index.documents().agg(F.lit(rejected).alias("rejected"), F.count(F.lit(1)).alias("documents"))


@query("SELECT DISTINCT store_content, n FROM (SELECT 'false' AS store_content, (SELECT count(DISTINCT doc_id) FROM entries) AS n)")
def open_verifies_flags(spark, sf):
    """An index opened again has the flags and documents it was made with; other flags are refused."""
    index = filled(spark, sf, replace(PLAIN, store_content=False))
    again = SearchIndex.open(spark, index.path, index.options)
    try:
        SearchIndex.open(spark, index.path, replace(index.options, store_content=True))
        raise AssertionError("other flags were accepted")
    except SearchIndexError:
        return again.documents().agg(F.lit(index.options.flags()["store_content"]).alias("store_content"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, ord, metadata.Subject AS subject, metadata.From AS sender FROM entries")
def metadata_roundtrip(spark, sf):
    entries = _entries(spark, sf)
    kind = entries.schema["metadata"].dataType
    back = entries.select("doc_id", "ord", F.from_json(F.to_json("metadata"), kind).alias("m"))
    return back.select("doc_id", "ord", F.col("m.Subject").alias("subject"), F.col("m.From").alias("sender"))


def queries() -> dict[str, Query]:
    from lexwell import catalogue_languages, catalogue_published  # register their queries

    assert catalogue_languages and catalogue_published
    return dict(QUERY)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
