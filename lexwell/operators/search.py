"""Search of many queries at once over index tables; a single search is a batch of one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from lexwell.operators.batch import search_packed
from lexwell.operators.packed import Collection
from lexwell.operators.postings import IndexTables
from lexwell.operators.rank import paged, scored, with_snippets
from lexwell.operators.recall import candidate_pool
from lexwell.plans.match import planned
from lexwell.schema import IndexOptions, QueryOptions
from lexwell.sources.checkpoint import saved


def search_tables(tables: IndexTables | Collection, queries: DataFrame, index: IndexOptions, query: QueryOptions) -> DataFrame:
    """(query_id, position, doc_id, metadata, score, tier, snippet) of every query's page.

    ``queries`` has query_id, query_text and any other columns of ``schema.QUERIES``; what is missing or null comes from
    ``query``. Blank queries and queries without tokens or trigrams have no rows. Rows with equal query ids are taken as
    one query written twice and must not occur. Tables are read by the terms of a few queries; a collection is packed for many.
    """
    if isinstance(tables, Collection):
        return search_packed(tables.packed(query.enable_fuzzy), planned(queries, index, query), query, index.fuzzy_ranker)
    plans = saved(planned(queries, index, query))
    pool = candidate_pool(plans, tables, query.candidate_pool_size)
    hits = scored(pool, plans, tables, query.enable_fuzzy, index.fuzzy_ranker, query.min_score)
    page = with_snippets(paged(hits, plans), plans, tables, query.snippet)
    return page.select("query_id", "position", "doc_id", "metadata", "score", "tier", "snippet")


def base_only(options: IndexOptions = IndexOptions()) -> IndexOptions:
    return replace(options, enable_stemming=False, enable_phonetic=False)
