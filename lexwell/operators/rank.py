"""Ranking of a candidate pool: normalization, fuzzy blend, boost, order, page, snippets.

Texts are read for candidates only, and each text meets all queries it is a candidate of at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexwell.functions.fuzzy import TokenSet
from lexwell.functions.snippet import build_snippet
from lexwell.functions.text import fold
from lexwell.operators.postings import IndexTables, text_column
from lexwell.operators.recall import DIGITS, pruned_documents
from lexwell.plans.match import query_tokens
from lexwell.schema import SnippetOptions
from lexwell.sources.checkpoint import saved
from lexwell.sources.shipping import ship

FUZZY_SHARE, BOOST = 0.6, 0.15
QUERIES_A_ROW = 5_000  # about how many queries one row of a text holds; a text that more queries find has several rows


def normalized(pool: DataFrame) -> DataFrame:
    """Adds ``norm``: 1 for the best rank of a query's pool, 0 for the worst, 1 if all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("rank").over(w), F.max("rank").over(w)
    return pool.withColumn("norm", F.when(high == low, 1.0).otherwise((high - F.col("rank")) / (high - low)))


def _fuzzy(ranker: Callable[[str, str], float] | None):
    """Scores of one text for each query of a list."""

    @F.pandas_udf("array<double>")
    def fuzzy(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, queries in parts:
            out = []
            for text, asked in zip(texts, queries):
                score = TokenSet(text).score if ranker is None else (lambda q, t=text: float(ranker(q, t)))
                out.append([score(q) for q in asked])
            yield pd.Series(out, dtype=object)

    return fuzzy


def scored(pool: DataFrame, queries: DataFrame, tables: IndexTables, enable_fuzzy: bool, ranker=None, min_score: float = 0.0) -> DataFrame:
    """(query_id, rowid, doc_id, tier, score) of the candidates at or above ``min_score``.

    A query contained in the text, both folded, is worth 0.15 more, up to 1.
    """
    ship(pool.sparkSession)
    asked = queries.select("query_id", "query_text", fold(F.col("query_text")).alias("folded"))
    candidates = saved(normalized(pool).join(asked, "query_id").select("query_id", "rowid", "tier", "norm", "query_text", "folded"))
    rows = max(1, -(-queries.count() // QUERIES_A_ROW))
    entry = F.struct("query_id", "tier", "norm", "query_text", "folded")
    # Dealt by a fixed number of tasks: by size alone few tasks would get all candidates, whose ranking is what costs time.
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = (
        candidates.repartition(tasks, "rowid", F.pmod(F.xxhash64("query_id"), F.lit(rows)).alias("row"))
        .groupBy("rowid", F.pmod(F.xxhash64("query_id"), F.lit(rows)).alias("row")).agg(F.collect_list(entry).alias("asked"))
    )
    documents = pruned_documents(tables, candidates).select("rowid", "doc_id", text_column().alias("text"), fold(text_column()).alias("folded"))
    found = grouped.join(documents, "rowid")
    exact = F.transform("asked", lambda q: (F.length(q["folded"]) > 0) & F.contains(F.col("folded"), q["folded"]))
    fuzzy = _fuzzy(ranker)("text", F.col("asked.query_text")) if enable_fuzzy else F.transform("asked", lambda q: F.lit(0.0))
    each = found.select("rowid", "doc_id", F.explode(F.arrays_zip(F.col("asked").alias("q"), exact.alias("exact"), fuzzy.alias("fuzzy"))).alias("e"))
    norm = F.col("e.q.norm")
    plain = FUZZY_SHARE * F.col("e.fuzzy") + (1 - FUZZY_SHARE) * norm if enable_fuzzy else norm
    score = F.round(F.when(F.col("e.exact"), F.least(F.lit(1.0), plain + BOOST)).otherwise(plain), DIGITS)
    hits = each.select(F.col("e.q.query_id").alias("query_id"), "rowid", "doc_id", F.col("e.q.tier").alias("tier"), score.alias("score"))
    return hits.where(F.col("score") >= min_score)


def paged(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``position`` (1-based over all hits) and keeps each query's page: skip the offset, take the limit."""
    w = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "doc_id")
    first = F.greatest(F.coalesce("result_offset", F.lit(0)), F.lit(0))
    last = first + F.greatest(F.coalesce("result_limit", F.lit(0)), F.lit(0))
    limits = queries.select("query_id", first.alias("first"), last.alias("last"))
    return (
        hits.withColumn("position", F.row_number().over(w))
        .join(limits, "query_id")
        .where((F.col("position") > F.col("first")) & (F.col("position") <= F.col("last")))
        .drop("first", "last")
    )


def with_snippets(page: DataFrame, queries: DataFrame, tables: IndexTables, options: SnippetOptions) -> DataFrame:
    """Adds ``metadata`` and ``snippet`` to the rows of a page; the snippet is null unless the query wants one and the content is stored."""
    ship(page.sparkSession)

    @F.pandas_udf("string")
    def snippet(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, content in parts:
            yield pd.Series([build_snippet(c, query_tokens(q), options) if isinstance(c, str) else None for q, c in zip(query, content)], dtype=object)

    page = saved(page)
    documents = pruned_documents(tables, page).select("rowid", "metadata", "content")
    wanted = queries.select("query_id", "query_text", F.coalesce("include_snippet", F.lit(False)).alias("want"))
    joined = page.join(wanted, "query_id").join(documents, "rowid").withColumn("content", F.when(F.col("want"), F.col("content")))
    return joined.withColumn("snippet", snippet("query_text", "content")).drop("want", "content", "query_text")
