"""Recall: which documents match the phrases of which query, with BM25, for many queries at once.

A search reads only the buckets of the postings its terms fall into, and of the texts only those of documents to verify.
All joins are on equal keys; adaptive execution splits the partitions of hot terms, small sides are broadcast by their
known size. Intermediate tables are written once and so have such a size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwell.functions.text import occurrences, trigrams
from lexwell.operators.postings import IndexTables, bucket_of, text_column
from lexwell.plans.match import phrases_of
from lexwell.sources.checkpoint import saved

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
DIGITS = 9  # ranks and scores are rounded, as sums of doubles depend on their order


def idf(n: int | Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5)), a tiny positive number where that is not positive."""
    value = F.log((F.lit(n) - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, F.lit(LEAST_IDF)).otherwise(value)


def saturated(f: Column, length: Column, average: float) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(average if average else 1.0)))


def pruned_postings(tables: IndexTables, keys: DataFrame) -> DataFrame:
    """The postings in the buckets of ``keys`` (stream, term): a filter on partitions, at most streams times buckets values."""
    wanted = keys.select("stream", bucket_of(tables.buckets, "stream", "term").alias("bucket")).distinct().collect()
    by_stream: dict[str, list[int]] = {}
    for r in wanted:
        by_stream.setdefault(r["stream"], []).append(r["bucket"])
    inside = F.lit(False)
    for stream, buckets in sorted(by_stream.items()):
        inside = inside | ((F.col("stream") == stream) & F.col("bucket").isin(sorted(buckets)))
    return tables.postings.where(inside)


def pruned_documents(tables: IndexTables, rowids: DataFrame) -> DataFrame:
    """The documents with these rowids, read from their buckets only; at most as many values as there are buckets."""
    wanted = [r["bucket"] for r in rowids.select(bucket_of(tables.buckets, "rowid").alias("bucket")).distinct().collect()]
    inside = tables.documents.where(F.col("bucket").isin(sorted(wanted)) if wanted else F.lit(False))
    return inside.join(rowids.select("rowid").distinct(), "rowid", "left_semi")


def phrase_shares(phrases: DataFrame, tables: IndexTables) -> DataFrame:
    """(query_id, rowid, share, base): what each phrase adds to the rank of each document that has it.

    ``base`` marks whole terms of the base stream, which alone count in the strict pass. A prefix phrase counts the terms
    it begins together: f is their sum, df the documents with any of them; each distinct prefix is looked up once.
    """
    whole = phrases.where(~F.col("is_prefix")).select("query_id", "stream", "term")
    keys = whole.select("stream", "term").distinct()
    postings = pruned_postings(tables, keys)
    counted = postings.join(keys, ["stream", "term"], "left_semi").groupBy("stream", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = saved(whole.join(counted, ["stream", "term"]).select("query_id", "stream", "term", idf(tables.n_docs, F.col("df")).alias("idf")))
    share = F.col("idf") * saturated(F.col("tf").cast("double"), F.col("dl"), tables.avg_dl)
    hits = weighted.join(postings, ["stream", "term"]).select("query_id", "rowid", share.alias("share"), (F.col("stream") == "base").alias("base"))
    prefixes = phrases.where("is_prefix").select("query_id", F.col("term").alias("prefix"))
    # Prefixes are one or two characters long: the terms are joined on their first characters.
    first = F.explode(F.array_distinct(F.array(F.substring("term", 1, 1), F.substring("term", 1, 2)))).alias("prefix")
    begun = saved(
        tables.term_stats.where(F.col("stream") == "base").select("stream", "term", first)
        .join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "stream", "term").distinct()
    )
    found = (
        pruned_postings(tables, begun).join(begun, ["stream", "term"])
        .groupBy("prefix", "rowid").agg(F.sum("tf").cast("double").alias("f"), F.first("dl").alias("dl"))
    )
    of_prefix = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("df"))
    share = idf(tables.n_docs, F.col("df")) * saturated(F.col("f"), F.col("dl"), tables.avg_dl)
    short = found.join(of_prefix, "prefix").join(prefixes, "prefix").select("query_id", "rowid", share.alias("share"), F.lit(False).alias("base"))
    return hits.unionByName(short)


def bm25(plans: DataFrame, tables: IndexTables) -> DataFrame:
    """(query_id, pass, rowid, rank): the any-term pass of each query and, where it has one, its strict pass.

    Lower ranks are better. Both passes come from one look-up: a document is in the strict pass if it has all whole base
    terms, and its rank there is the sum of their shares.
    """
    shares = phrase_shares(phrases_of(plans), tables)
    ranked = shares.groupBy("query_id", "rowid").agg(
        F.sum("share").alias("any"), F.sum(F.when(F.col("base"), F.col("share"))).alias("strict"), F.sum(F.col("base").cast("int")).alias("matched")
    )
    required = plans.select("query_id", "required")
    both = F.array(
        F.struct(F.lit("any").alias("pass"), F.col("any").alias("sum")),
        F.when((F.col("required") > 0) & (F.col("matched") == F.col("required")), F.struct(F.lit("strict").alias("pass"), F.col("strict").alias("sum"))),
    )
    each = ranked.join(required, "query_id").select("query_id", "rowid", F.explode(F.array_compact(both)).alias("p"))
    return each.select("query_id", "p.pass", "rowid", (-F.round("p.sum", DIGITS)).alias("rank"))


def best_of(df: DataFrame, keys: list[str], order: list[Column], most: int | Column) -> DataFrame:
    """The first ``most`` rows of each group; Spark limits each partition's groups before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def substring_hits(queries: DataFrame, tables: IndexTables) -> DataFrame:
    """(query_id, rowid, rank) of the documents whose text contains ``part``; queries: (query_id, part), part in lower case.

    Each distinct part is looked up once. Every document that contains it has its rarest trigram: the postings of that
    one alone are read. A part of three characters is its trigram, so its count is the answer; for longer parts the
    texts found are verified and counted.
    """
    parts = queries.select("part").distinct()
    grams = saved(parts.select("part", F.explode(F.array_distinct(trigrams(F.col("part")))).alias("term")).withColumn("stream", F.lit("trigram")))
    # The frequencies only choose a trigram: those of replaced documents may be among them.
    known = tables.term_stats.where(F.col("stream") == "trigram").select("term", "df")
    counted = grams.join(known.groupBy("term").agg(F.sum("df").alias("df")), "term", "left")
    rarest = saved(counted.groupBy("part", "stream").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term")))
    candidates = saved(pruned_postings(tables, rarest).join(rarest, ["stream", "term"]).select("part", "rowid", F.col("tf").cast("double").alias("f"), "dl"))
    exact = F.length("part") == 3
    doubtful = candidates.where(~exact)
    low = pruned_documents(tables, doubtful).select("rowid", F.lower(text_column()).alias("low"))
    verified = (
        doubtful.join(low, "rowid").where(F.contains(F.col("low"), F.col("part")))
        .select("part", "rowid", occurrences(F.col("low"), F.col("part")).cast("double").alias("f"), "dl")
    )
    return ranked_substrings(candidates.where(exact).unionByName(verified), tables).join(queries, "part").select("query_id", "rowid", "rank")


def ranked_substrings(verified: DataFrame, tables: IndexTables) -> DataFrame:
    verified = saved(verified)
    counted = verified.groupBy("part").agg(F.count(F.lit(1)).alias("df"))
    share = idf(tables.n_docs, F.col("df")) * saturated(F.col("f"), F.col("dl"), tables.avg_tri)
    return verified.join(counted, "part").select("part", "rowid", (-F.round(share, DIGITS)).alias("rank"))


def candidate_pool(plans: DataFrame, tables: IndexTables, pool: int) -> DataFrame:
    """(query_id, rowid, tier, rank): at most ``pool`` candidates a query, strict matches (tier 0) before others.

    Strict matching applies to queries for all terms with more than one token; if it finds fewer than the limit,
    documents with any term are added. Substring hits join the tier of the any-term matches. A document in both tiers
    keeps the better tier and the lower rank.
    """
    order = [F.col("rank"), F.col("rowid")]
    ranked = saved(best_of(bm25(plans, tables), ["query_id", "pass"], order, pool))
    strict = ranked.where("pass = 'strict'").select("query_id", "rowid", "rank")
    found = strict.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    gated = plans.where("required > 0").join(found, "query_id", "left").where(F.coalesce("found", F.lit(0)) >= F.greatest("result_limit", F.lit(0)))
    loose = ranked.where("pass = 'any'").join(gated.select("query_id"), "query_id", "left_anti").select("query_id", "rowid", "rank")
    parts = plans.where(F.col("part").isNotNull()).select("query_id", "part")
    substrings = best_of(substring_hits(parts, tables), ["query_id"], order, pool)
    # Where there is no strict pass, its tier stays empty: the order is the same with any-term matches in tier 1.
    tiers = strict.withColumn("tier", F.lit(0)).unionByName(loose.withColumn("tier", F.lit(1))).unionByName(substrings.withColumn("tier", F.lit(1)))
    merged = tiers.groupBy("query_id", "rowid").agg(F.min("tier").alias("tier"), F.min("rank").alias("rank"))
    return best_of(merged, ["query_id"], [F.col("tier"), F.col("rank"), F.col("rowid")], pool)
