"""The queries p1 to p10 over whole tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwell.functions.stopwords import STOP_WORDS
from lexwell.llm import canonical, distinctive, frequency, language, mail, mixing, mojibake, neardup, packing, tokenizer, webspam
from lexwell.llm.common import saved, table

Query = Callable[[SparkSession, str], DataFrame]


def _samples(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """The labelled texts, a fixed table of some hundred rows."""
    return [(r["language"], r["text"]) for r in table(spark, sf, "language_samples").select("language", "text").orderBy("sample_id").collect()]


def _text():
    return F.coalesce("content", "rank_text")


# Problem 1


def _mails(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "index_documents").where("doc_id LIKE 'mail-%' AND content IS NOT NULL")


def _mail_lines(spark: SparkSession, sf: str) -> DataFrame:
    mails = _mails(spark, sf).select("rowid", "content", F.get_json_object("metadata", "$.From").alias("sender"))
    return mail.newly_written(mails, "rowid", "content", "sender", _samples(spark, sf))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    lines = _mail_lines(spark, sf).where("other").select("rowid", "line_no")
    marked = mail.reply_subjects(_mails(spark, sf).select("rowid", F.get_json_object("metadata", "$.Subject").alias("subject")), "rowid", "subject")
    return lines.unionByName(marked.select("rowid", F.lit(0).alias("line_no")))


def p1_new_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each mail reduced to what its sender newly wrote."""
    return mail.reduced(_mail_lines(spark, sf), "rowid")


def p1_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of each mail with their class."""
    return mail.blocks(_mail_lines(spark, sf), "rowid").withColumn("probability", F.round("probability", 4))


# Problem 2


def _languages(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    samples = _samples(spark, sf)
    words = [(code, " ".join(sorted(STOP_WORDS[code]))) for code in sorted({code for code, _ in samples} & STOP_WORDS.keys())]
    return language.languages(docs.withColumn("text", _text()), "rowid", "text", samples + words, language.normal_label(F.col("language")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _languages(spark, sf, table(spark, sf, "index_documents").where("content IS NOT NULL")).where(
        (F.size("segments") > 1) | ((F.size("segments") == 1) & (F.col("label").isNull() | ((F.col("label") != F.col("language")) & (F.col("margin") >= 1.0))))
    )
    return found.select("rowid", F.explode("segments").alias("s")).select("rowid", "s.seg_no", "s.lang")


def p2_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of every record with its language and confidence, beside those of the record; a record without words has one row."""
    found = _languages(spark, sf, table(spark, sf, "index_documents"))
    rows = found.select("rowid", "label", "language", "confidence", F.size("segments").alias("stretches"), F.explode_outer("segments").alias("s"))
    return rows.select(
        "rowid", "label", "language", F.round("confidence", 4).alias("confidence"), "stretches", "s.seg_no", "s.lang",
        F.round("s.confidence", 4).alias("seg_confidence"), "s.words",
    )


# Problem 3


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "index_documents")
    n = docs.where("length(rank_text) > 0").count()
    return frequency.marked(frequency.term_frequencies(docs, "rank_text"), n)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(spark, sf).where("mark IS NOT NULL").select("term", "mark")


def p3_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(spark, sf)


_TERMS = r"""
WITH texts AS (SELECT rowid AS id, rank_text AS t FROM index_documents WHERE rank_text <> ''),
terms AS (SELECT id, unnest(list_transform(regexp_extract_all(t, '[\p{L}\p{Nd}]+'), lambda w: lower(w))) AS term FROM texts),
counted AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
total AS (SELECT count(*) AS n FROM texts),
spread AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS gf, sum(tf * ln(tf)) AS e FROM counted GROUP BY term)
"""
_FREQUENCIES = _TERMS + """, marks AS (SELECT term, gf AS occurrences, df AS records,
  CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.15 * n THEN 'common' END AS mark FROM spread, total)
"""


# Problem 4


def _weighted(spark: SparkSession, sf: str, least: int) -> tuple[DataFrame, int]:
    docs = table(spark, sf, "index_documents")
    n = docs.where("length(rank_text) > 0").count()
    return distinctive.log_entropy(docs, "rowid", "rank_text", n, least), n


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    weighted, n = _weighted(spark, sf, 2)
    score = F.round((1 + F.log(F.col("tf").cast("double"))) * F.log(F.lit(float(n)) / F.col("df")), 6)
    return distinctive.most_characteristic(weighted, score).select(F.col("record").alias("rowid"), "term")


def p4_log_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Log-entropy weight of every term of every record."""
    weighted, _ = _weighted(spark, sf, 1)
    return weighted.select(F.col("record").alias("rowid"), "term", "tf", "df", "gf", F.round("weight", 6).alias("weight"))


# Problem 5


def _repaired(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "index_documents").where("content IS NOT NULL")
    return mojibake.repaired(docs, "rowid", "content", _samples(spark, sf)).where("affected")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf).select("rowid")


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf).select("rowid", "restored", "operations")


# Problem 6


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.same_looking_pairs(table(spark, sf, "index_documents"), "rowid", _text())


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record: the class of its form, that of its text, and how many texts and records these hold."""
    classes = canonical.form_classes(table(spark, sf, "index_documents"), "rowid", _text())
    return canonical.variants(classes, "rowid")


def p6_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in its one form."""
    canonical.ship(spark)
    docs = table(spark, sf, "index_documents").select("rowid", _text().alias("text"))
    return docs.select("rowid", canonical.canonical_column(F.col("text")).alias("canonical"))


# Problem 7


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "index_documents")
    members, pairs = neardup.near_duplicates(docs, "rowid", "content", size=3, similarity=0.5, min_tokens=12)
    return neardup.record_pairs(members, pairs).select(F.col("a").alias("rowid_a"), F.col("b").alias("rowid_b"))


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its class of equal shingle sets, the size of the class and its links to other classes.

    Shingles of five words, similarity 0.8, over the texts of documents; shorter texts form classes of equal words.
    """
    docs = table(spark, sf, "documents")
    members, pairs = neardup.near_duplicates(docs, "doc_id", "text")
    return neardup.linked(members.unionByName(neardup.short_texts(docs, "doc_id", "text", 5)), pairs).withColumnRenamed("record", "doc_id")


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    """(rowid, group): records of index_documents joined by chains of pairs of p7_found, the group named by its lowest rowid."""
    docs = table(spark, sf, "index_documents")
    members, pairs = neardup.near_duplicates(docs, "rowid", "content", size=3, similarity=0.5, min_tokens=12)
    return neardup.groups(members, pairs).withColumnRenamed("record", "rowid")


# Problem 8


def _capacities(spark: SparkSession, sf: str) -> list[tuple[int, int]]:
    return [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, sf, "pack_sizes").orderBy("pack_id").collect()]


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = saved(tokenizer.token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    return packing.packed(sizes, "doc_id", "tokens", _capacities(spark, sf)).withColumnRenamed("size", "tokens")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each capacity are."""
    sizes = saved(tokenizer.token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    return packing.fill(packing.packed(sizes, "doc_id", "tokens", _capacities(spark, sf)), _capacities(spark, sf))


def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of each packing: every document is in it once, none above the capacity, only larger ones are divided."""
    sizes = saved(tokenizer.token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    capacities = spark.createDataFrame(_capacities(spark, sf), "pack_id int, capacity bigint")
    rows = saved(packing.packed(sizes, "doc_id", "tokens", _capacities(spark, sf)).join(F.broadcast(capacities), "pack_id"))
    items = rows.groupBy("pack_id", "doc_id", "capacity").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).join(sizes, "doc_id")
    of_items = items.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("size") != F.col("tokens"), 1)).alias("incomplete"),
        F.count(F.when((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity")), 1)).alias("divided"),
    )
    loads = rows.groupBy("pack_id", "container", "capacity").agg(F.sum("size").alias("load"))
    return of_items.join(loads.groupBy("pack_id").agg(F.count(F.when(F.col("load") > F.col("capacity"), 1)).alias("overfull")), "pack_id")


# Problem 9


def _mix(spark: SparkSession, sf: str) -> DataFrame:
    sizes = saved(tokenizer.token_counts(table(spark, sf, "documents"), "doc_id", "text", ["source"]))
    weights = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf, "source_weights").collect()]
    return mixing.mixed(sizes, "doc_id", "source", "tokens", weights)[0]


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(_mix(spark, sf), "source", "tokens", table(spark, sf, "source_weights"))


def p9_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the mixture: for each source that takes part, no record is used too often, and no copy comes twice."""
    mix = _mix(spark, sf)
    uses = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.max("copy").alias("last"))
    weights = table(spark, sf, "source_weights").select("source", "max_repeats")
    return uses.join(F.broadcast(weights), "source").groupBy("source").agg(
        F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("too_often"), F.count(F.when(F.col("uses") != F.col("last"), 1)).alias("twice")
    )


# Problem 10


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    measures = saved(webspam.page_measures(table(spark, sf, "documents"), "doc_id", "text", _samples(spark, sf)))
    return webspam.keyword_pages(measures)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).where("spam").select("doc_id")


def p10_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with its measures and signs."""
    pages = _pages(spark, sf)
    return pages.select("doc_id", "language", "signs", "spam", *(F.round(m, 6).alias(m) for m in webspam.MEASURES))


def queries() -> dict[str, Query]:
    listed = (
        p1_found, p1_blocks, p1_new_text, p2_found, p2_languages, p3_found, p3_frequencies, p4_found, p4_log_entropy, p5_found, p5_restored, p6_found,
        p6_classes, p6_canonical, p7_found, p7_classes, p7_groups, p8_containers, p8_fill, p8_whole, p9_mixture, p9_shares, p9_whole, p10_found, p10_signs,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "p8_whole": "SELECT pack_id, count(doc_id) AS documents, 0 AS incomplete, 0 AS divided, 0 AS overfull FROM pack_sizes, documents GROUP BY pack_id",
        "p9_whole": "SELECT DISTINCT source, 0 AS too_often, 0 AS twice FROM source_weights JOIN documents USING (source) WHERE length(text) > 0",
        "p3_found": _FREQUENCIES + "SELECT term, mark FROM marks WHERE mark IS NOT NULL",
        "p3_frequencies": _FREQUENCIES + "SELECT term, occurrences, records, mark FROM marks",
        "p4_found": _TERMS
        + """, scored AS (SELECT id AS rowid, term, round((1 + ln(tf)) * ln(CAST(n AS DOUBLE) / df), 6) AS score
  FROM counted JOIN spread USING (term), total WHERE df >= 2)
SELECT rowid, term FROM scored QUALIFY score = max(score) OVER (PARTITION BY rowid)""",
        "p4_log_entropy": _TERMS
        + """SELECT id AS rowid, term, tf, df, gf, round(ln(1 + tf) * (1 - (ln(gf) - e / gf) / ln(greatest(n, 2))), 6) AS weight
  FROM counted JOIN spread USING (term), total""",
        "p7_found": r"""
WITH d AS (SELECT rowid AS id, regexp_extract_all(lower(content), '[\p{L}\p{Nd}]+') AS w FROM index_documents WHERE content IS NOT NULL),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 12)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2)
SELECT a AS rowid_a, b AS rowid_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.5 * (x.n + y.n - k)""",
    }
