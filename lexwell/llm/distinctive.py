"""Problem 4: how characteristic each term is of a record, compared with the whole collection.

Method: log-entropy weighting by two aggregations. The first gives tf by (record, term). The second gives, by term, the
records df, the total gf and the sum of tf ln tf, from which the entropy of the term's spread over records follows as
ln gf - sum(tf ln tf) / gf. The weight is ln(1 + tf) times one minus the entropy divided by ln n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexwell.llm.common import saved, tokens

MOST_HOT = 200_000  # terms whose statistics are broadcast, some 20 MB


def term_counts(df: DataFrame, record: str, text: str) -> DataFrame:
    """First aggregation: (record, term, tf). Rows with the same record id add up; null or empty texts give no row."""
    exploded = df.where(F.length(text) > 0).select(F.col(record).alias("record"), F.explode(tokens(F.col(text))).alias("term"))
    return exploded.groupBy("record", "term").agg(F.count(F.lit(1)).alias("tf"))


def log_entropy(df: DataFrame, record: str, text: str, n_records: int, min_records: int = 1, hot_share: float = 0.001) -> DataFrame:
    """(record, term, tf, df, gf, weight) of each term of each record that occurs in at least ``min_records`` records.

    The counts of records and terms are written once. The statistics of a term are joined back to them. Terms in more than
    ``hot_share`` of the records would each fill one task of such a join; they are joined by broadcasting, all others by
    shuffling. There are at most (mean terms of a record) / hot_share of the former; of long records these are many, so
    the share is raised until their number, which is counted, is at most ``MOST_HOT``. A term spread evenly over all records
    gets weight 0; a collection of one record has no spread and gets entropy 0.
    """
    counts = saved(term_counts(df, record, text))
    tf, gf = F.col("tf").cast("double"), F.col("gf")
    spread = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(tf * F.log(tf)).alias("tf_ln_tf")
    ).where(F.col("df") >= min_records)
    entropy = (F.log(gf.cast("double")) - F.col("tf_ln_tf") / gf) / F.log(F.lit(float(max(n_records, 2))))
    statistics = saved(spread.select("term", "df", "gf", (1 - entropy).alias("global_weight")))
    while statistics.where(F.col("df") > hot_share * n_records).count() > MOST_HOT:
        hot_share *= 2
    hot = statistics.where(F.col("df") > hot_share * n_records)
    cold = statistics.where(F.col("df") <= hot_share * n_records)
    joined = counts.join(F.broadcast(hot), "term").unionByName(
        counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(cold, "term")
    )
    return joined.select("record", "term", "tf", "df", "gf", (F.log1p(tf) * F.col("global_weight")).alias("weight"))


def most_characteristic(weighted: DataFrame, score) -> DataFrame:
    """The rows with the highest ``score`` (a column) of each record, ties included."""
    best = Window.partitionBy("record")
    return (
        weighted.withColumn("score", score)
        .withColumn("best", F.max("score").over(best))
        .where(F.col("score") == F.col("best"))
        .drop("best")
    )
