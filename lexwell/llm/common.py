"""Helpers shared by the operators: tables, tokens, checkpoints and shipping the package to workers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwell.sources.checkpoint import saved
from lexwell.sources.shipping import ship

__all__ = ["environ_path", "saved", "ship", "table", "tokens"]
TOKEN = r"[\p{L}\p{Nd}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokens(text: Column) -> Column:
    """Tokens of a text in order: maximal runs of letters and decimal digits, lower-cased; null gives null.

    Lower-casing the text first is the fast way; it gives the same tokens except where lower-casing a letter yields
    a mark (U+0130), so texts with that letter are cut first and lower-cased afterwards.
    """
    pattern, zero = F.lit(TOKEN), F.lit(0)
    return F.when(
        F.contains(text, F.lit("İ")), F.transform(F.regexp_extract_all(text, pattern, zero), lambda t: F.lower(t))
    ).otherwise(F.regexp_extract_all(F.lower(text), pattern, zero))


def environ_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
