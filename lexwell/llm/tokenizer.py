"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.llm.common import environ_path, ship

DEFAULT_TOKENIZER = environ_path("LEXWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published pattern by which byte-level BPE vocabularies of this family cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from text to token ids, by the kind of the vocabulary file (.tiktoken, .json, .model)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    raise ValueError(f"unknown kind of tokenizer file: {path}")


def token_counts(df: DataFrame, record: str, text: str, keep: list[str] | None = None, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(record, keep..., tokens) of every row; null and empty texts have 0 tokens. No shuffle; rows repeat as they come."""
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(path)  # executors get the vocabulary from the driver, once
    name = os.path.basename(path)
    kept = [c for c in keep or [] if c != record]
    fields = [(record, "r"), *((c, f"k{i}") for i, c in enumerate(kept))]
    schema = ", ".join(f"{alias} {df.schema[c].dataType.simpleString()}" for c, alias in fields) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch["t"]]
            yield batch.drop(columns="t").assign(tokens=pd.Series(sizes, index=batch.index, dtype="int64"))

    rows = df.select(*(F.col(c).alias(alias) for c, alias in fields), F.col(text).alias("t"))
    counted = rows.mapInPandas(run, schema)
    return counted.select(*(F.col(alias).alias(c) for c, alias in fields), "tokens")
