"""The inverted index as DataFrames: postings, lengths of documents, frequencies of terms, totals of the corpus.

Postings are (stream, term, rowid, tf, dl), stream one of base, stem, phonetic, trigram. ``dl`` is the length a match of the
stream is weighed by: the number of terms of the document in all text streams, for trigrams the number of its trigrams. It
is the same for all rows of a document, so a search needs no table of lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwell.functions.text import terms, tokens
from lexwell.operators.analysis import Vocabulary
from lexwell.schema import IndexOptions
from lexwell.sources.shipping import ship

POSTINGS = "stream string, term string, rowid bigint, tf int, dl bigint"
DOCUMENT = "document"  # the stream of one row a document: tf its trigrams, dl its terms
PIECE_CHARS = 1 << 20  # how much text is turned into postings at a time


@dataclass(frozen=True)
class IndexTables:
    """What a search reads. ``documents`` and ``postings`` have a column ``bucket``, by which stored tables are pruned."""

    documents: DataFrame  # rowid, doc_id, language, metadata, rank_text, content, bucket
    postings: DataFrame  # stream, term, rowid, tf, dl, bucket
    term_stats: DataFrame  # stream, term, df
    n_docs: int
    avg_dl: float
    avg_tri: float
    buckets: int = 1


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def text_column() -> Column:
    return F.coalesce("content", "rank_text", F.lit(""))


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select("rowid", "language", text_column().alias("text"))


def _counted(row: np.ndarray, values: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, value, count) of each distinct pair."""
    coded = values.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key, count = np.unique(row.astype(np.int64) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return key // size, coded.dictionary.take(pa.array(key % size)), count


def _grams(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, trigram, count) of each distinct trigram of each text; three code points are packed into one number."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    inside = row[2:] == row[:-2]
    packed = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[inside]
    grams, at = np.unique(packed, return_inverse=True)
    key, count = np.unique(row[2:][inside].astype(np.int64) * max(len(grams), 1) + at, return_counts=True)
    parts = np.stack([(grams >> np.uint64(s)) & np.uint64((1 << 21) - 1) for s in (42, 21, 0)], 1).astype(np.uint32)
    listed = parts.tobytes().decode("utf-32-le", "surrogatepass")
    names = pa.array([listed[i : i + 3] for i in range(0, len(listed), 3)], pa.string())
    return key // max(len(grams), 1), names.take(pa.array(key % max(len(grams), 1))), count


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``PIECE_CHARS`` characters, at least one row each."""
    ends = np.cumsum(batch.column("chars").to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + PIECE_CHARS, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _writing(options: IndexOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(options)
        schema = pa.schema([("stream", pa.string()), ("term", pa.string()), ("rowid", pa.int64()), ("tf", pa.int32()), ("dl", pa.int64())])
        for batch in batches:
            for piece in _pieces(batch):
                ids = piece.column("rowid").to_numpy(zero_copy_only=False)
                lists = piece.column("terms")
                lengths = np.diff(lists.offsets.to_numpy())
                found = {"base": _counted(np.repeat(np.arange(len(ids)), lengths), lists.flatten())}
                dl = lengths.astype(np.int64)
                if vocabulary.derives:
                    derived = vocabulary.streams(piece.column("language").to_pylist(), piece.column("words").to_pylist())
                    for stream, (row, term, count) in derived.items():
                        found[stream] = row, pa.array(term, pa.string()), count
                        np.add.at(dl, row, count)
                n_grams = np.zeros(len(ids), np.int64)
                if options.enable_trigram:
                    texts = piece.column("low").to_pylist()
                    n_grams = np.maximum(np.array([len(t) for t in texts], np.int64) - 2, 0)
                    found["trigram"] = _grams(texts)
                for stream, (row, term, count) in found.items():
                    if len(row):
                        length = (n_grams if stream == "trigram" else dl)[row]
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(stream, len(row)), term, pa.array(ids[row]), pa.array(count.astype(np.int32)), pa.array(length)], schema=schema
                        )
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(DOCUMENT, len(ids)), pa.repeat("", len(ids)), pa.array(ids), piece.column("grams").cast(pa.int32()), pa.array(dl)],
                    schema=schema,
                )

    return run


def all_postings(documents: DataFrame, options: IndexOptions) -> DataFrame:
    """Postings of all streams of the documents, and one row a document in the stream ``DOCUMENT``.

    One pass without a shuffle: texts are cut into terms in the JVM, terms of a document are counted in Arrow batches.
    Empty and null texts give the row of the document only.
    """
    ship(documents.sparkSession)
    text = F.col("text")
    derives = Vocabulary(options).derives
    words = F.array_distinct(tokens(text)) if derives else F.array().cast("array<string>")
    low = F.lower(text) if options.enable_trigram else F.lit("")
    rows = texts_of(documents).select(
        "rowid", F.lower("language").alias("language"), terms(text).alias("terms"), words.alias("words"), low.alias("low"),
        F.length("text").cast("bigint").alias("chars"), F.greatest(F.length("text") - 2, F.lit(0)).alias("grams"),
    )
    return rows.mapInArrow(_writing(options), POSTINGS)


def postings_of(documents: DataFrame, options: IndexOptions) -> DataFrame:
    """(stream, term, rowid, tf) of the text streams."""
    return all_postings(documents, options).where(~F.col("stream").isin(DOCUMENT, "trigram")).select("stream", "term", "rowid", "tf")


def doc_stats_of(everything: DataFrame) -> DataFrame:
    """(rowid, dl, tri_len): each document's number of terms over all text streams and of trigrams."""
    return everything.where(F.col("stream") == DOCUMENT).select("rowid", "dl", F.col("tf").cast("bigint").alias("tri_len"))


def term_stats_of(postings: DataFrame) -> DataFrame:
    """(stream, term, df) of postings."""
    return postings.where(F.col("stream") != DOCUMENT).groupBy("stream", "term").agg(F.count(F.lit(1)).alias("df"))


def totals_of(doc_stats: DataFrame) -> tuple[int, int, int]:
    """Documents, terms and trigrams together."""
    row = doc_stats.agg(F.count(F.lit(1)), F.sum("dl"), F.sum("tri_len")).first()
    return int(row[0]), int(row[1] or 0), int(row[2] or 0)


def tables_of(documents: DataFrame, postings: DataFrame, term_stats: DataFrame, totals: tuple[int, int, int], buckets: int) -> IndexTables:
    n, dl, tri = totals
    return IndexTables(documents, postings, term_stats, n, dl / n if n else 0.0, tri / n if n else 0.0, buckets)


def build_tables(documents: DataFrame, options: IndexOptions) -> IndexTables:
    """Tables that are computed when they are read; for small collections and tests. Stored ones are made by ``Store``."""
    postings = all_postings(documents, options)
    bucketed = postings.where(F.col("stream") != DOCUMENT).withColumn("bucket", bucket_of(1, "stream", "term"))
    return tables_of(documents.withColumn("bucket", bucket_of(1, "rowid")), bucketed, term_stats_of(postings), totals_of(doc_stats_of(postings)), 1)
