"""Problem 3: how often every term occurs and in how many records, with marks for rare and common terms.

Method: last-seen counters. Each task walks its tokens in record order; a term stores its occurrences, its records and
the last record it was seen in, so that no set of records is kept per term. The counters of the tasks are then summed
by term. A task's table of counters is handed on whenever it holds ``max_terms`` terms, so memory is bounded whatever
the vocabulary, and hot terms reach the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.llm.common import ship, tokens

COUNTED = "term string, occurrences bigint, records bigint"


class LastSeen:
    """Occurrences, records and last record of each term; records come in one after the other."""

    def __init__(self) -> None:
        self.counters: dict[str, list[int]] = {}

    def add(self, terms: pa.Array, record: np.ndarray) -> None:
        """``record`` holds the record number of each term and does not fall."""
        coded = terms.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if not len(codes):
            return
        order = np.argsort(codes, kind="stable")  # by term, within it by record
        code, seen = codes[order], record[order]
        first = np.r_[True, code[1:] != code[:-1]]
        new = first | np.r_[True, seen[1:] != seen[:-1]]  # another record than the last one this term was seen in
        starts = np.flatnonzero(first)
        occurrences = np.diff(np.r_[starts, len(code)])
        records = np.add.reduceat(new.astype(np.int64), starts)
        last = seen[np.r_[starts[1:], len(code)] - 1]
        names, at = coded.dictionary.to_pylist(), code[starts]
        for k, n, r, f, z in zip(at.tolist(), occurrences.tolist(), records.tolist(), seen[starts].tolist(), last.tolist()):
            old = self.counters.get(names[k])
            if old is None:
                self.counters[names[k]] = [n, r, z]
            else:
                old[0] += n
                old[1] += r - (f == old[2])
                old[2] = z

    def drain(self) -> pa.RecordBatch:
        kept, self.counters = self.counters, {}
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(kept), pa.string()),
                pa.array([x[0] for x in kept.values()], pa.int64()),
                pa.array([x[1] for x in kept.values()], pa.int64()),
            ],
            names=["term", "occurrences", "records"],
        )


def _counting(max_terms: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, row = LastSeen(), 0
        for batch in batches:
            lists = batch.column(0)
            lengths = np.diff(lists.offsets.to_numpy())
            seen.add(lists.flatten(), row + np.repeat(np.arange(len(lengths)), lengths))
            row += len(lengths)
            if len(seen.counters) >= max_terms:
                yield seen.drain()
        yield seen.drain()

    return count


def term_frequencies(df: DataFrame, text: str, max_terms: int = 400_000) -> DataFrame:
    """(term, occurrences, records) of every distinct token of column ``text``.

    Every row is one record; null and empty texts hold no term; a repeated row counts as a record of its own. Columns
    other than ``text`` are not read, so their names cannot clash. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    lists = df.where(F.length(text) > 0).select(tokens(F.col(text)).alias("terms"))
    counted = lists.mapInArrow(_counting(max_terms), COUNTED)
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, n_records: int, rare_records: int = 2, common_share: float = 0.15) -> DataFrame:
    """Adds ``mark``: ``rare`` up to ``rare_records`` records, else ``common`` above that share of all records, else null."""
    return frequencies.withColumn(
        "mark",
        F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * n_records, "common"),
    )
