"""A packed copy of a collection, for batches of queries: files that each worker maps into its memory and reads in place.

Rows of (term, document) cost many bytes each when they are shuffled and written. Here each task turns its documents into
chunks: one file of their texts and lengths, and one row a term with its documents (two bytes each) and counts (one byte).
The rows are shuffled once by term and written as files of whole posting lists. Beside the streams of the index there are

- ``low`` and ``fold``: the runs of letters and digits of the lower-cased text and, where it differs, of the folded one. A
  part of a text is found by the runs it consists of, with the trigrams of the few distinct runs, not those of all texts;
- ``low|`` and ``fold|``: what meets between two runs, the last two characters of one and the first two of the next;
- ``raw``: the words of the text between blanks, which fuzzy ranking compares.

Files are read by paths of the shared folder: in place if it is a local one, else from a copy each machine makes once.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.functions.text import TERM, all_accents, fold, fold_terms, terms, tokens
from lexwell.operators.analysis import Vocabulary
from lexwell.operators.postings import text_column
from lexwell.schema import IndexOptions
from lexwell.sources.checkpoint import new_folder
from lexwell.sources.shipping import ship

CHUNK_CHARS, CHUNK_DOCS = 6 << 20, 1 << 16  # of a chunk; places in it have 16 bits
FILE_BYTES = 12 << 20
_ROW = pa.schema([("stream", pa.string()), ("term", pa.string()), ("chunk", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
_ROWS = "stream string, term string, chunk bigint, places binary, counts binary"
FILE = "#file"  # the stream of rows that name a written file
MORE = "^"  # a stream with this at its end has what counts are above 255, divided by 256


@dataclass(frozen=True)
class PackedIndex:
    """``chunks``: (number, file) of the documents; ``lists``: (stream, file) of the posting lists."""

    folder: str
    chunks: tuple[tuple[int, str], ...]
    lists: tuple[tuple[str, str], ...]
    n_docs: int
    avg_dl: float
    avg_tri: float


@dataclass(frozen=True)
class Collection:
    """Documents (rowid, doc_id, language, metadata, rank_text, content) and how they are analyzed; packed when they are searched.

    One with a ``name`` is packed once a session and used again.
    """

    documents: DataFrame
    options: IndexOptions
    name: str | None = None

    def packed(self, fuzzy: bool) -> PackedIndex:
        if self.name is None:
            return pack(self.documents, self.options, fuzzy)
        flags = tuple(sorted(self.options.flags().items()))
        key = self.documents.sparkSession.sparkContext.applicationId, self.name, fuzzy, flags, tuple(sorted((c, id(a)) for c, a in self.options.analyzers.items()))
        if key not in _PACKED or not exists(_PACKED[key].folder):
            _PACKED[key] = pack(self.documents, self.options, fuzzy)
        return _PACKED[key]


_PACKED: dict[tuple, PackedIndex] = {}


def exists(folder: str) -> bool:
    fs, path = _open(folder)
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def _open(path: str):
    """(file system, path in it)"""
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)


def write_file(folder: str, kind: str, table: pa.Table) -> str:
    name = f"{kind}-{uuid.uuid4().hex}.arrow"
    fs, path = _open(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return name


def read_file(folder: str, name: str) -> pa.Table:
    """The table of a file, mapped into memory."""
    fs, path = _open(f"{folder}/{name}")
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        local = f"{tempfile.gettempdir()}/{hashlib.sha256(f'{folder}/{name}'.encode()).hexdigest()}.arrow"
        if not os.path.exists(local):
            pyarrow.fs.copy_files(path, new := f"{local}.{uuid.uuid4().hex}", source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            os.replace(new, local)
        path = local
    return pa.ipc.open_file(pa.memory_map(path)).read_all()


def fold_low(low: str) -> str:
    """``fold`` of a lower-cased text."""
    if low.isascii():
        return low
    return low.translate(_FOLDS)


class _Folds(dict):
    """Characters to what they are folded to, found when first asked for."""

    def __missing__(self, code: int) -> str:
        import unicodedata as ud

        self[code] = "" if ud.category(chr(code)) == "Mn" else chr(code)
        return self[code]


_FOLDS = _Folds({ord(a): b for a, b in zip(*all_accents())})


def _lists(stream: str, chunk: int, place: np.ndarray, values: pa.Array, weights: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each distinct value: its places in order, and how often (or with which sum of weights) it is there."""
    if not len(values):
        return
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, at = np.unique((code << 16) | place, return_inverse=True)
    count = np.bincount(at, weights).astype(np.int64)
    for kept, name in _carried(count, stream):
        k, c = key[kept[0]], kept[1]
        first = np.flatnonzero(np.diff(k >> 16, prepend=-1))
        ends = np.append(first, len(k)).astype(np.int32)
        n = len(first)
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(name, n), coded.dictionary.take(pa.array(k[first] >> 16)), pa.repeat(pa.scalar(chunk, pa.int64()), n),
                pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * 2), pa.py_buffer((k & 0xFFFF).astype(np.uint16))]),
                pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(c.astype(np.uint8))]),
            ],
            schema=_ROW,
        )


def _carried(count: np.ndarray, stream: str):
    kept = np.arange(len(count))
    while len(kept):
        yield (kept, count & 0xFF), stream
        high = count > 0xFF
        kept, count, stream = kept[high], count[high] >> 8, stream + MORE


def gap(run: str, following: str) -> str:
    return f"{run[-2:]}|{following[:2]}"


def _runs(stream: str, chunk: int, place: np.ndarray, runs: pa.Array) -> Iterator[pa.RecordBatch]:
    """The runs of texts, and what meets between them."""
    yield from _lists(stream, chunk, place, runs)
    if len(runs) > 1:
        met = pc.binary_join_element_wise(pc.utf8_slice_codeunits(runs.slice(0, len(runs) - 1), -2), pc.utf8_slice_codeunits(runs.slice(1), 0, 2), "|")
        inside = place[1:] == place[:-1]
        yield from _lists(stream + "|", chunk, place[1:][inside], met.filter(pa.array(inside)))


def _derived(vocabulary: Vocabulary, languages: list[str | None], words: pa.ListArray):
    """Per derived stream (place, term, weight): each distinct stem or code of a text, cut into index terms."""
    place = np.repeat(np.arange(len(languages)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    code, listed = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    names = list(dict.fromkeys(languages))
    language = np.array([names.index(x) for x in languages], np.int64)[place] if len(place) else place
    pairs, at = np.unique(language * max(len(listed), 1) + code, return_inverse=True)
    analyzed = [vocabulary.analyzed(names[p // len(listed)], listed[p % len(listed)]) for p in pairs.tolist()]
    for stream, which, on in (("stem", 0, vocabulary.stems), ("phonetic", 1, vocabulary.codes)):
        if not on:
            continue
        numbers: dict[str, int] = {}
        value = np.array([numbers.setdefault(a[which], len(numbers)) if a[which] else -1 for a in analyzed], np.int64)
        each = value[at] if len(at) else at
        there = each >= 0
        key = np.unique((each[there] << 16) | place[there])
        cut = [vocabulary.index_terms(v) for v in numbers]
        sizes = np.array([len(c) for c in cut], np.int64)
        flat, start = [t for c in cut for t in c], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        v, p = key >> 16, key & 0xFFFF
        n = sizes[v] if len(v) else v
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield stream, np.repeat(p, n), pa.array(flat, pa.string()).take(pa.array(np.repeat(start[v], n) + inside))


def _chunking(folder: str, options: IndexOptions, fuzzy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, task, n = Vocabulary(options), TaskContext.get().partitionId(), 0
        for table in _gathered(batches):
            chunk, n = (task << 20) | n, n + 1
            yield from _chunk(folder, chunk, table, vocabulary, options, fuzzy)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in chunks of at most ``CHUNK_DOCS`` and about ``CHUNK_CHARS`` characters."""
    held: list[pa.RecordBatch] = []
    rows = chars = 0
    for batch in batches:
        size = np.cumsum(batch.column("chars").to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(size, before + CHUNK_CHARS - chars, side="right")), start + 1), start + CHUNK_DOCS - rows)
            held.append(batch.slice(start, stop - start))
            rows, chars, start = rows + stop - start, chars + int(size[stop - 1] - before), stop
            if chars >= CHUNK_CHARS or rows >= CHUNK_DOCS or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, chars = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _chunk(folder: str, chunk: int, table: pa.Table, vocabulary: Vocabulary, options: IndexOptions, fuzzy: bool) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    column = {name: table.column(name).combine_chunks() for name in table.column_names}
    column = {k: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for k, c in column.items()}
    n = table.num_rows
    places = np.arange(n)

    def spread(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        return np.repeat(places, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()

    yield from _lists("base", chunk, *spread(column["terms"]))
    dl = pc.list_value_length(column["terms"]).to_numpy(zero_copy_only=False).astype(np.int64)
    if vocabulary.derives:
        for stream, place, values in _derived(vocabulary, column["language"].to_pylist(), column["words"]):
            yield from _lists(stream, chunk, place, values)
            dl += np.bincount(place, minlength=n)
    texts = column["text"].to_pylist()
    lows = [low if low is not None else t.lower() for t, low in zip(texts, column["low"].to_pylist())]
    odd_low = [low if low != t.lower() else None for t, low in zip(texts, lows)]
    folds = column["folded"].to_pylist()  # null where it is the lower-cased text
    odd_fold = [f if f is not None and f != fold_low(low) else None for f, low in zip(folds, lows)]
    if options.enable_trigram:
        runs = pc.if_else(pc.is_valid(column["low_runs"]), column["low_runs"], column["terms"])
        yield from _runs("low", chunk, *spread(runs))
    yield from _runs("fold", chunk, *spread(column["fold_runs"]))
    if not options.enable_trigram:  # folded texts alone are searched for parts, so those that are the lower-cased ones too
        plain = pc.if_else(pc.is_null(column["fold_runs"]), pc.if_else(pc.is_valid(column["low_runs"]), column["low_runs"], column["terms"]), pa.scalar(None, column["terms"].type))
        yield from _runs("low", chunk, *spread(plain))
    file = {
        "rowid": column["rowid"], "doc_id": column["doc_id"], "metadata": column["metadata"], "text": column["text"], "has_content": column["has_content"],
        "plain": pc.is_null(column["folded"]), "dl": pa.array(dl), "tri": column["grams"], "low": pa.array(odd_low, pa.string()), "folded": pa.array(odd_fold, pa.string()),
    }
    if fuzzy:
        words = [sorted(set(t.split())) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        yield from _lists("raw", chunk, np.repeat(places, sizes), pa.array([x for w in words for x in w], pa.string()))
        file |= {"n_words": pa.array(sizes), "letters": pa.array([sum(map(len, w)) for w in words], pa.int64())}
    name = write_file(folder, "chunk", pa.table(file))
    sums = np.array([n, dl.sum(), column["grams"].to_numpy(zero_copy_only=False).sum()], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([FILE]), pa.array([name]), pa.array([chunk]), pa.array([sums.tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=_ROW)


def term_grams(listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, start, number of a term): the distinct terms with each trigram; three code points are packed into one number."""
    texts = listed.to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = row[2:] == row[:-2]
    gram, at = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[inside], row[2:][inside]
    order = np.lexsort((at, gram))
    gram, at = gram[order], at[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])) if len(gram) else np.zeros(0, bool)
    gram, at = gram[new], at[new]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.append(first, len(gram)).astype(np.int64), at.astype(np.int32)


def _merging(folder: str):
    """Writes the rows of a task, sorted by stream and term, as files of whole lists, and passes on the names of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            for stream in pc.unique(batch.column("stream")).to_pylist():
                part = batch.filter(pc.equal(batch.column("stream"), stream))
                if stream == FILE:
                    yield part
                else:
                    held.setdefault(stream, []).append(part)
        for stream, parts in held.items():
            table = pa.Table.from_batches(parts).combine_chunks()
            term, places, counts = (table.column(c).chunk(0).cast(kind) for c, kind in (("term", pa.string()), ("places", pa.large_binary()), ("counts", pa.large_binary())))
            changed = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
            first = np.append(0, np.flatnonzero(changed) + 1)
            ends = np.append(first, len(term))
            places_at, counts_at = (np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] for x in (places, counts))
            listed = term.take(pa.array(first))
            sizes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.diff(counts_at).astype(np.int32)))
            chunks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), table.column("chunk").chunk(0))
            file = {
                "term": listed, "chunk": chunks, "size": sizes,
                "places": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places_at[ends]), places.buffers()[2]]),
                "counts": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(counts_at[ends]), counts.buffers()[2]]),
            }
            name = write_file(folder, "lists", pa.table(file))
            rows = [(stream, name)]
            if stream in ("low", "fold"):
                gram, start, at = term_grams(listed)
                grams = pa.table({"gram": pa.array(gram), "term": pa.LargeListArray.from_arrays(pa.array(start), pa.array(at))})
                rows.append((f"{stream}#{name}", write_file(folder, "grams", grams)))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(FILE, len(rows)), pa.array([b for _, b in rows]), pa.repeat(pa.scalar(-1, pa.int64()), len(rows)), pa.array([a.encode() for a, _ in rows], pa.binary()), pa.array([b""] * len(rows), pa.binary())],
                schema=_ROW,
            )

    return run


def pack(documents: DataFrame, options: IndexOptions, fuzzy: bool = True) -> PackedIndex:
    """Packs documents (rowid, doc_id, language, metadata, rank_text, content) into a new folder; one pass over the texts."""
    spark = documents.sparkSession
    ship(spark)
    folder = new_folder(spark, "packed")
    text = F.col("text")
    low, folded = F.lower(text), fold(text)
    run, zero = F.lit(TERM), F.lit(0)
    nothing = F.lit(None)
    words = F.array_distinct(tokens(text)) if Vocabulary(options).derives else F.array().cast("array<string>")
    rows = documents.select(
        "rowid", "doc_id", F.lower("language").alias("language"), "metadata", text_column().alias("text"), F.col("content").isNotNull().alias("has_content"),
    ).select(
        "rowid", "doc_id", "language", "metadata", "text", "has_content", terms(text).alias("terms"), words.alias("words"),
        F.when(low != text, low).otherwise(text).alias("low"), F.when(folded != low, folded).otherwise(nothing).alias("folded"),
        F.when(fold_terms(text) != low, F.regexp_extract_all(low, run, zero)).alias("low_runs"),
        F.when(folded != low, F.regexp_extract_all(folded, run, zero)).alias("fold_runs"),
        F.length(text).cast("bigint").alias("chars"), F.greatest(F.length(text) - 2, F.lit(0)).cast("bigint").alias("grams"),
    )
    # Few files, as a worker looks into all of them: one for about so many bytes of the source.
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES))
    lists = rows.mapInArrow(_chunking(folder, options, fuzzy), _ROWS).repartition(parts, "stream", "term").sortWithinPartitions("stream", "term", "chunk")
    files = lists.mapInArrow(_merging(folder), _ROWS).collect()  # a row a file
    chunks = sorted((r["chunk"], r["term"]) for r in files if r["chunk"] >= 0)
    sums = sum((np.frombuffer(bytes(r["places"]), np.int64) for r in files if r["chunk"] >= 0), np.zeros(3, np.int64))
    n, dl, tri = map(int, sums)
    named = sorted((bytes(r["places"]).decode(), r["term"]) for r in files if r["chunk"] < 0)
    return PackedIndex(folder, tuple(chunks), tuple(named), n, dl / n if n else 0.0, tri / n if n else 0.0)
