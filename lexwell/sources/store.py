"""An index in a folder: immutable segments and a log of manifests that name the valid ones.

A change writes one new segment, at the cost of what changed, and then the next manifest of the log. The manifest of a
version can be written once only; who comes second reads the new state and repeats the change on it. So changes are seen
whole or not at all, nothing is lost between writers, and readers keep the segments of the manifest they began with.

A segment holds ``documents``, their ``lengths`` and ``ids`` in buckets of their hash, ``postings`` in buckets of stream
and term, the frequencies of its terms, and the rowids it removes from the segments before it. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwell.operators.postings import DOCUMENT, IndexTables, all_postings, bucket_of, doc_stats_of, tables_of, totals_of
from lexwell.schema import SCHEMA_VERSION, IndexOptions, SearchIndexError

SCHEMAS = {
    "documents": "rowid bigint, doc_id string, language string, metadata string, rank_text string, content string, bucket int",
    "ids": "doc_id string, rowid bigint, bucket int",
    "postings": "term string, rowid bigint, tf int, dl bigint, stream string, bucket int",
    "lengths": "rowid bigint, dl bigint, tri_len bigint, bucket int",
    "term_stats": "term string, df bigint, stream string",
    "removed": "rowid bigint",
}
DOCUMENT_COLUMNS = ["rowid", "doc_id", "language", "metadata", "rank_text", "content"]
KEPT_VERSIONS = 10  # how many manifests back a reader may be
ABANDONED_MS = 24 * 3600 * 1000  # folders no manifest names are left of writers that failed, once they are this old


def wanted_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets these keys fall into, at most ``buckets`` numbers."""
    return sorted(r["bucket"] for r in keys.select(bucket_of(buckets, key).alias("bucket")).distinct().collect())


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._tables: dict[tuple[str, str], DataFrame] = {}

    # The log

    def _names(self, folder: str) -> list:
        at = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for s in self._names("log") if (n := s.getPath().getName()).endswith(".json"))

    def read_version(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/log/{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """The valid manifest with its ``version``; None if there is no index."""
        versions = self.versions()
        return {**self.read_version(versions[-1]), "version": versions[-1]} if versions else None

    def commit(self, manifest: dict, version: int) -> bool:
        """Writes the manifest of a version in one step; False if another writer was first."""
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        new, at = self._path(f"{self.path}/log/{uuid.uuid4().hex}.tmp"), self._path(f"{self.path}/log/{version:020d}.json")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "version"}, sort_keys=True), "utf-8"))
        finally:
            stream.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename would replace the file; a link does not
                try:
                    os.link(new.toUri().getPath(), at.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not self._fs.exists(at) and bool(self._fs.rename(new, at))
        finally:
            self._fs.delete(new, False)

    def intact(self) -> bool:
        """Whether the folder is still there; an index in the checkpoint folder may be deleted with it."""
        return bool(self.versions())

    # Segments

    def folder(self, segment: str, table: str) -> str:
        return f"{self.path}/segments/{segment}/{table}"

    def read(self, segment: str, table: str) -> DataFrame:
        key = segment, table
        if key not in self._tables:
            self._tables[key] = self.spark.read.schema(SCHEMAS[table]).parquet(self.folder(segment, table))
        return self._tables[key]

    def _write(self, df: DataFrame, segment: str, table: str, partitions: list[str], order: list[str]) -> None:
        df.sortWithinPartitions(*partitions, *order).write.partitionBy(*partitions).parquet(self.folder(segment, table))

    def write_segment(self, documents: DataFrame, options: IndexOptions, buckets: int, removed: DataFrame | None = None) -> dict:
        """Analyzes documents into a new segment and describes it; ``removed`` (rowid) goes from older segments."""
        segment = uuid.uuid4().hex
        try:
            self._write_documents(documents, segment, buckets)
            return self._finish(segment, all_postings(self.read(segment, "documents"), options), buckets, removed)
        except BaseException:
            self.drop(segment)
            raise

    def removal(self, rowids: DataFrame) -> dict:
        """A segment without documents that removes these rowids from older ones."""
        segment = uuid.uuid4().hex
        rowids.select("rowid").write.parquet(self.folder(segment, "removed"))
        return {"id": segment, "n_docs": 0, "sum_dl": 0, "sum_tri": 0, "removed": self.read(segment, "removed").count()}

    def drop(self, segment: str) -> None:
        self._fs.delete(self._path(f"{self.path}/segments/{segment}"), True)

    def merge_segments(self, manifest: dict, first: int, buckets: int) -> dict:
        """One segment from the ones from number ``first`` on; nothing is analyzed again."""
        segments, segment = manifest["segments"], uuid.uuid4().hex
        removed = None
        for s in segments[first:] if first else []:
            if s["removed"]:
                one = self.read(s["id"], "removed")
                removed = one if removed is None else removed.unionByName(one)
        try:
            self._write_documents(self.live(manifest, "documents", first).select(DOCUMENT_COLUMNS), segment, buckets)
            postings = self.live(manifest, "postings", first).select("stream", "term", "rowid", "tf", "dl")
            return self._finish(segment, postings, buckets, None if removed is None else removed.distinct())
        except BaseException:
            self.drop(segment)
            raise

    def _write_documents(self, documents: DataFrame, segment: str, buckets: int) -> None:
        bucketed = documents.select(DOCUMENT_COLUMNS).withColumn("bucket", bucket_of(buckets, "rowid"))
        self._write(bucketed.repartition("bucket"), segment, "documents", ["bucket"], ["rowid"])

    def _finish(self, segment: str, postings: DataFrame, buckets: int, removed: DataFrame | None) -> dict:
        ids = self.read(segment, "documents").select("doc_id", "rowid").withColumn("bucket", bucket_of(buckets, "doc_id"))
        self._write(ids.repartition("bucket"), segment, "ids", ["bucket"], ["doc_id"])
        # A term that a large part of the documents has is cut by rowid, so that no task gets all of its postings.
        cuts = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
        cut = F.pmod(F.xxhash64("rowid"), F.lit(cuts))
        bucketed = postings.withColumn("bucket", bucket_of(buckets, "stream", "term"))
        self._write(bucketed.repartition("stream", "bucket", cut), segment, "postings", ["stream", "bucket"], ["term", "rowid"])
        written = self.read(segment, "postings")
        lengths = doc_stats_of(written).withColumn("bucket", bucket_of(buckets, "rowid"))
        self._write(lengths.repartition("bucket"), segment, "lengths", ["bucket"], ["rowid"])
        stats = written.where(F.col("stream") != DOCUMENT).groupBy("stream", "term").agg(F.count(F.lit(1)).alias("df"))
        self._write(stats, segment, "term_stats", ["stream"], ["term"])
        n_removed = 0
        if removed is not None:
            removed.select("rowid").write.parquet(self.folder(segment, "removed"))
            n_removed = self.read(segment, "removed").count()
        n, dl, tri = totals_of(self.read(segment, "lengths"))
        return {"id": segment, "n_docs": n, "sum_dl": dl, "sum_tri": tri, "removed": n_removed}

    def live(self, manifest: dict, table: str, first: int = 0) -> DataFrame:
        """The valid rows of a table (with rowid) in the segments from number ``first`` on."""
        parts, segments = [], manifest["segments"]
        for i in range(first, len(segments)):
            if not segments[i]["n_docs"]:
                continue  # removes only
            part = self.read(segments[i]["id"], table)
            for later in segments[i + 1 :]:
                if later["removed"]:
                    part = part.join(self.read(later["id"], "removed"), "rowid", "left_anti")
            parts.append(part)
        return self._union(parts, table)

    def _union(self, parts: list[DataFrame], table: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[table])
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def totals(self, manifest: dict) -> tuple[int, int, int]:
        """Documents, terms and trigrams of the valid rows."""
        return manifest["n_docs"], manifest["sum_dl"], manifest["sum_tri"]

    def removed_totals(self, manifest: dict, rowids: DataFrame) -> tuple[int, int, int]:
        """Documents, terms and trigrams that go when these rowids are removed; reads their buckets only."""
        live = self.live(manifest, "lengths").where(F.col("bucket").isin(wanted_buckets(rowids, "rowid", manifest["buckets"])))
        return totals_of(live.join(rowids, "rowid", "left_semi"))

    def tables(self, manifest: dict) -> IndexTables:
        postings = self.live(manifest, "postings").where(F.col("stream") != DOCUMENT)
        stats = self._union([self.read(s["id"], "term_stats") for s in manifest["segments"] if s["n_docs"]], "term_stats")
        return tables_of(self.live(manifest, "documents"), postings, stats, self.totals(manifest), manifest["buckets"])

    def vacuum(self) -> None:
        """Removes manifests that are more than ``KEPT_VERSIONS`` behind and segments no other manifest names."""
        versions = self.versions()
        named = {s["id"] for v in versions[-KEPT_VERSIONS:] for s in self.read_version(v)["segments"]}
        earlier = {s["id"] for v in versions[:-KEPT_VERSIONS] for s in self.read_version(v)["segments"]}
        for v in versions[:-KEPT_VERSIONS]:
            self._fs.delete(self._path(f"{self.path}/log/{v:020d}.json"), False)
        oldest = time.time() * 1000 - ABANDONED_MS
        for status in self._names("segments"):
            name = status.getPath().getName()
            if name not in named and (name in earlier or status.getModificationTime() < oldest):
                self._fs.delete(status.getPath(), True)


def new_manifest(options: IndexOptions) -> dict:
    return {
        "schema_version": SCHEMA_VERSION, **options.flags(), "buckets": options.buckets, "segments": [], "n_docs": 0, "sum_dl": 0, "sum_tri": 0,
        "max_rowid": 0,
    }


def verify(manifest: dict, options: IndexOptions) -> None:
    """Raises if the index was made by another version or with other flags; a missing flag is another flag."""
    version = manifest.get("schema_version")
    if version != SCHEMA_VERSION:
        raise SearchIndexError(f"the index has schema version {version!r}, this library needs {SCHEMA_VERSION!r}")
    for name, wanted in options.flags().items():
        if manifest.get(name) != wanted:
            raise SearchIndexError(f"the index was made with {name}={manifest.get(name)!r}, opened with {wanted!r}")
