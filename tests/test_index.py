"""The index: opening, changes, searches, and BM25 against an independent implementation."""

import json
import math
import sqlite3

import pytest
from pyspark.sql import types as T

from lexwell.api import SearchIndex
from lexwell.functions.analyzers import Analyzer
from lexwell.operators import recall, search
from lexwell.operators.postings import build_tables
from lexwell.schema import DOCUMENTS, QUERIES, IndexOptions, QueryOptions, SearchIndexError, desktop, entries_schema, mobile
from lexwell.streaming.ingest import ingest

META = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.IntegerType())])
BARE = IndexOptions(enable_stemming=False, enable_phonetic=False, metadata_schema=META, buckets=4)


def entries(spark, *rows):
    """Rows (id, text) or (id, text, language)."""
    listed = [(r[0], r[1], (f"name-{r[0]}", len(r[0] or "")), r[2] if len(r) > 2 else None, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(listed, entries_schema(META).fromJson(json.loads(entries_schema(META).json().replace('"nullable":false', '"nullable":true'))))


def documents(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}", None, None, "", t) for i, t in enumerate(texts, 1)], DOCUMENTS)


def partition_filters(df):
    """The filters on partitions of each scan of the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex.open(spark, str(tmp_path / "index"), BARE)


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_open_flags_and_versions(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(SearchIndexError, match="metadata"):
        SearchIndex.open(spark, path, IndexOptions())
    SearchIndex.open(spark, path, BARE).close()
    with pytest.raises(SearchIndexError, match="enable_stemming"):
        SearchIndex.open(spark, path, IndexOptions(metadata_schema=META))
    log = tmp_path / "i/log"
    manifest = json.loads(next(log.glob("*.json")).read_text())
    del manifest["store_content"]
    (log / f"{2:020d}.json").write_text(json.dumps(manifest))
    with pytest.raises(SearchIndexError, match="store_content"):
        SearchIndex.open(spark, path, BARE)
    (log / f"{3:020d}.json").write_text(json.dumps(manifest | {"schema_version": "9"}))
    with pytest.raises(SearchIndexError, match="version"):
        SearchIndex.open(spark, path, BARE)
    assert mobile().max_content_chars == 4000 and mobile().remove_stop_words and not mobile().enable_trigram and desktop().enable_trigram


def test_changes(spark, index):
    index.add_range(entries(spark, ("a", "alpha one"), ("b", "beta"), ("a", "alpha two"), (" ", None)))
    rows = {r["doc_id"]: r for r in index.documents().collect()}
    assert index.count() == 3 and rows["a"]["content"] == "alpha two" and rows[" "]["content"] == ""
    first = rows["a"]["rowid"]
    index.add("a", "alpha three", ("x", 1))
    rows = {r["doc_id"]: r for r in index.documents().collect()}
    assert rows["a"]["rowid"] == first and rows["a"]["content"] == "alpha three" and index.count() == 3
    with pytest.raises(ValueError):
        index.add_range(entries(spark, ("c", "new"), ("", "no id")))
    with pytest.raises(ValueError):
        index.add_range(entries(spark, (None, "no id")))
    assert index.count() == 3 and not index.contains("c") and index.contains("b")
    before = index.search("alpha three")
    assert ids(before) == ["a"] and before[0]["metadata"]["name"] == "x"
    index.optimize()
    assert index.search("alpha three") == before
    index.rebuild()
    assert index.search("alpha three") == before
    assert index.remove("a") and not index.remove("a") and index.search("three") == []
    assert [r["doc_id"] for r in index.contained(spark.createDataFrame([("a",), ("b",)], "doc_id string")).collect()] == ["b"]
    again = SearchIndex.open(spark, index._store.path, BARE)
    assert again.count() == 2
    index.clear()
    assert index.count() == 0 and index.search("beta") == []
    index.close()
    index.close()
    with pytest.raises(SearchIndexError):
        index.search("x")


def test_term_matching_and_paging(spark, index):
    index.add_range(entries(spark, ("both-1", "kafka prozess gestartet"), ("both-2", "ein langer text in dem kafka und auch ein prozess vorkommt"), ("only-kafka", "kafka allein"), ("only-prozess", "prozess allein")))
    assert set(ids(index.search("kafka prozess", QueryOptions(limit=2)))) == {"both-1", "both-2"}
    found = ids(index.search("kafka prozess"))
    assert len(found) == 4 and set(found[:2]) == {"both-1", "both-2"}
    assert len(index.search("kafka fehlt")) == 3
    assert ids(index.search("kafka prozess", QueryOptions(offset=2))) == found[2:]
    assert ids(index.search("kafka prozess", QueryOptions(offset=-5, limit=1))) == found[:1]
    assert index.search("kafka", QueryOptions(limit=0)) == [] and index.search("kafka", QueryOptions(candidate_pool_size=0)) == []
    assert index.search(None) == [] and index.search("   ") == [] and index.search('"kafka" NOT (x OR') != []


def test_substrings_prefixes_folding(spark, index):
    index.add_range(entries(spark, ("r", "Die Rechnung ist angekommen"), ("m", "Herr MÜLLER schreibt"), ("p", "rebuild planned"), ("w", "warehouse only"), ("s", "smartwarehouseunit inventory")))
    for q in ("chnun", "ECHNUN", "Rechnun"):
        assert ids(index.search(q)) == ["r"]
    for q in ("müller", "muller", "MULLER", "Müller"):
        assert ids(index.search(q)) == ["m"]
    assert set(ids(index.search("re"))) == {"p", "r"}
    assert set(ids(index.search("warehouse"))) == {"w", "s"}
    hit = index.search("rechnung", QueryOptions(include_snippet=True))[0]
    assert hit["snippet"] == "Die <mark>Rechnung</mark> ist angekommen" and index.search("rechnung")[0]["snippet"] is None


def test_scores(spark, index):
    index.add_range(entries(spark, ("dense", "alpha alpha alpha beta beta beta"), ("long", "alpha beta " + "filler " * 40), ("apart", "alpha " + "filler " * 40 + "beta")))
    plain = {r["doc_id"]: r["score"] for r in index.search("alpha beta", QueryOptions(enable_fuzzy=False))}
    # "apart" has the same terms as "long" in fewer positions beside each other: it is not raised by the exact boost.
    assert plain["dense"] == 1.0 and plain["long"] == pytest.approx(plain["apart"] + 0.15, abs=0.02) and plain["apart"] < 0.1
    assert "apart" not in {r["doc_id"] for r in index.search("alpha beta", QueryOptions(enable_fuzzy=False, min_score=0.5))}
    assert index.search("kafka kafka") == []


def test_languages_end_to_end(spark, tmp_path):
    options = IndexOptions(metadata_schema=META, buckets=4).with_all_languages()
    index = SearchIndex.open(spark, str(tmp_path / "l"), options)
    index.add_range(
        entries(spark, ("de", "Die Rechnung ist angekommen", "de"), ("en", "they run daily to the office", "en"), ("fr", "le cheval est rapide", "fr"), ("mu", "Herr Müller", "de"), ("sm", "Mr Smith arrived", "en"))
    )
    assert ids(index.search("Rechnungen", QueryOptions(language="de"))) == ["de"]
    assert ids(index.search("running", QueryOptions(language="en"))) == ["en"]
    assert ids(index.search("chevaux", QueryOptions(language="fr"))) == ["fr"]
    assert ids(index.search("Mueller", QueryOptions(language="de"))) == ["mu"]
    assert ids(index.search("Smyth", QueryOptions(language="en"))) == ["sm"]
    assert index.search("Smyth", QueryOptions(language="en", enable_phonetic=False)) == []


def test_stop_words_and_detector(spark, tmp_path):
    stemmer = Analyzer(lambda t: t[:-1] if t.endswith("s") else t, None, frozenset({"und"}))
    options = IndexOptions(metadata_schema=META, enable_trigram=False, remove_stop_words=True, language_detector=lambda t: "xx", analyzers={"xx": stemmer})
    index = SearchIndex.open(spark, str(tmp_path / "s"), options)
    index.add_range(entries(spark, ("d", "und kafka")))
    assert ids(index.search("und")) == ["d"] and index.search("unds") == [] and ids(index.search("kafkas")) == ["d"]


def test_bm25_equals_sqlite(spark):
    """Ranks of the base stream against SQLite's full-text index."""
    texts = ["alpha beta beta", "alpha", "", "gamma alpha delta epsilon", "beta gamma", "Über alpha", "alpha alpha alpha zeta", "nothing here", "beta"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(base, tokenize=\"unicode61 remove_diacritics 2\")")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("INSERT INTO f(rowid, base) VALUES (?, ?)", list(enumerate(texts, 1)))
    tables = build_tables(documents(spark, *texts), search.base_only())
    plan = "query_id long, required int, phrases array<struct<stream:string,term:string,is_prefix:boolean>>"
    for words in (["alpha"], ["beta", "gamma"], ["alpha", "alpha"], ["uber"], ["be*"]):
        match = " OR ".join(f'"{w.rstrip("*")}"' + "*" * w.endswith("*") for w in words)
        expected = dict(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        plans = spark.createDataFrame([(1, 0, [("base", w.rstrip("*"), w.endswith("*")) for w in words])], plan)
        got = {r["rowid"]: r["rank"] for r in recall.bm25(plans, tables).collect()}
        assert got.keys() == expected.keys()
        for rowid, rank in expected.items():
            assert math.isclose(got[rowid], rank, rel_tol=1e-6, abs_tol=2e-9)


def test_batch_equals_single(spark, index):
    index.add_range(entries(spark, *[(f"d{i}", f"token{i % 7} common text number {i}") for i in range(40)]))
    texts = ["token3", "common number", "token1 token2", "??", "", "um", "ken4 comm"]
    batch = spark.createDataFrame([(i, t, "AllTerms", 10, 0, None, True) for i, t in enumerate(texts)], QUERIES)
    found = index.search_batch(batch).collect()
    for i, t in enumerate(texts):
        mine = [(r["doc_id"], r["score"]) for r in sorted(found, key=lambda r: r["position"]) if r["query_id"] == i]
        assert mine == [(r["doc_id"], r["score"]) for r in index.search(t, QueryOptions(limit=10))]


def test_empty_index_and_streaming(spark, index, tmp_path):
    assert index.search("x y") == []
    entries(spark, ("a", "alpha"), ("b", "beta")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    ingest(index, stream, str(tmp_path / "progress")).awaitTermination(120)
    assert index.count() == 2 and ids(index.search("beta")) == ["b"]


def test_two_handles_lose_nothing(spark, index):
    other = SearchIndex.open(spark, index._store.path, BARE)
    index.add_range(entries(spark, ("a", "alpha"), ("b", "beta")))
    other.add_range(entries(spark, ("b", "beta two"), ("c", "gamma")))
    assert index.count() == other.count() == 3 and ids(index.search("two")) == ["b"] and ids(other.search("alpha")) == ["a"]
    commit, raced = index._store.commit, []

    def late(manifest, version):  # another writer comes first once
        if not raced:
            raced.append(other.add_range(entries(spark, ("d", "delta"))))
        return commit(manifest, version)

    index._store.commit = late
    index.add_range(entries(spark, ("e", "epsilon")))
    assert raced and other.count() == 5
    assert sorted(r["rowid"] for r in other.documents().collect()) == [1, 2, 3, 4, 5]
    assert {r["doc_id"] for r in other.documents().collect()} == set("abcde")


def test_a_write_that_breaks_leaves_the_index(spark, index, tmp_path):
    index.add_range(entries(spark, ("a", "alpha")))
    before, segments = index.search("alpha"), set((tmp_path / "index/segments").iterdir())

    def broken(*_):
        raise KeyboardInterrupt

    finish, index._store._finish = index._store._finish, broken
    with pytest.raises(KeyboardInterrupt):
        index.add_range(entries(spark, ("a", "changed"), ("b", "beta")))
    assert index.search("alpha") == before and index.count() == 1 and set((tmp_path / "index/segments").iterdir()) == segments
    index._store._finish = finish
    index.add_range(entries(spark, ("b", "beta")))
    assert index.count() == 2


def test_an_upsert_writes_and_reads_what_changed(spark, index):
    index.add_range(entries(spark, *[(f"d{i}", f"word{i} common") for i in range(200)]))
    manifest = index._store.manifest()
    index.add("d7", "seventh common", ("x", 1))
    segment = index._store.manifest()["segments"][-1]
    assert segment["n_docs"] == segment["removed"] == 1 and index._store.manifest()["segments"][:-1] == manifest["segments"]
    known = index._known(manifest, spark.createDataFrame([("d7",)], "doc_id string"))
    assert all("bucket" in f for f in partition_filters(known))
    # The parts of words that contain it, word70 to word79, are still found; the replaced text is not.
    assert set(ids(index.search("word7"))) == {f"d{i}" for i in range(70, 80)} and ids(index.search("seventh")) == ["d7"] and index.count() == 200


def test_segments_answer_like_one(spark, index):
    texts = [f"token{i % 5} common text {i}" for i in range(30)]
    for part in range(3):
        index.add_range(entries(spark, *[(f"d{i}", t) for i, t in enumerate(texts) if i % 3 == part]))
    index.add_range(entries(spark, ("d3", "token1 replaced"), ("new", "token2 common")))
    index.remove("d4")
    asked = ("token1", "common text", "token2 replaced", "ken1", "to", "com")
    before = [index.search(q) for q in asked]
    assert len(index._store.manifest()["segments"]) == 5
    index.compact()
    assert len(index._store.manifest()["segments"]) < 5 and [index.search(q) for q in asked] == before
    index.optimize()
    manifest = index._store.manifest()
    assert len(manifest["segments"]) == 1 and [index.search(q) for q in asked] == before and manifest["n_docs"] == 30
    index.rebuild()
    rebuilt = index._store.manifest()
    assert [index.search(q) for q in asked] == before and {k: rebuilt[k] for k in ("n_docs", "sum_dl", "sum_tri")} == {k: manifest[k] for k in ("n_docs", "sum_dl", "sum_tri")}


def test_a_search_reads_its_buckets_only(spark, index):
    index.add_range(entries(spark, *[(f"d{i}", f"word{i} common") for i in range(50)]))
    tables = index.tables()
    keys = spark.createDataFrame([("base", "word7")], "stream string, term string")
    assert all("stream" in f and "bucket" in f for f in partition_filters(recall.pruned_postings(tables, keys)))
    assert all("bucket" in f for f in partition_filters(recall.pruned_documents(tables, spark.createDataFrame([(3,)], "rowid long"))))


def test_batches_take_missing_values_from_the_options(spark, index):
    index.add_range(entries(spark, ("a", "alpha beta"), ("b", "alpha"), ("c", "beta")))
    bare = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, " ")], "query_id long, query_text string")
    assert [r["doc_id"] for r in index.search_batch(bare, QueryOptions(limit=1, include_snippet=True)).collect()] == ["a"]
    nulls = spark.createDataFrame([(1, "alpha beta", None, None, None, None, None)], QUERIES)
    assert len(index.search_batch(nulls).collect()) == 3
    found = index.search_batch(nulls, QueryOptions(offset=1, include_snippet=True, term_match="AnyTerm")).collect()
    assert len(found) == 2 and all("<mark>" in r["snippet"] for r in found)
