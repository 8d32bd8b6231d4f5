"""Batches of queries over a packed collection: the same pages as over the tables of an index, and nothing written but the lists."""

from dataclasses import replace
from pathlib import Path

import pyarrow as pa
import pytest

from lexwell import catalogue
from lexwell.functions.analyzers import ANALYZERS
from lexwell.operators import packed, search
from lexwell.operators.packed import Collection
from lexwell.operators.postings import build_tables
from lexwell.schema import DOCUMENTS, QUERIES, IndexOptions, QueryOptions
from lexwell.sources.checkpoint import shared_folder

TEXTS = (
    "The seal is broken. Second copy, the seal!", "Die Prüfung der Ventile: prüft Müller", "aaaa aa aaaaa " * 200, "", None, "İstanbul'da KAPIDAKİ kapı", "nótice notîce NOTICE notice",
    "price list price-list pricelist", "клапана 😀 §5 § 5 x²", "seals pumps the pump", "m'envoyer une lettre, m' envoyer", "word " * 70_000, "the " * 300 + "late payment", "ent sent tent entente",
)
ASKED = (
    "the seal", "seal", "prüft", "pruft", "notice", "nótice", "price list", "list price", "aa", "aaa", "aaaa aa", "§ 5", "😀 §", "m'envoyer une", "İstanbul", "kapı", "word word", "word", "ent", "se", "e", "d",
    "sent tent", "t entente", "THE LATE PAYMENT", "late payment", "zzz", "   ", None, ". Second", "seal!", "the", "pump seal", "Müller Ventile",
)
NAMES = ["search_batch_nofuzzy", "search_nofuzzy_allterms", "search_phonetic_de", "search_snippets", "search_stemmed_fr", "search_fallback_analyzer", "search_nofuzzy_anyterms", "search_phonetic_en", "search_stemmed_de", "search_fuzzy", "search_own_analyzer", "search_single_token", "search_stemmed_en", "search_batch"]


def documents(spark):
    rows = [(i * 7 % 50 + i, f"d{i:02}", (None, "de", "EN", "fr")[i % 4], '{"a":1}', "" if i % 3 else t, t if i % 3 else None) for i, t in enumerate(TEXTS * 2, 1)]
    return spark.createDataFrame(rows, DOCUMENTS)


def queries(spark):
    rows = [(10 * i + j, q, m, n, o, (None, "de", "en", "fr")[i % 4], i % 3 == 0) for i, q in enumerate(ASKED, 1) for j, (m, n, o) in enumerate((("AllTerms", 50, 0), ("AnyTerm", 3, 1), (None, 2, 0), ("AllTerms", None, -4)))]
    return spark.createDataFrame(rows, QUERIES)


@pytest.mark.parametrize("case", ["plain", "fuzzy", "all", "no trigrams", "small pool", "ranker"])
def test_a_packed_collection_answers_like_the_tables(spark, case):
    plain = replace(search.base_only(), default_language="en")
    index = {"all": IndexOptions(default_language="en").with_all_languages(), "no trigrams": replace(plain, enable_trigram=False)}.get(case, plain)
    if case == "ranker":
        index = replace(index, fuzzy_ranker=lambda a, b: len(set(a) & set(b)) / 40)
    query = QueryOptions(enable_fuzzy=case in ("fuzzy", "all", "ranker"), candidate_pool_size=5 if case == "small pool" else 300, min_score=0.3 if case == "fuzzy" else 0.0)
    docs = documents(spark)
    expected = search.search_tables(build_tables(docs, index), queries(spark), index, query)
    got = search.search_tables(Collection(docs, index), queries(spark), index, query)
    assert got.dtypes == expected.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_chunks_are_bounded_and_hold_all_rows():
    sizes = [5, packed.CHUNK_CHARS * 2, 1, packed.CHUNK_CHARS // 2, packed.CHUNK_CHARS // 2, 7] + [0] * (packed.CHUNK_DOCS + 3)
    batches = pa.Table.from_pydict({"chars": pa.array(sizes, pa.int64()), "at": list(range(len(sizes)))}).to_batches(10_000)
    chunks = list(packed._gathered(iter(batches)))
    assert [x for c in chunks for x in c.column("at").to_pylist()] == list(range(len(sizes)))
    assert all(c.num_rows <= packed.CHUNK_DOCS and (c.num_rows == 1 or sum(c.column("chars").to_pylist()) <= packed.CHUNK_CHARS) for c in chunks)


@pytest.mark.parametrize("name", NAMES)
def test_a_batch_writes_no_matches(spark, tmp_path, name):
    documents(spark).write.parquet(f"{tmp_path}/index_documents.parquet")
    queries(spark).write.parquet(f"{tmp_path}/search_queries.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert catalogue.queries()[name](spark, str(tmp_path)).count()
    assert not [p.name for p in set(folder.iterdir()) - before if not p.name.startswith("packed")]
