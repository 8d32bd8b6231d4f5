"""Named queries over small tables: what they read and that nothing is left out."""

from pyspark.sql import functions as F

from lexwell import catalogue, catalogue_languages
from lexwell.functions.fuzzy import ratio, token_set_ratio
from lexwell.schema import DOCUMENTS, QUERIES


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_searches_ask_all_search_queries(spark, tmp_path, monkeypatch):
    write(spark.createDataFrame([(1, "d1", "de", "{}", "", "Die Prüfung")], DOCUMENTS), tmp_path, "index_documents")
    asked = [(7, "Prüfungen", "AnyTerm", 9, 0, "DE", True), (101, "Rechnunk", "AnyTerm", 9, 0, "de", False), (102, "x", "AnyTerm", 9, 0, None, True), (103, "y", "AnyTerm", 9, 0, "fr", True)]
    write(spark.createDataFrame(asked, QUERIES), tmp_path, "search_queries")
    seen = {}

    def answered(documents, queries, index, options):
        assert documents.count() == 1
        seen["options"] = (bool(index.enable_stemming and index.analyzers), bool(index.enable_phonetic and index.analyzers), options.enable_fuzzy)
        hits = queries.select("query_id", "include_snippet", "language", *(F.lit(0).alias(c) for c in ("position", "score", "tier")), F.lit("d1").alias("doc_id"))
        return hits.withColumn("snippet", F.concat_ws("/", "language", F.col("include_snippet").cast("string")))

    monkeypatch.setattr(catalogue_languages.search, "search_tables", answered)
    monkeypatch.setattr(catalogue_languages, "indexed", lambda documents, options, name: documents)
    expected = {
        "search_fuzzy": ({7, 101, 102, 103}, (False, False, True)), "search_snippets": ({7, 101, 102, 103}, (False, False, False)),
        "search_batch": ({7, 101, 102, 103}, (True, True, True)), "search_stemmed_de": ({7, 101}, (True, False, False)), "search_stemmed_en": ({102}, (True, False, False)),
        "search_stemmed_fr": ({103}, (True, False, False)), "search_phonetic_de": ({7, 101}, (False, True, False)), "search_phonetic_en": ({102}, (True, True, False)),
    }
    for name, (ids, options) in expected.items():
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert {r["query_id"] for r in got} == ids and seen["options"] == options, name
        if name in ("search_snippets", "search_batch"):
            assert {r["query_id"]: r["snippet"] for r in got} == {7: "DE/true", 101: "de/false", 102: "true", 103: "fr/true"}


def test_token_set_ratio_is_the_best_of_three():
    for a, b in (("late payment", "the payment was late again"), ("a b", "b c d"), ("x", ""), ("", ""), ("pump seal", "seals pumps"), ("a a", "a"), ("né 😀 x", "x né 😀😀")):
        p, q = set(a.split()), set(b.split())
        common = " ".join(sorted(p & q))
        x, y = (f"{common} {' '.join(sorted(r))}".strip() for r in (p - q, q - p))
        expected = 100 if common and common in (x, y) else max(ratio(common, x), ratio(common, y), ratio(x, y))
        assert token_set_ratio(a, b) == expected
