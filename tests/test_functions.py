"""Text functions against given values."""

import re

import pytest
from pyspark.sql import functions as F

from lexwell.catalogue_published import DOUBLE_METAPHONE, KOELNER, SENTENCES, STEMS
from lexwell.functions import text as X
from lexwell.functions.analyzers import ANALYZERS
from lexwell.functions.detect import detect
from lexwell.functions.fuzzy import longest_common, ratio, token_set_ratio
from lexwell.functions.phonetics import double_metaphone, koelner
from lexwell.functions.snippet import build_snippet
from lexwell.functions.stopwords import STOP_WORDS
from lexwell.plans.match import Phrase, escaped, make_plan, query_tokens, render
from lexwell.schema import IndexOptions, QueryOptions, SnippetOptions, version_at_least

@pytest.mark.parametrize("language", sorted(STEMS))
def test_stems(language):
    stem = ANALYZERS[language].stem
    for word, expected in STEMS[language].items():
        assert stem(word) == expected, word
    assert stem("") == ""
    for token in ("uid00011", "2000a", "x86", "100", "2011"):
        assert not stem(token) or stem(token)[0] == token[0], token
        assert re.findall(r"\d+", stem(token)) == re.findall(r"\d+", token), token
    for short in ("a", "ab", "x", "é", "12"):
        assert isinstance(stem(short), str)


def test_stop_words_sizes():
    sizes = dict(de=240, en=178, fr=182, es=201, it=196, pt=201, nl=101, sv=114, no=149, da=94, fi=169, ru=159, hu=169, ro=219, tr=149)
    assert {k: len(v) for k, v in STOP_WORDS.items()} == sizes
    assert ANALYZERS["de"].is_stop_word("eurem") and ANALYZERS["ro"].is_stop_word("toţi") and not ANALYZERS["en"].is_stop_word("house")


def test_phonetics():
    for word, code in KOELNER.items():
        assert koelner(word) == code, word
    assert koelner("cäsar") == koelner("kaiser") and koelner("stadt") == koelner("statt")
    assert koelner("123") is None and koelner("") is None
    for word, code in DOUBLE_METAPHONE.items():
        assert double_metaphone(word) == code
    for a, b in (("right", "write"), ("rite", "wright"), ("phone", "fone"), ("knot", "not"), ("philip", "filip"), ("catherine", "katherine")):
        assert double_metaphone(a) == double_metaphone(b)
    assert double_metaphone("42") is None and len(double_metaphone("internationalization")) <= 4
    assert sorted(c for c, a in ANALYZERS.items() if a.encode) == ["de", "en"]


def test_detection():
    for sentence, language in SENTENCES.items():
        assert detect(sentence) == language
    assert detect("") is None and detect(" \t\n") is None and detect(None) is None


@pytest.fixture(scope="module")
def one(spark):
    def value(make, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]

    return value


def test_token_columns(one):
    assert one(X.tokens, "Hello, world-foo_bar", "a😀b", "Müller Straße", "abc123 42", "Привет, мир", "", None, "İstanbul") == [
        ["hello", "world", "foo", "bar"], ["a", "b"], ["müller", "straße"], ["abc123", "42"], ["привет", "мир"], [], None, ["İstanbul"],
    ]
    assert one(X.terms, "Crème Brûlée x²y ½", "été", "й ø ł ß") == [["creme", "brulee", "x²y", "½"], ["ete"], ["й", "ø", "ł", "ß"]]
    assert one(X.fold, "MÜLLER", "Crème Brûlée", "ångström", "й", "", None) == ["muller", "creme brulee", "angstrom", "и", "", None]
    assert one(X.trigrams, "abcd", "Üab", "ab", "", None) == [["abc", "bcd"], ["üab"], [], [], None]
    assert one(X.utf16_length, "a😀b", "ab") == [4, 2]
    assert one(lambda t: X.occurrences(t, F.lit("aa")), "aaaaa", "a.a", "") == [4, 0, 0]
    assert one(lambda t: X.occurrences(t, F.lit(r"\E.*")), r"x\E.*y\E.*", "abc") == [2, 0]
    assert X.fold_with_map("aÜ😀b") == ("au😀b", [0, 1, 2, 3], [1, 2, 3, 4])


def test_query_tokens_and_plan():
    assert query_tokens("Hello, x²y foo_bar 42") == ["hello", "x", "y", "foo", "bar", "42"]
    assert escaped('ab"c') == '"ab""c"'
    assert render((Phrase("base", "a"), Phrase("base", "b"), Phrase("base", "b", True), Phrase("stem", "s"))) == 'base : ("a" OR "b" OR "b"*) OR stem : ("s")'
    plain = IndexOptions(enable_stemming=False, enable_phonetic=False)
    assert render(make_plan("ab", plain, QueryOptions()).any_term) == 'base : ("ab" OR "ab"*)'
    plan = make_plan("kafka kafka", plain, QueryOptions())
    assert len(plan.strict) == 2 and plan.substring == "kafka kafka"
    assert make_plan("  ", plain, QueryOptions()).empty and make_plan(None, plain, QueryOptions()).empty
    assert make_plan("??", plain, QueryOptions()).empty and not make_plan("???", plain, QueryOptions()).empty
    german = IndexOptions().with_language("de")
    assert render(make_plan("Rechnungen", german, QueryOptions(language="DE")).any_term) == 'base : ("rechnungen") OR stem : ("rechnung") OR phonetic : ("746646")'


def test_fuzzy():
    assert longest_common("abcbdab", "bdcaba") == 4 and ratio("", "") == 100 and ratio("a", "") == 0
    assert token_set_ratio("alpha beta", "beta alpha gamma") == 100 and token_set_ratio("Alpha", "alpha") < 100


def test_longest_common_against_dynamic_programming():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in "xy")
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
        assert longest_common(a, b) == row[-1]


def test_snippets():
    def cut(text, words, n=200):
        return build_snippet(text, words, SnippetOptions(n))

    assert cut("hello world example text", ["zzz"], 11) == "hello world" and cut("short text", ["zzz"]) == "short text" and cut("", ["x"]) == ""
    assert cut("rechnung", ["rech", "rechnung"]) == "<mark>rechnung</mark>" and cut("rechnung", ["rech", "nung"]) == "<mark>rechnung</mark>"
    assert cut("alpha und beta", ["alpha", "beta"]) == "<mark>alpha</mark> und <mark>beta</mark>"
    assert cut("kafka " + "b" * 100, ["kafka"], 11) == "<mark>kafka</mark> bbbbb" and cut("b" * 100 + " kafka", ["kafka"], 11) == "bbbbb <mark>kafka</mark>"
    assert cut("Crème Brûlée bestellt", ["creme", "brulee"]) == "<mark>Crème</mark> <mark>Brûlée</mark> bestellt"
    assert cut("rechnung", ["rechnung"], 4) == "<mark>chnu</mark>" and cut("abc", ["b"], 0) == ""


def test_versions():
    least = (3, 43, 0)
    for version, expected in {"3.43.0": True, "3.43": True, "3.100.1": True, "3.42.9": False, "4": True, "2.99.99": False}.items():
        assert version_at_least(version, least) is expected
    for version in ("", None, "3.x", "3..1", "1.2.3.4", "-3.1", " 3.1"):
        assert version_at_least(version, least) is None
