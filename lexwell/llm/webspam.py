"""Problem 10: pages made for search engines: repeated keywords, lists of links, product or topic tags.

Method: thresholds on the share of the top word and of the top word pair, the share of repeated lines or list items,
the share of link text, the density of separators, and missing function words. What counts as a function word, and how
many a sentence needs, is learnt per language from labelled samples; how much repetition and how many separators prose
of a language has is measured on all pages of that language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwell.llm.common import saved, ship

_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[url=[^\]]*\].*?\[/url\]|\[[^\]\n]{1,200}\]\([^)\s]*\)|(?:https?://|www\.)\S+|(?<![\w@])(?:[\w-]+\.)+[^\W\d_]{2,24}/\S*|(?<![\w@.])(?:[\w-]+\.){2,}[^\W\d_]{2,24}(?![\w.])|[^\s»›→]+\s?[»›→]\s?(?:[\w-]+\.)+[^\W\d_]{2,24}(?:/\S*)?",
    re.I | re.S,
)
_BULLET = re.compile(r"\n\s*(?=[-*•#>|]\s|\d{1,4}[.)]\s)")
_ENDS = (". ", "! ", "? ", "… ", ".\n", "!\n", "?\n", "…\n", ".) ", ".\" ", "!\" ", "?\" ")
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATORS = (",", ";", "|", "·", "•", "»", "/", "#", " - ", " – ", " — ")
_ITEM_SIGNS = (",", ";", "|", "·", "•", "»", "/", "#", "\t")
_ITEM_ENDS = (",", ";", "|", "·", "•", "»", "/", "\t", " - ", " – ", " — ", ". ", "! ", "? ")
_DOMAIN = re.compile(r"[\w-]\.[^\W\d_]{2,24}(?:/|\b)")
_END = re.compile(r"[.!?…:][)\"»”'’]*\s*$")
MEASURES = ("words", "prose", "top_word", "top_pair", "repeated", "links", "separators", "functions", "needed")


class FunctionWords:
    """Function words by language, and the share of them a sentence needs."""

    def __init__(self, samples: list[tuple[str, str]], most: int = 45, need: float = 0.45) -> None:
        texts = defaultdict(list)
        for language, text in samples:
            if language and text:
                texts[language].append([w.lower() for w in _WORD.findall(text)])
        self.words: dict[str, frozenset[str]] = {}
        self.vocabulary: dict[str, frozenset[str]] = {}
        self.needed: dict[str, float] = {}
        self._joint: dict[tuple[str, ...], tuple[frozenset[str], float]] = {}
        for language, listed in texts.items():
            seen = Counter(w for words in listed for w in set(words))
            common = {w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= 2 or len(listed) == 1}
            self.words[language] = frozenset(common)
            self.vocabulary[language] = frozenset(seen)
            shares = [sum(w in common for w in words) / len(words) for words in listed if words]
            self.needed[language] = need * float(np.median(shares)) if shares else 0.0
        spoken = defaultdict(list)
        for language, words in self.vocabulary.items():
            for w in words:
                spoken[w].append(language)
        # The rarer a word is among the languages, the more it says.
        self.weights = {w: tuple((language, 1 / len(listed)) for language in listed) for w, listed in spoken.items()}

    def of(self, spoken: tuple[str, ...]) -> tuple[frozenset[str], float]:
        """Function words of these languages together, and the lowest share of them that a sentence needs."""
        if spoken not in self._joint:
            own = frozenset().union(*(self.words[x] for x in spoken))
            self._joint[spoken] = own, min((self.needed[x] for x in spoken), default=0.0)
        return self._joint[spoken]

    def languages(self, words: Counter) -> list[str]:
        """The language of a text by the words it has of the samples, and others with at least a quarter of its evidence."""
        found: dict[str, float] = {}
        known = self.weights
        for w in words:
            for language, weight in known.get(w, ()):
                found[language] = found.get(language, 0.0) + weight
        ranked = sorted(found.items(), key=lambda x: -x[1])
        return [language for language, v in ranked if v >= 0.25 * ranked[0][1]]


def _sentences(text: str) -> list[str]:
    """Pieces of a text that end where a sentence, a paragraph or an item of a list ends."""
    if "\n" in text:
        text = text.replace("\n\n", "\0")
        text = _BULLET.sub("\0", text)
    for end in _ENDS:
        text = text.replace(end, end + "\0")
    return text.split("\0")


def _few_signs(sentence: str, size: int) -> bool:
    """Whether a sentence has fewer than one sign that separates items for every three words."""
    return 3 * sum(map(sentence.count, _ITEM_SIGNS)) < size


def measure(text: str, functions: FunctionWords) -> tuple[str | None, tuple[float, ...]] | None:
    """(language, values of MEASURES) of a text with words; None for one without."""
    links, rest = 0, text
    if "://" in text or "www." in text or "»" in text or "</a>" in text or "](" in text or "[url" in text or _DOMAIN.search(text):
        for m in _LINK.finditer(text):
            links += m.end() - m.start()
        if links:
            rest = _LINK.sub(" ", text)
    # Every word is found once, sentence by sentence.
    lowered = rest.lower()
    sentences = [(s, _WORD.findall(s)) for s in _sentences(lowered)]
    words = _WORD.findall(text.lower()) if links > 0.5 * len(text) else [w for _, found in sentences for w in found]
    if not words:
        return None
    n, count = len(words), Counter(words)
    spoken = functions.languages(count)
    language = spoken[0] if spoken else None
    own, needed = functions.of(tuple(spoken))
    in_sentences = function_words = 0
    for s, found in sentences:
        size = len(found)
        if size:
            k = sum(map(own.__contains__, found))
            function_words += k
            if size >= 6 and k >= max(1, needed * size) and _END.search(s, max(0, len(s) - 12)) and len(set(found)) > 0.5 * size and _few_signs(s, size):
                in_sentences += size
    top = max([c for w, c in count.items() if w not in own], default=0)
    top_pair = 0
    pairs = Counter(zip(words, words[1:]))
    top_pair = max(pairs.values(), default=0)
    if top_pair > 2:
        top_pair = max([c for (a, b), c in pairs.items() if c > 2 and (a not in own or b not in own)], default=2)
    split = lowered
    for end in _ITEM_ENDS:
        split = split.replace(end, "\n")
    items = [i for x in split.split("\n") if (i := x.strip())]
    repeated = 1 - len(set(items)) / len(items) if items else 0.0
    separators = sum(map(rest.count, _SEPARATORS)) + sum(1 <= len(line) <= 40 for line in rest.split("\n"))
    return language, (
        float(n), in_sentences / n, top / n, 2 * top_pair / max(n, 2), repeated, links / max(len(text), 1), separators / n, function_words / n, needed,
    )


def page_measures(df: DataFrame, record: str, text: str, samples: list[tuple[str, str]]) -> DataFrame:
    """(record, language, words measures) of every row whose text has a word; others have no row. No shuffle."""
    ship(df.sparkSession)
    kind = df.schema[record].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        functions = FunctionWords(samples)
        for batch in batches:
            kept = [(r, m) for r, t in zip(batch["r"], batch["t"]) if (m := measure(t, functions))]
            if not kept:
                continue
            out = {"r": [r for r, _ in kept], "language": [m[0] for _, m in kept]}
            out |= {name: [m[1][i] for _, m in kept] for i, name in enumerate(MEASURES)}
            yield pd.DataFrame(out)

    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(record).alias("r"), F.col(text).alias("t"))
    schema = f"r {kind}, language string, {', '.join(f'{m} double' for m in MEASURES)}"
    return rows.mapInPandas(run, schema).withColumnRenamed("r", record)


def calibrated(measures: DataFrame, fluent: float = 0.8, deviations: float = 3.0) -> DataFrame:
    """(language, top_word_limit, top_pair_limit, repeated_limit, separators_limit) from the fluent pages of a language.

    Fluent pages are those with at least ``fluent`` of their words in sentences; a limit is their mean plus
    ``deviations`` standard deviations. One row per language.
    """
    own = measures.where(F.col("prose") >= fluent).groupBy("language")
    names = ("top_word", "top_pair", "repeated", "separators")
    return own.agg(*((F.avg(m) + deviations * F.coalesce(F.stddev_pop(m), F.lit(0.0))).alias(f"{m}_limit") for m in names))


# Limits where no page of a language is fluent, and limits that hold for every language.
DEFAULT_LIMITS = {"top_word": 0.07, "top_pair": 0.13, "repeated": 0.2, "separators": 0.12}


# Fixed limits of the decision: share of words in sentences below which so many signs make spam.
DECISION = ((0.05, 1), (0.2, 2), (0.33, 3))


def keyword_pages(measures: DataFrame, link_share: float = 0.15, fewest_words: int = 40) -> DataFrame:
    """(columns of the measures, signs, spam): the less of a page is in sentences, the fewer signs make it spam.

    Signs: top word and top pair above the limit of the language (for short pages, chance repetition is allowed for),
    repeated items, separators, links, missing function words. Pages of less than ``fewest_words`` words need two signs.
    The limits, one row per language, are joined by broadcasting.
    """
    limits = F.broadcast(calibrated(measures).withColumnRenamed("language", "of"))
    joined = measures.join(limits, F.col("language") == F.col("of"), "left").drop("of")

    def limit(m: str):
        return F.coalesce(F.col(f"{m}_limit"), F.lit(DEFAULT_LIMITS[m]))

    n = F.col("words")
    signs = [
        F.col("top_word") > limit("top_word") + 1.5 / n,
        F.col("top_pair") > limit("top_pair") + 3 / n,
        F.col("repeated") > limit("repeated") + 2 / n,  # in short pages an item or two may recur by chance
        (F.col("separators") > limit("separators")) & (n >= 12),
        F.col("links") > link_share,
        (F.col("functions") < 0.7 * F.col("needed")) & (F.col("prose") < 0.05) & (n >= 40),
    ]
    total = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    prose, enough = F.col("prose"), F.when(n < fewest_words, 2).otherwise(1)
    spam = F.lit(False)
    for share, least in DECISION:
        spam = spam | ((prose < share) & (total >= F.greatest(F.lit(least), enough)))
    return joined.withColumn("signs", total).withColumn("spam", spam).drop(*(f"{m}_limit" for m in DEFAULT_LIMITS))
